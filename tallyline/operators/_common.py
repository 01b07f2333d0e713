"""Small helpers of the operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes up to which a roster, register or notice is sent to every executor; beyond, joins shuffle.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the planner's estimate of df from the files beneath is within `limit`. Nothing is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it fits(); else as it is, so that the join shuffles unless adaptive execution finds the
    real size small."""
    return F.broadcast(df) if fits(df, limit) else df


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def remove_written() -> None:
    """Removes what written() has left, once no lazy result is in use."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_first = 1").drop("_first")


def least_by(df: DataFrame, keys: list[str], order: list[str], values: list[str], into: str) -> DataFrame:
    """A row per key with struct `into` of the values in the first row of the order; partial aggregates, so hot keys are safe."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias(into))


def ranked(df: DataFrame, order: list[Column | str], into: str) -> DataFrame:
    """df with `into`, the place of each row in the order, from 0: sorted by ranges over all tasks, of which each adds the rows
    of those before it. A window without a key would put all rows into one task."""
    placed = written(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.col("_b") + F.col("_i") - F.shiftleft(F.col("_p").cast("long"), 33)
    return placed.join(F.broadcast(before), "_p").withColumn(into, place).drop("_p", "_i", "_b")


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder in spark.checkpoint.dir and read again: what several later steps use is computed
    once, plans stay short, and a lost executor costs nothing that was written. Results are lazy and may read the files late,
    so these stay until remove_written(), which the end of the process calls."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyline-')}"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)

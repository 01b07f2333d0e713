"""Session helpers the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode, one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        root = f"file://{tempfile.mkdtemp(prefix='tallyline-')}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again, so a lost executor costs no recomputation.

    The files stay for as long as the Python process, as results are lazy and may read them late.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyline-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def remove_written() -> None:
    """Removes what written() has left; called at exit, or earlier once no lazy result is in use."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, unless the session says otherwise: texts are long, and each task holds a batch
    on either side of its Python worker. The setting stays, as plans are lazy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def row_key(id_col: str, text_col: str) -> Column:
    """A hash that tells rows apart by id and text."""
    i, t = F.col(id_col), F.col(text_col)
    return F.xxhash64(i, i.isNull(), F.xxhash64(t), t.isNull())


def skewed_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """Inner join on key, which a large share of `many` may hold. A merge join at every size: adaptive execution splits its
    skewed partitions over tasks, which it can't once it has turned a join into a broadcast."""
    return many.join(one.hint("merge"), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_white_space(text: Column) -> Column:
    """text (null: empty) without the characters of [\\x20\\x09-\\x0D]."""
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), " \t\n\x0b\f\r", F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def running_total(df: DataFrame, key: list[str], order: list, value: Column, bucket: Column, into: str) -> DataFrame:
    """Adds `into`: the sum of value over the rows of the same key that stand before a row.

    Rows are ordered by `bucket`, then by `order`. Only (key, bucket) cells are ever sorted in one task, and
    only cell sums meet per key, so a key that holds a third of all rows spreads over as many tasks as it has buckets.
    """
    cell = df.withColumn("_v", value).withColumn("_b", bucket)
    sums = cell.groupBy(*key, "_b").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)], F.col("_b") == F.col("_kb"))
    within = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cell.join(sums, same).withColumn(into, F.col("_o") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return placed.drop("_v", "_b", "_o", "_kb", *[f"_k{i}" for i in range(len(key))])

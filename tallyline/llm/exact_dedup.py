"""Exact dedup by progressive refinement: length, then a prefix hash, then a full hash.

The first scan reads texts once and keeps two numbers a row; their cells say which (length, prefix) pairs occur more
than once. Those pairs go, as a bitmap of a fixed size, to the second scan, which computes full hashes for rows in
surviving groups alone. No text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._frames import table, without_white_space, written

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 64
#: Bits of the survivors' bitmap: 1 MB, whatever the input. A full bitmap lets more rows through; results are the same.
BITS = 1 << 23
_WORD = 32768  # bits of one of Spark's bitmaps


def surviving_bitmap(cells: DataFrame) -> DataFrame:
    """At most BITS / 32768 rows (_no, _bits) marking hash slots of the (length, prefix) cells with several rows."""
    slot = F.pmod(F.xxhash64("_len", "_pre"), F.lit(BITS))
    return cells.select(F.floor(slot / _WORD).cast("int").alias("_no"), F.pmod(slot, F.lit(_WORD)).alias("_at")).groupBy("_no").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, key: Column | None = None) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space of [\\x20\\x09-\\x0D]; a null text is an empty one, and
    empty texts equal each other. The row with the most code points, then the smallest id (null last), stays. Rows that repeat the
    kept row's id and length are the same document and say kept as well. An empty table gives an empty result; other
    columns of docs are ignored. digest: text_sha256 for every row, else null where the full text was not needed. key: a value
    of the caller's for each row, returned as row_key.
    """
    norm = without_white_space(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_cp"), norm.alias("_norm"), (F.lit(0) if key is None else key).alias("_row"))
    rows = rows.select("_id", "_cp", F.octet_length("_norm").alias("_len"), F.xxhash64(F.left("_norm", F.lit(PREFIX))).alias("_pre"), "_norm", "_row")
    cells = written(rows.groupBy("_len", "_pre").agg(F.count("*").alias("_n")))
    lengths = cells.groupBy("_len").agg(F.sum("_n").alias("_m")).filter("_m > 1")
    survive = cells.join(lengths, "_len", "left_semi").filter("_n > 1")
    slot = F.pmod(F.xxhash64("_len", "_pre"), F.lit(BITS))
    at = F.pmod(slot, F.lit(_WORD))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))
    rows = rows.withColumn("_no", F.floor(slot / _WORD).cast("int")).join(F.broadcast(surviving_bitmap(survive)), "_no", "left")
    rows = rows.withColumn("_hit", hit).withColumn("_sha", F.sha2(F.col("_norm"), 256) if digest else F.when(F.col("_hit"), F.sha2(F.col("_norm"), 256)))
    rows = written(rows.select("_id", "_cp", "_sha", F.when(F.col("_hit"), F.col("_sha")).otherwise(F.xxhash64("_id", "_pre").cast("string")).alias("_key"), "_hit", "_row"))
    best = F.min(F.struct((-F.col("_cp")).alias("c"), F.col("_id").isNull().alias("n"), F.col("_id").alias("i")))
    groups = written(rows.filter("_hit").groupBy(F.col("_key").alias("_g")).agg(F.count("*").alias("_n"), best.alias("_best")).filter("_n > 1"))
    out = rows.join(groups, F.col("_key") == F.col("_g"), "left")
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_best.i"))
    kept = F.col("_n").isNull() | (F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_cp") == -F.col("_best.c")))
    return out.select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.col("_sha").alias("text_sha256"), *([] if key is None else [F.col("_row").alias("row_key")]))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
g AS (SELECT n, count(*) AS group_size, arg_min(doc_id, (-length(t), doc_id)) AS keep_id FROM d GROUP BY n)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.n) AS text_sha256 FROM d JOIN g ON d.n = g.n
"""

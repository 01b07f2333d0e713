"""Dedup of long byte strings that occur more than once anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._frames import table
from tallyline.llm.repeats import Rule, without_repeats

BYTES = 400
#: Bytes of a seed; every 400 bytes hold one of the winnowed seeds.
SEED = 300


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = BYTES, seed: int = SEED) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, spans (removed runs of bytes), kept (binary: the other bytes).

    Every byte in a string of `length` bytes that also starts anywhere else, the same text included, goes; strings
    may overlap, never cross texts, and are judged on the input. A null text is empty; shorter texts keep all. Rows
    that repeat an id and a text are copies of each other. An empty table gives an empty result; other columns are
    ignored.
    """
    out = without_repeats(docs, Rule(length, min(seed, length), True, False), id_col, text_col)
    return out.withColumnRenamed("n", "n_bytes")


#: Windows of bytes, in hexadecimal, by their digest; windows that several places share are merged into runs.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, unnest(range(0, len(h) // 2 - 399)) AS i, h FROM d WHERE len(h) >= 800),
m AS MATERIALIZED (SELECT r, i, md5(substring(h, 2 * i + 1, 800)) AS k FROM s),
g AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM m) WHERE n > 1),
b AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400, true) AS new FROM g),
q AS (SELECT r, i, sum(new::INT) OVER (PARTITION BY r ORDER BY i) AS run FROM b),
z AS (SELECT r, min(i) AS a, max(i) + 400 AS e FROM q GROUP BY r, run),
p AS (SELECT z.r, a, e, substring(d.h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (a - coalesce(lag(e) OVER w, 0))) AS before FROM z JOIN d ON z.r = d.r WINDOW w AS (PARTITION BY z.r ORDER BY a)),
k AS (SELECT r, string_agg(before, '' ORDER BY a) AS kept, max(e) AS last, sum(e - a) AS n, count(*) AS spans FROM p GROUP BY r)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

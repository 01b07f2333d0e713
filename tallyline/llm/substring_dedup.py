"""Substring dedup: removes passages of words that an earlier document holds as well."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._frames import table
from tallyline.llm.repeats import Rule, without_repeats

WORDS = 13
#: Words of a seed; every run of 13 words holds one of the winnowed seeds.
SEED = 8


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """A row per row of docs: doc_id, n_words, spans (removed runs of words), kept (the kept words, one space apart).

    Words are [^\\x20\\x09-\\x0D]+. Every word in a window of `words` words whose sequence also starts in a document
    with a smaller id goes; windows are judged on the input. A null text has no words, a text with fewer words than a
    window keeps them all, a null id counts as the largest, and rows with the same id never remove each other's words.
    An empty table gives an empty result; other columns are ignored.
    """
    out = without_repeats(docs, Rule(words, min(seed, words), False, True), id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_words"), "spans", F.col("kept").cast("string").alias("kept"))


#: Windows by their words; words covered by a window that starts in a smaller id go.
SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: {'i': i, 'k': array_to_string(w[i:i + 12], ' ')})) AS x FROM d WHERE len(w) >= 13),
f AS (SELECT x.k AS k, min(coalesce(doc_id, 9223372036854775807)) AS least FROM s GROUP BY x.k),
c AS (SELECT DISTINCT s.r, unnest(range(s.x.i, s.x.i + 13)) AS j FROM s JOIN f ON s.x.k = f.k WHERE f.least < coalesce(s.doc_id, 9223372036854775807)),
u AS (SELECT r, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
k AS (SELECT u.r, string_agg(u.word, ' ' ORDER BY u.j) AS kept, count(*) AS n FROM u ANTI JOIN c ON u.r = c.r AND u.j = c.j GROUP BY u.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.r = k.r
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))

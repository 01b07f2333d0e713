"""Mixing sources to target weights along a curriculum that varies with time.

Each source has a weight that runs from one value to another over the training. Its integral over all of training is
the source's target; a document's place in its source's token stream is its cumulative demand, and inverting the
integral gives the moment of training at which that demand falls due. Rows are range-sorted by that moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.llm._frames import running_total, table, word_count, written

#: Weights by a source's place among all sources, repeating; the most a source may be repeated.
WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 3
#: Slopes of the weight schedules, by the same place: weight(t) = target * (1 + slope * (2t - 1)).
SLOPES = (0.5, -0.5, 0.0)
#: Rows of one source that one task sorts, about.
CELL_ROWS = 2_000


def _by_place(values: tuple[float, ...], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(place, F.lit(len(values))) + 1).cast("int"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """sources (_source, _n, _total), a row per source, with _target and _slope.

    Sharing by weight and resharing what exceeds a cap ends where target = min(cap, level * weight) for one level.
    In order of cap / weight the capped sources come first, so running sums over this table, which has one short row
    per source, give the level directly.
    """
    w = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    s = sources.withColumn("_place", F.row_number().over(w) - 1)
    s = s.withColumn("_w", _by_place(weights, F.col("_place"))).withColumn("_slope", _by_place(slopes, F.col("_place"))).withColumn("_cap", F.col("_total") * F.lit(float(epochs)))
    every = Window.orderBy(F.col("_cap") / F.col("_w"), "_place")
    s = s.withColumn("_sum", F.sum("_total").over(Window.partitionBy())).withColumn("_capped", F.coalesce(F.sum("_cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("_free", F.sum("_w").over(every.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_sum") - F.col("_capped")) / F.col("_free")
    s = s.withColumn("_lv", F.when(level * F.col("_w") <= F.col("_cap"), level))
    first = F.first("_lv", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("_level", first).withColumn("_target", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w"))).select("_source", "_n", "_total", "_target", "_slope")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, slopes: tuple[float, ...] = SLOPES, carry: bool = False) -> DataFrame:
    """As mix(), in no order. carry: with a struct `row` of all columns of docs, whatever their names."""
    text, ident = F.col(text_col), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    place = F.conv(F.substring(F.md5(ident), 1, 8), 16, 10).cast("long")  # a hash of 32 bits
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text).alias("_size"), place.alias("_hash"), *([F.xxhash64(text).alias("_text"), F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    if not carry:
        rows = written(rows)
    sources = targets(rows.groupBy("_source").agg(F.count("*").alias("_n"), F.sum("_size").alias("_total")), weights, epochs, slopes)
    sources = written(sources).select(F.col("_source").alias("_s"), "_n", "_total", "_target", "_slope")
    rows = rows.join(sources, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    cells = F.ceil(F.col("_n") / CELL_ROWS)
    rows = running_total(rows, ["_source"], ["_hash", "_id", "_size", *(["_text"] if carry else [])], F.col("_size"), F.floor(F.col("_hash") * cells / F.lit(1 << 32)), "_start")
    zero, want, a = F.lit(0).cast("long"), F.floor("_target"), F.col("_slope")

    def due(e: int) -> Column:
        share = F.try_divide((F.col("_start") + F.lit(e) * F.col("_total")).cast("double"), "_target")
        return F.when(a == 0, share).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / (2 * a) + 0.0)

    passes = [F.struct(F.greatest(zero, F.least(F.col("_size"), want - F.lit(e) * F.col("_total") - F.col("_start"))).cast("long").alias("taken"), due(e).alias("position")) for e in range(epochs)]
    rows = rows.withColumn("passes", F.filter(F.array(*passes), lambda p: p["taken"] > 0))
    total = F.aggregate("passes", zero, lambda n, p: n + p["taken"])
    names = [F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), total.alias("taken")]
    return rows.select(*names, F.try_element_at("passes", F.lit(1))["position"].alias("position"), "passes", *(["row"] if carry else []))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS, slopes: tuple[float, ...] = SLOPES) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, taken, position, passes; sorted by position.

    size counts the words [^\\x20\\x09-\\x0D]+ (null: 0). A source's stream repeats its documents in the order of a hash of
    their ids; the mix takes its first floor(target) words, so a last document may be taken in part, and taken never exceeds
    epochs * size. passes has, for each time that a document is due, the words taken and the position in [0, 1), at which
    the source's demand has grown to all words before them; position is the first of these, null if the document
    is not taken. Null sources are one source, last in order; empty documents take nothing; repeated rows are separate
    documents; ties of hash go by id, then size; an empty table gives an empty result; other columns are ignored. Reruns agree.
    """
    out = schedule(docs, id_col, text_col, source_col, weights, epochs, slopes)
    return out.orderBy(F.col("position").asc_nulls_last(), F.col(id_col))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("passes")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS k FROM t),
w AS (SELECT *, [5.0, 2.0, 1.0][k % 3 + 1]::DOUBLE AS weight, [0.5, -0.5, 0.0][k % 3 + 1]::DOUBLE AS slope, total * 3.0::DOUBLE AS cap FROM p),
s AS (SELECT *, (sum(total) OVER ())::DOUBLE AS every, coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT *, CASE WHEN (every - capped) / free * weight <= cap THEN (every - capped) / free END AS lv FROM s),
m AS (SELECT *, least(cap, coalesce((SELECT arg_min(lv, (cap / weight, k)) FROM l WHERE lv IS NOT NULL), 0) * weight) AS target FROM l),
r AS (SELECT d.doc_id, d.source, d.size, m.total AS source_size, m.target, m.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source),
x AS (SELECT *, greatest(0, least(size, floor(target)::BIGINT - start)) + greatest(0, least(size, floor(target)::BIGINT - source_size - start)) + greatest(0, least(size, floor(target)::BIGINT - 2 * source_size - start)) AS taken, start / target AS share FROM r)
SELECT doc_id, source, size, source_size, target, taken::BIGINT AS taken, CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) + 0.0 END END AS position FROM x
"""

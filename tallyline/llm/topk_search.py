"""Exact top-k search by inner product over vectors grouped by length.

Vectors are range-partitioned and sorted by dimension and length, so each batch holds buckets of similar lengths. One pass over
them serves as many blocks of queries as a fixed number of bytes holds. The longest vectors, which go with the queries, give
thresholds to start from. For each bucket and query the k-th best score so far gives a local cosine threshold: above 1
the bucket is skipped by its length alone; if it is high, candidates are pruned by the ranges that it leaves for the
query's largest coordinates; if it is low, by their own lengths. What remains is verified by whole products.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.llm._frames import short_batches, table, written

K = 5
SCALE = 256
#: Queries of a block, rows of a bucket, and components of queries that one pass over the vectors serves (32 MB).
BLOCK, BUCKET, PASS = 1024, 2048, 1 << 22
#: Local cosine thresholds from which coordinates prune better than lengths, and coordinates that are looked at.
STEEP, FOCUS = 0.6, 3


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; in doubles, which hold them, where no partial sum can exceed 2^53."""
    if len(q) and len(x) and float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return q @ x.T


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.score = np.zeros((queries, 0), np.int64)
        self.id = np.zeros((queries, 0), np.int64)
        self.real = np.zeros((queries, 0), bool)
        self.k = k

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, real: np.ndarray) -> None:
        """score (rows, n) and ids (n) of candidates for these rows, where real."""
        n, m, add = len(self.score), self.score.shape[1], min(self.k, score.shape[1])
        if not add:
            return
        low = np.iinfo(np.int64).min
        s = np.where(real, score, low)
        top = np.argsort(ids, kind="stable")  # ties go to the smaller id
        part = top[np.argsort(~s[:, top], axis=1, kind="stable")[:, :add]]
        both = [np.full((n, add), low), np.zeros((n, add), np.int64), np.zeros((n, add), bool)]
        both[0][rows] = np.take_along_axis(s, part, 1)
        both[1][rows] = ids[part]
        both[2][rows] = np.take_along_axis(real, part, 1)
        s, i, r = (np.concatenate([a, b], axis=1) for a, b in zip((self.score, self.id, self.real), both, strict=True))
        s = np.where(r, s, low)
        order = np.lexsort((i, ~s), axis=1)[:, : min(self.k, m + add)]
        self.score, self.id, self.real = (np.take_along_axis(x, order, 1) for x in (s, i, r))

    def floor(self) -> np.ndarray:
        """The k-th best score, which a candidate must reach; minus infinity before there are k."""
        if self.score.shape[1] < self.k:
            return np.full(len(self.score), -np.inf)
        return np.where(self.real[:, -1], self.score[:, -1].astype(np.float64), -np.inf)


@dataclass
class Block:
    """Queries of one dimension, their best so far, and scores that their k-th best can't be below."""

    qid: np.ndarray
    q: np.ndarray
    best: Best
    floor: np.ndarray

    @staticmethod
    def of(qid: np.ndarray, q: np.ndarray, long_ids: np.ndarray, long: np.ndarray, k: int) -> Block:
        head = Best(len(q), k)
        if len(long) and long.shape[1] == q.shape[1]:
            head.add(np.arange(len(q)), _product(q, long), long_ids, long_ids[None, :] != qid[:, None])
        return Block(qid, q, Best(len(q), k), head.floor())

    def look(self, x: np.ndarray, ids: np.ndarray, xlen: np.ndarray) -> None:
        """Verifies what a bucket's vectors x can add."""
        qlen = np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        need = np.maximum(self.best.floor(), self.floor)
        reach = qlen * xlen.max()
        local = np.where(need > 0, need / np.maximum(reach, 1e-300), np.where(need > -reach, 0.0, -1.0))
        live = np.flatnonzero(need <= reach * (1 + 1e-9))
        if not len(live):
            return
        steep = local[live] >= STEEP
        for rows, prune in ((live[steep], True), (live[~steep], False)):
            if not len(rows):
                continue
            if prune:  # coordinates: cos >= t leaves each unit coordinate a range around t * q
                t, ux = np.minimum(local[rows], 1.0), x / np.maximum(xlen, 1e-300)[:, None]
                unit = self.q[rows] / np.maximum(qlen[rows], 1e-300)[:, None]
                focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
                ok = np.ones((len(rows), len(x)), bool)
                for f in range(focus.shape[1]):
                    c = unit[np.arange(len(rows)), focus[:, f]]
                    half = np.sqrt(np.maximum(0, (1 - c * c) * (1 - t * t)))
                    mine = ux[:, focus[:, f]].T
                    ok &= mine >= np.where(c <= -t, -1, c * t - half)[:, None] - 1e-9
                    ok &= mine <= np.where(c >= t, 1, c * t + half)[:, None] + 1e-9
            else:  # lengths: a product never exceeds that of the lengths
                ok = qlen[rows, None] * xlen[None, :] * (1 + 1e-9) >= need[rows, None]
            ok &= ids[None, :] != self.qid[rows, None]
            some = np.flatnonzero(ok.any(axis=0))
            if len(some):
                self.best.add(rows, _product(self.q[rows], x[some]), ids[some], ok[:, some])


def searched(sent: object, k: int) -> Callable:
    """Vectors, sorted by dimension and length, to each query's k best of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, long_ids, long = sent.value
        blocks: list[Block] = []
        for qid, q in queries:
            blocks += [Block.of(qid[a : a + BLOCK], q[a : a + BLOCK], long_ids, long, k) for a in range(0, len(qid), BLOCK)]
        for batch in batches:
            size, v = np.asarray(batch.column("d")), batch.column("v")
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                mine = [b for b in blocks if last > first and b.q.shape[1] == size[first]]
                for a in range(first, last if mine else first, BUCKET):
                    z = min(a + BUCKET, last)
                    x = _matrix(v.slice(a, z - a), int(size[first]))
                    for b in mine:
                        b.look(x, np.asarray(batch.column("vec_id"))[a:z], np.asarray(batch.column("length"))[a:z])
        for b in blocks:
            r, c = np.nonzero(b.best.real)
            yield pa.RecordBatch.from_arrays([pa.array(b.qid[r]), pa.array(b.best.id[r, c]), pa.array(b.best.score[r, c])], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """A row per query and rank: query_id, rank, vec_id, score, by integer products of floor(scale * component).

    `queries` says which rows are queries; all other rows with as many components are their candidates, a row with the
    query's own id never. Ties go to the smaller id. Null ids, null and empty vectors and vectors with null or non-finite
    components take no part. A query id that repeats is searched once, with its first vector in order of components;
    candidates that repeat an id are all candidates. Products beyond 64 bits wrap. An empty table gives an empty result;
    other columns, whatever their names, are ignored.
    """
    short_batches(vectors.sparkSession)
    spark = vectors.sparkSession
    v = F.col("e")
    fine = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    fine = fine.filter(F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))))
    fine = fine.select("vec_id", F.transform(v, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"), F.size(v).alias("d"), "is_query")
    fine = written(fine.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))))
    every = fine.groupBy("d").agg(F.count("*").alias("n"))
    size = every.agg(F.sum(F.col("n") * F.col("d"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size * 8 // (32 << 20)))
    by = [F.col("d"), F.desc("length"), F.col("vec_id")]
    ordered = written(fine.select("vec_id", "v", "d", "length").repartitionByRange(parts, *by).sortWithinPartitions(*by))
    asked = fine.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    total = asked.agg(F.sum("d")).first()[0] or 0
    passes = -(-total // PASS)
    asked = written(asked.withColumn("p", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, passes)))))
    common = every.orderBy(F.desc("n"), "d").first()
    head = ordered.filter(F.col("d") == (common["d"] if common else 0)).orderBy(F.desc("length"), "vec_id").limit(BUCKET).select("vec_id", "v").toArrow()  # one bucket
    head = np.asarray(head.column("vec_id")), _matrix(head.column("v").combine_chunks(), common["d"] if common else 1)
    schema = "query_id long, rank int, vec_id long, score long"
    found = None
    for p in range(passes):
        t = asked.filter(F.col("p") == p).orderBy("d", "vec_id").toArrow()  # about PASS components
        if not t.num_rows:
            continue
        ids, d, flat = np.asarray(t.column("vec_id")), np.asarray(t.column("d")).astype(np.int64), t.column("v").combine_chunks()
        edges = [0, *(np.flatnonzero(np.diff(d)) + 1).tolist(), len(d)]
        sent = spark.sparkContext.broadcast(([(ids[a:b], _matrix(flat.slice(a, b - a), int(d[a]))) for a, b in zip(edges[:-1], edges[1:], strict=True)], *head))
        part = ordered.mapInArrow(searched(sent, k), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        part = written(part.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        sent.unpersist()
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], schema) if found is None else found


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

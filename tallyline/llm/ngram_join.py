"""Near-duplicate join of documents on word n-grams by MinHash banding.

1. A scan makes each text's set of n-gram hashes, and of it the set's own hash, its size and its band hashes. Texts
   with equal sets are one class; from here on a class counts once, whatever its number of copies.
2. Classes that share a band hash are tied to the least class of that band, a star per band, never a pair per pair.
   The components of the stars are families: no two similar classes are in different families, but for the recall
   that the band counts were chosen for.
3. Classes are verified on their full sets, a small family in one piece. A large one, which may chain many loose groups, is
   split into blocks by the bands that most of its classes share; a task verifies two blocks, as one sparse product, and only
   blocks that some band ties meet. Of verified links only counts and stars leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._bytes import NOT_SPACE, mixed, slices, spans, windows, within, word_hashes, words
from tallyline.llm._frames import row_key, skewed_join, short_batches, table, written

N, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: MinHashes at most; with this, rows and bands follow from similarity and recall.
HASHES = 128
#: Classes of a family that one task takes as a block, and rows of small families that one task takes.
BLOCK, BUNDLE = 512, 4096


def bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows with which so many bands find a pair of that similarity with that probability."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - similarity)) if similarity < 1 else 1, 1)
    for r in range(2, 33):
        b = math.ceil(math.log(1 - recall) / math.log(1 - similarity**r)) if similarity < 1 else 1
        if b * r <= hashes:
            best = (b, r)
    return best


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram hashes, sorted within a text, and the texts' offsets among them.

    A text of fewer words, but one at least, has one n-gram: all of its words.
    """
    s, e, o = words(buf, offsets, NOT_SPACE)
    digits = word_hashes(buf, s, e)
    h = windows(digits, n)
    at = np.flatnonzero(within(o, len(s), n))
    count = np.diff(o)
    short = np.flatnonzero((count > 0) & (count < n))
    doc = np.concatenate([np.searchsorted(o, at, "right") - 1, short])
    h = np.concatenate([h[at], spans(digits, o[short], count[short])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(offsets)))


def _reduced(f: np.ufunc, x: np.ndarray, o: np.ndarray, full: np.ndarray) -> np.ndarray:
    return f.reduceat(x, o[:-1][full]) if full.any() else np.zeros(0, x.dtype)


def signatures(n: int, b: int, r: int) -> Callable:
    rng = np.random.Generator(np.random.PCG64(7))
    mul = rng.integers(1, 1 << 63, b * r, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    xor = rng.integers(1, 1 << 63, b * r, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, buf, offsets in slices(batch.column("text")):
                h, o = shingles(buf, offsets, n)
                full = np.diff(o) > 0
                c = [np.zeros(z - a, np.uint64), np.zeros(z - a, np.uint64)]
                for k, salt in enumerate((0, 0x632BE59BD9B4E019)):
                    c[k][full] = mixed(_reduced(np.add, mixed(h ^ np.uint64(salt)), o, full) + np.uint64(salt))
                keys = np.zeros((int(full.sum()), b), np.uint64)
                for j in range(b):
                    key = np.full(len(keys), j + 1, np.uint64)
                    for k in range(j * r, (j + 1) * r):
                        key = mixed(key ^ _reduced(np.minimum, (h ^ xor[k]) * mul[k], o, full))
                    keys[:, j] = key
                at = np.concatenate([[0], np.cumsum(np.where(full, b, 0))]).astype(np.int32)
                cols = [batch.column("doc_id").slice(a, z - a), batch.column("th").slice(a, z - a), *(pa.array(x.view(np.int64)) for x in c), pa.array(np.diff(o))]
                yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(at, pa.array(keys.ravel().view(np.int64)))], ["doc_id", "th", "c1", "c2", "n", "bands"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (u, v): the least node of each component, by large and small stars.

    Each round ties a node's larger neighbours, then all its smaller ones, to the least of them, which halves the depth of
    trees; rounds end when all trees are stars: no node has two parents, and no parent has one. A round writes once.
    """
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select(F.col("v").alias("n"), F.lit(0), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).filter("c > 1 or c + p > 1")
        if not open_.agg(F.count("*")).first()[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = skewed_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").filter("u <> v").distinct())
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def blocked(families: DataFrame, tied: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, family, blocks, block) of all nodes, and the tasks (block, bi, bj) of large families.

    A node's home is the band that it shares with most others. Nodes of one home share a block, or, where they are more than a
    block holds, are dealt over as many as they need; several small homes go to one block. Two blocks meet if they share a band.
    """
    large = families.filter("blocks > 1")
    small = families.filter("blocks = 1").select("node", "family", "blocks", F.col("family").alias("block"))
    if not large.head(1):
        return small, large.select(F.col("node").alias("block"), F.col("node").alias("bi"), F.col("node").alias("bj"))
    ties = written(skewed_join(tied.join(large, "node"), stars.select("band", "k"), "band"))
    home = written(ties.groupBy("node").agg(F.max(F.struct("k", "band")).alias("h")).select("node", F.col("h.band").alias("home")))
    many = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("many"))
    dealt = F.when(F.col("many") > 1, F.xxhash64("family", "home", F.pmod(F.xxhash64("node"), F.col("many")))).otherwise(F.xxhash64("family", F.pmod(F.xxhash64("home"), F.col("blocks"))))
    placed = written(large.join(skewed_join(home, many, "home"), "node").select("node", "family", "blocks", dealt.alias("block")))
    held = written(ties.select("node", "band").join(placed.select("node", "block"), "node").select("band", "block").distinct())
    pairs = held.withColumnRenamed("block", "bi").join(held.withColumnRenamed("block", "bj").hint("merge"), "band").filter("bi < bj").select("bi", "bj").distinct()
    own = placed.select(F.col("block").alias("bi"), F.col("block").alias("bj")).distinct()
    pairs = written(pairs.union(own))
    tasks = pairs.select(F.col("bi").alias("block"), "bi", "bj").union(pairs.filter("bi < bj").select(F.col("bj").alias("block"), "bi", "bj"))
    return placed.union(small), tasks


def linked(similarity: float) -> Callable:
    """Blocks of classes to links (kind 0: node, number of linked documents) and stars (root, node) of what links tie
    together: kind 1 in a whole family, where they are the groups, kind 2 in two blocks of one."""

    def run(t: pa.Table) -> pa.Table:
        family, bi, bj, mine, blocks = (np.asarray(t.column(k)) for k in ("family", "bi", "bj", "block", "blocks"))
        node, members = np.asarray(t.column("node")), np.asarray(t.column("members"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        kind, left, right = [], [], []
        order = np.lexsort((node, bj, bi, family))
        key = np.stack([family[order], bi[order], bj[order]])
        edges = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if len(order) else []
        for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[a:z]
            rows = rows[np.append(True, node[rows][1:] != node[rows][:-1])]  # rows that repeat a document whole
            m = len(rows)
            size = np.array([len(sets[i]) for i in rows])
            _, at = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)
            owner = np.repeat(np.arange(m), size)
            both = np.zeros((m, m), np.int64)
            for c in range(0, int(at.max()) + 1, 8192):  # columns of the product, some at a time
                which = (at >= c) & (at < c + 8192)
                x = np.zeros((m, 8192), np.float32)
                x[owner[which], at[which] - c] = 1
                x = x[:, x.any(axis=0)]
                both += (x @ x.T).astype(np.int64)
            ok = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
            np.fill_diagonal(ok, False)
            block = mine[rows]
            if bi[rows[0]] != bj[rows[0]]:
                ok &= block[:, None] != block[None, :]  # pairs within a block have their own task
            links = ok @ members[rows]
            some = np.flatnonzero(links)
            kind += [0] * len(some)
            left += node[rows][some].tolist()
            right += links[some].tolist()
            seen = np.zeros(m, bool)
            for s in range(m):  # from the least node of each tree, breadth first
                if seen[s]:
                    continue
                seen[s] = True
                queue = [s]
                while queue:
                    new = np.flatnonzero(ok[queue].any(axis=0) & ~seen)
                    seen[new] = True
                    queue = new.tolist()
                    kind += [1 if blocks[rows[0]] == 1 else 2] * len(queue)
                    left += [int(node[rows[s]])] * len(queue)
                    right += node[rows[new]].tolist()
        return pa.table([pa.array(kind, pa.int32()), pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["kind", "a", "b"])

    return run


def sets_of(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, buf, offsets in slices(batch.column("text")):
                h, o = shingles(buf, offsets, n)
                cols = [batch.column(k).slice(a, z - a) for k in ("node", "members", "family", "blocks", "block")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([h[x:y].tobytes() for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)], pa.binary())], ["node", "members", "family", "blocks", "block", "set"])

    return run


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row per row of docs: doc_id, class_id, n_ngrams, n_links, group_id, representative, row_key.

    N-grams are of words [^\\x20\\x09-\\x0D]+, unchanged; a text of fewer words has one. class_id is the least id among
    documents with the same set; n_links counts the other documents whose sets have a Jaccard similarity of at least
    `similarity`, copies included; group_id is the least id among documents tied by links, and representative
    marks that document (of several with that id and other texts one); row_key is row_key() of a row. Null and empty texts have
    no n-grams and stand alone. A null id counts as larger than any other, and shows as null. Rows with the same id
    and different texts are different documents; repeated rows are copies. An empty table gives an empty result;
    other columns are ignored.
    """
    short_batches(docs.sparkSession)
    b, r = bands(similarity, recall)
    top = (1 << 63) - 1
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(top)).alias("doc_id"), row_key(id_col, text_col).alias("th"), F.col(text_col).alias("text"))
    sig = written(docs.mapInArrow(signatures(n, b, r), "doc_id long, th long, c1 long, c2 long, n long, bands array<long>"))
    rep = F.min(F.struct("doc_id", "th")).alias("rep")
    classes = written(sig.filter("n > 0").groupBy("c1", "c2", "n").agg(rep, F.count("*").alias("members"), F.any_value("bands").alias("bands")))
    tied = classes.select(F.col("c1").alias("node"), F.explode("bands").alias("band"))
    stars = written(tied.groupBy("band").agg(F.min("node").alias("v"), F.count("*").alias("k")).filter("k > 1"))
    families = components(skewed_join(tied, stars, "band").select(F.col("node").alias("u"), "v"))
    families = families.withColumnRenamed("root", "family")
    sizes = families.groupBy("family").agg(F.count("*").alias("m")).select("family", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    families = written(skewed_join(families, sizes, "family"))
    total = families.count()
    placed, tasks = blocked(families, tied, stars)
    members = classes.select(F.col("c1").alias("node"), "members", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"))
    members = written(members.join(placed, "node"))
    # A merge join at every size: whether members would fit a broadcast depends on the input.
    sets = docs.join(members.hint("merge"), ["doc_id", "th"]).select("node", "members", "family", "blocks", "block", "text").mapInArrow(sets_of(n), "node long, members long, family long, blocks int, block long, set binary")
    sets = sets.join(tasks.hint("merge"), "block", "left").withColumn("bi", F.coalesce("bi", "block")).withColumn("bj", F.coalesce("bj", "block"))
    bundles = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUNDLE))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bundles))).otherwise(F.xxhash64("bi", "bj"))
    found = written(sets.withColumn("task", task).groupBy("task").applyInArrow(linked(similarity), "kind int, a long, b long"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
    stars = found.filter("kind = 1")
    groups = stars.select(F.col("b").alias("node"), F.col("a").alias("root")).union(stars.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    groups = groups.union(components(found.filter("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))))
    known = classes.select("c1", "c2", "n", "rep", "members")
    tied = known.join(groups, known["c1"] == groups["node"]).drop("node")
    tied = skewed_join(tied, tied.groupBy("root").agg(F.min("rep").alias("least")), "root").select(F.col("c1").alias("t1"), F.col("c2").alias("t2"), "least")
    known = known.join(links, known["c1"] == links["node"], "left").join(tied, (F.col("c1") == F.col("t1")) & (F.col("c2") == F.col("t2")), "left")
    known = written(known.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), F.col("n").alias("k"), F.col("rep.doc_id").alias("class_id"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("head")))
    out = sig.select("doc_id", "th", "c1", "c2", "n").join(known, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n") == F.col("k")), "left")
    shown = lambda c: F.nullif(F.coalesce(c, F.col("doc_id")), F.lit(top))
    return out.select(F.nullif("doc_id", F.lit(top)).alias("doc_id"), shown(F.col("class_id")).alias("class_id"), F.col("n").alias("n_ngrams"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), shown(F.col("head.doc_id")).alias("group_id"), F.coalesce((F.col("doc_id") == F.col("head.doc_id")) & (F.col("th") == F.col("head.th")), F.lit(True)).alias("representative"), F.col("th").alias("row_key"))


#: All pairs that share an n-gram, counted; groups by what links reach.
SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS o, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, o, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
c AS MATERIALIZED (SELECT g, min(o) AS class, min(r) AS node, count(*) AS members FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT node, len(g) AS n, unnest(g) AS x FROM c),
p AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8::DOUBLE * (a.n + b.n - count(*)) - 1e-9),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
t AS (SELECT node AS a, node AS b FROM c UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
k AS (SELECT t.a, min(c.class) AS grp FROM t JOIN c ON t.b = c.node GROUP BY t.a),
l AS (SELECT e.a, sum(c.members) AS links FROM e JOIN c ON e.b = c.node GROUP BY e.a)
SELECT s.doc_id, nullif(coalesce(c.class, s.o), 9223372036854775807) AS class_id, len(s.g)::BIGINT AS n_ngrams, (coalesce(c.members - 1, 0) + coalesce(l.links, 0))::BIGINT AS n_links,
  nullif(coalesce(k.grp, s.o), 9223372036854775807) AS group_id FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN k ON c.node = k.a LEFT JOIN l ON c.node = l.a
"""


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("representative", "row_key")

"""Finding every stretch of at least L symbols that occurs elsewhere, exactly and without comparing pairs.

Texts are sequences of symbols (words or bytes). The engine seeds and extends:

1. Seeds. Of the hashes of `seed` consecutive symbols, winnowing keeps the least of every L - seed + 1, so each window
   of L symbols holds a kept seed, and equal windows hold it at the same place.
2. Join. Seeds meet by their hash, together with a hash of their whole context: all that a window through the seed can
   reach, L - seed symbols to the left and to the right. An equal context settles every window through the seed
   at once. Of a seed that stands in different contexts, one bearer of each is extended.
3. Extend. The contexts of a seed meet as a collection, aligned at the seed. Column by column, one symbol of each
   context a round, their order and the common prefixes of neighbours are updated (columns.py): first the columns on
   the right, then those on the left, and after each of these the windows that begin there are judged.
4. Maximal repeats. Settled windows of a text are merged into runs.

Entries travel as packed arrays, a row per (batch, bucket). Within some MB of texts all bearers of a context but one are
settled on the spot, so a context that a third of all texts hold reaches a bucket once for those, not once a text. A seed
that stands in very many contexts would gather them all in one bucket; its contexts go to buckets of their own
and its windows meet by a hash of the whole window instead. Texts are grouped by a hash of their key into shards of some MB;
shards and buckets grow in number with the input, not in size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm._bytes import NOT_SPACE, covered, joined, mixed, ragged, slices, spans, wide_windows, winnow, within, word_hashes, words
from tallyline.llm._frames import row_key, short_batches
from tallyline.llm.columns import repeated_windows

BLOB = "kind int, part int, id binary, key binary, n binary, v binary"
_NAMES = [x.split()[0] for x in BLOB.split(", ")]
SEED = np.dtype([("h", "<u8"), ("c", "<u8"), ("x", "<u4"), ("at", "<u4"), ("m", "u1")])
VERDICT = np.dtype([("at", "<u4"), ("f", "u1")])
WINDOW = np.dtype([("h", "<u8"), ("x", "<u4"), ("at", "<u4"), ("m", "u1")])
RUN = np.dtype([("a", "<u4"), ("b", "<u4")])
#: Kinds of rows: entries by bucket; verdicts or runs by shard; windows by bucket.
ENTRIES, TOLD, WINDOWS = 0, 1, 2
#: Of a seed entry: has several bearers already; its seed is common; it only marks its seed as common.
SEVERAL, SPREAD, MARK = 1, 2, 4
#: Of a verdict: all windows through the seed are repeats; extend it; extend it window by window, as the seed is common.
SETTLED, EXTEND, COMMON = 1, 2, 4
#: Contexts from which a seed is common, within the texts that are sent together and within a bucket.
MANY, VERY_MANY = 16, 2048
#: MB of input, as stored, for one shard or bucket.
PART_MB = 8
#: Entries that a mapping task gathers before it sends them.
FLUSH = 1 << 20


@dataclass(frozen=True)
class Rule:
    """length and seed in symbols; bytewise: symbols are bytes, else words; smaller: a repeat must also start in a row
    with a smaller id, else anywhere else."""

    length: int
    seed: int
    bytewise: bool
    smaller: bool

    @property
    def reach(self) -> int:
        """Symbols on either side of a seed that a window through it can hold."""
        return self.length - self.seed

    @property
    def stretch(self) -> np.dtype:
        """A seed's digest and place, and the symbols on its left (from the seed outwards) and right."""
        sym = "u1" if self.bytewise else "<u8"
        return np.dtype([("h", "<u8"), ("x", "<u8"), ("at", "<u4"), ("nl", "<u2"), ("nr", "<u2"), ("l", sym, (self.reach,)), ("r", sym, (self.reach,))])


def symbols(rule: Rule, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, a word by its hash, and the texts' offsets among them."""
    if rule.bytewise:
        return buf, offsets
    s, e, o = words(buf, offsets, NOT_SPACE)
    return word_hashes(buf, s, e), o


def digests(sym: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.dtype) -> np.ndarray:
    """BLAKE2 digests of runs of symbols."""
    raw, w = memoryview(np.ascontiguousarray(sym)).cast("B"), sym.itemsize
    size = kind.itemsize
    return np.frombuffer(b"".join([hashlib.blake2b(raw[w * a : w * b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), kind)


def seeds(rule: Rule, sym: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each kept seed its hash, the 96 bits of its context's hash, its text, and its place."""
    h = wide_windows(sym, rule.seed)
    at = winnow(h, within(o, len(sym), rule.seed), rule.reach + 1)
    doc = np.searchsorted(o, at, "right") - 1
    lo, hi = np.maximum(at - rule.reach, o[doc]), np.minimum(at + rule.length, o[doc + 1])
    if rule.bytewise:
        d = digests(sym, lo, hi, np.dtype([("c", "<u8"), ("x", "<u4")]))
        return h[at], d["c"], d["x"], doc, at - o[doc]
    c, x = spans(sym, lo, hi - lo), spans(mixed(sym ^ np.uint64(0x632BE59BD9B4E019)), lo, hi - lo)
    return h[at], c, (x >> np.uint64(32)).astype(np.uint32), doc, at - o[doc]


def packed(kind: int, part: np.ndarray, doc: np.ndarray, v: np.ndarray, key: np.ndarray, ids: np.ndarray | None = None) -> list[tuple]:
    """A blob row per part; entries of one document stand together, with its key, and its id where that is needed."""
    if not len(v):
        return []
    order = np.lexsort((doc, part))
    part, doc, v = part[order], doc[order], v[order]
    out = []
    edges = np.append(np.flatnonzero(np.diff(part, prepend=part[0] - 1)), len(part))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        d, n = np.unique(doc[a:b], return_counts=True)
        out.append((kind, int(part[a]), b"" if ids is None else ids[d].tobytes(), key[d].tobytes(), n.astype("<i4").tobytes(), v[a:b].tobytes()))
    return out


def blobs(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], _NAMES)


def unpacked(t: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and ids (zeros if not sent) of documents, the document of each entry, and the entries."""
    get = lambda k, d: np.concatenate([np.zeros(0, d), *[np.frombuffer(x, d) for x in t.column(k).to_pylist()]])
    n, ids, key = get("n", "<i4"), get("id", "<i8"), get("key", "<i8")
    return key, ids if len(ids) else np.zeros(len(key), np.int64), np.repeat(np.arange(len(n)), n), get("v", dtype)


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each entry, equal for equal keys, and the number of groups."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    g = np.empty(len(order), np.int64)
    g[order] = np.cumsum(new)
    return g, int(new.sum()) + 1 if len(order) else 0


def first_of(g: np.ndarray) -> np.ndarray:
    """Flags one entry of each group."""
    first = np.zeros(len(g), bool)
    first[np.unique(g, return_index=True)[1]] = True
    return first


def contexts(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each seed, and the number of contexts g that a seed of such a group stands in."""
    gh, n = groups(h)
    return gh, np.bincount(gh[first_of(g)], minlength=n)


def judged(rule: Rule, g: np.ndarray, count: int, ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in groups g with ids and counts m: which are repeats, and one delegate for each group."""
    if rule.smaller:
        least = np.full(count, np.iinfo(np.int64).max)
        np.minimum.at(least, g, ids)
        return ids > least[g], ids == least[g]
    total = np.bincount(g, m, count)
    return total[g] > 1, first_of(g)


def _columns(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(t.column("key")).astype(np.int64), np.asarray(t.column("id")).astype(np.int64)


def seed_entries(rule: Rule, parts: int) -> Callable:
    """Texts to seed entries, by bucket, and the verdicts that texts sent together give by themselves, by shard."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, ids, h, c, x, at, size = (np.concatenate(k) for k in zip(*held, strict=True))
        doc = np.repeat(np.arange(len(size)), size)
        g, count = groups(h, c, x)
        repeat, delegate = judged(rule, g, count, ids[doc], np.ones(len(g), np.int64))
        gh, n = contexts(h, g)
        common = n[gh] > MANY
        told = np.zeros(int(repeat.sum()), VERDICT)
        told["at"], told["f"] = at[repeat], SETTLED
        rows = packed(TOLD, key[doc[repeat]] % parts, doc[repeat], told, key)
        mark = first_of(gh) & common
        sent = np.concatenate([np.flatnonzero(delegate), np.flatnonzero(mark)])
        v = np.zeros(len(sent), SEED)
        for k, col in (("h", h), ("c", c), ("x", x), ("at", at)):
            v[k] = col[sent]
        v["m"] = np.where(repeat[sent], SEVERAL, 0) | np.where(common[sent], SPREAD, 0)
        v["m"][int(delegate.sum()) :] = MARK
        own = (v["m"] & SPREAD) > 0
        to = np.where(own, joined(v["h"], v["c"]), v["h"]) % np.uint64(parts)
        yield from blobs(rows + packed(ENTRIES, to.astype(np.int64), doc[sent], v, key, ids if rule.smaller else None)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            key, ids = _columns(batch)
            for a, b, buf, offsets in slices(batch.column("text")):
                h, c, x, doc, at = seeds(rule, *symbols(rule, buf, offsets))
                some, size = np.unique(doc, return_counts=True)
                held.append((key[a:b][some], ids[a:b][some], h, c, x, at, size))
                n += len(h)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = [], 0
        if n:
            yield from flush(held)

    return run


def joined_seeds(rule: Rule, parts: int) -> Callable:
    """A bucket of seed entries to verdicts by shard; verdicts pass."""

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows or t.column("kind")[0].as_py() == TOLD:
            return t
        key, ids, doc, v = unpacked(t, SEED)
        marks = (v["m"] & MARK) > 0
        marked = np.unique(v["h"][marks])
        doc, v = doc[~marks], v[~marks]
        g, count = groups(v["h"], v["c"], v["x"], v["m"] & SPREAD)  # one spread by its context meets others so spread
        repeat, delegate = judged(rule, g, count, ids[doc], 1 + (v["m"] & SEVERAL))
        gh, n = contexts(v["h"], g)
        common = (n[gh] > VERY_MANY) | np.isin(v["h"], marked) | ((v["m"] & SPREAD) > 0)
        f = np.where(repeat, SETTLED, 0) | np.where(delegate & ((n[gh] > 1) | common), EXTEND, 0)
        f |= np.where(common, COMMON, 0)
        keep = (f & (SETTLED | EXTEND)) > 0
        told = np.zeros(int(keep.sum()), VERDICT)
        told["at"], told["f"] = v["at"][keep], f[keep]
        return blobs(packed(TOLD, key[doc[keep]] % parts, doc[keep], told, key))

    return run


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Flags of the n places that some [start, end) holds."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def runs_of(flags: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first place and last + 1 of the maximal runs of flags that stay within a text."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[o] = True
    change = np.diff(flags.astype(np.int8), prepend=0, append=0) != 0
    s = np.flatnonzero((change | edge)[:-1] & flags)
    e = np.flatnonzero((change | edge)[1:] & flags) + 1
    return np.searchsorted(o, s, "right") - 1, s, e


def by_text(key: np.ndarray, table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a shard in order of their text's key, and the first and last + 1 of each text."""
    theirs, _, doc, v = unpacked(table, dtype)
    theirs = theirs[doc]
    order = np.argsort(theirs, kind="stable")
    theirs = theirs[order]
    return v[order], np.searchsorted(theirs, key, "left"), np.searchsorted(theirs, key, "right")


def stretches(rule: Rule, sym: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
    """What is sent of seeds at `at` in contexts [lo, hi); place: theirs in their texts."""
    v = np.zeros(len(at), rule.stretch)
    d = digests(sym, at, at + rule.seed, np.dtype([("h", "<u8"), ("x", "<u8")]))
    v["h"], v["x"], v["at"], v["nl"], v["nr"] = d["h"], d["x"], place, at - lo, hi - at - rule.seed
    j = np.arange(rule.reach)
    last = max(0, len(sym) - 1)
    v["l"] = sym[np.clip(at[:, None] - 1 - j, 0, last)] * (j < v["nl"][:, None])
    v["r"] = sym[np.clip(at[:, None] + rule.seed + j, 0, last)] * (j < v["nr"][:, None])
    return v


def extended(rule: Rule, parts: int) -> Callable:
    """A shard's texts and verdicts to settled runs, contexts to be extended, and windows of common seeds."""

    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        if not texts.num_rows or not verdicts.num_rows:
            return blobs([])
        key, ids = _columns(texts)
        sent = ids if rule.smaller else None
        v, first, last = by_text(key, verdicts, VERDICT)
        out: list[tuple] = []
        held: list[tuple] = []
        for a, b, buf, offsets in slices(texts.column("text")):
            count = last[a:b] - first[a:b]
            if not count.any():
                continue
            sym, o = symbols(rule, buf, offsets)
            doc, told = np.repeat(np.arange(b - a), count), v[ragged(first[a:b], count)]
            at = told["at"].astype(np.int64) + o[doc]
            lo, hi = np.maximum(at - rule.reach, o[doc]), np.minimum(at + rule.length, o[doc + 1])
            settled = (told["f"] & SETTLED) > 0
            d, s, e = runs_of(spread(lo[settled], hi[settled], len(sym)), o)
            r = np.zeros(len(s), RUN)
            r["a"], r["b"] = s - o[d], e - o[d]
            out += packed(TOLD, key[d + a] % parts, d + a, r, key)
            whole = ((told["f"] & EXTEND) > 0) & ((told["f"] & COMMON) == 0)
            w = stretches(rule, sym, at[whole], lo[whole], hi[whole], told["at"][whole])
            out += packed(ENTRIES, (w["h"] % np.uint64(parts)).astype(np.int64), doc[whole] + a, w, key, sent)
            single = (told["f"] & (EXTEND | COMMON)) == EXTEND | COMMON
            if single.any():
                open_ = np.flatnonzero(spread(lo[single], hi[single] - rule.length + 1, len(sym)))
                d = np.searchsorted(o, open_, "right") - 1
                of, mine = np.unique(d, return_inverse=True)  # only these texts
                size = o[of + 1] - o[of]
                part = sym[ragged(o[of], size)]
                where = open_ - o[d] + (np.cumsum(size) - size)[mine]
                other = mixed(part.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
                held.append((wide_windows(part, rule.length)[where], (wide_windows(other, rule.length)[where] >> np.uint64(32)).astype(np.uint32), open_ - o[d], d + a))
        if held:
            h, x, at, doc = (np.concatenate(k) for k in zip(*held, strict=True))
            g, count = groups(h, x)
            repeat, delegate = judged(rule, g, count, ids[doc], np.ones(len(g), np.int64))
            r = np.zeros(int(repeat.sum()), RUN)
            r["a"], r["b"] = at[repeat], at[repeat] + rule.length
            out += packed(TOLD, key[doc[repeat]] % parts, doc[repeat], r, key)
            w = np.zeros(int(delegate.sum()), WINDOW)
            w["h"], w["x"], w["at"], w["m"] = h[delegate], x[delegate], at[delegate], np.where(repeat[delegate], 2, 1)
            out += packed(WINDOWS, (h[delegate] % np.uint64(parts)).astype(np.int64), doc[delegate], w, key, sent)
        return blobs(out)

    return run


def joined_contexts(rule: Rule, parts: int) -> Callable:
    """A bucket of contexts, or of windows, to runs by shard; runs pass."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.column("kind")[0].as_py() if t.num_rows else TOLD
        if kind == TOLD:
            return t
        if kind == WINDOWS:
            key, ids, doc, w = unpacked(t, WINDOW)
            g, count = groups(w["h"], w["x"])
            repeat, _ = judged(rule, g, count, ids[doc], w["m"])
            r = np.zeros(int(repeat.sum()), RUN)
            r["a"] = w["at"][repeat]
            r["b"] = r["a"] + rule.length
            return blobs(packed(TOLD, key[doc[repeat]] % parts, doc[repeat], r, key))
        key, ids, doc, w = unpacked(t, rule.stretch)
        rows, first, last = repeated_windows(groups(w["h"], w["x"])[0], w["l"], w["nl"], w["r"], w["nr"], ids[doc] if rule.smaller else None)
        r = np.zeros(len(rows), RUN)
        r["a"], r["b"] = w["at"][rows] - last, w["at"][rows] - first + rule.length
        return blobs(packed(TOLD, key[doc[rows]] % parts, doc[rows], r, key))

    return run


def kept(rule: Rule) -> Callable:
    """A shard's texts and runs to the result."""

    def run(texts: pa.Table, runs: pa.Table) -> pa.Table:
        r, first, last = by_text(_columns(texts)[0], runs, RUN)
        ra, rb = r["a"].astype(np.int64), r["b"].astype(np.int64)
        size, spans, rest = [], [], []
        for a, b, buf, offsets in slices(texts.column("text")):
            raw = buf.tobytes()
            o = offsets if rule.bytewise else words(buf, offsets, NOT_SPACE)[2]
            n = int(o[-1])
            count = last[a:b] - first[a:b]
            which, base = ragged(first[a:b], count), np.repeat(o[:-1], count)
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, ra[which] + base, 1)
            np.add.at(change, rb[which] + base, -1)
            gone = np.cumsum(change[:n]) > 0
            d, s, e = runs_of(gone, o)
            of = np.searchsorted(d, np.arange(b - a + 1))
            for i in range(b - a):
                text = raw[offsets[i] : offsets[i + 1]]
                got = [(int(x - o[i]), int(y - o[i])) for x, y in zip(s[of[i] : of[i + 1]], e[of[i] : of[i + 1]], strict=True)]
                part = text if rule.bytewise else text.split()
                for x, y in reversed(got):
                    part = part[:x] + part[y:]
                size.append(int(o[i + 1] - o[i]))
                spans.append([{"start": x, "end": y} for x, y in got])
                rest.append(part if rule.bytewise else b" ".join(part))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        rest = pa.array(rest, pa.binary())
        return pa.table([texts.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, kind), rest], ["doc_id", "n", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """A row per row of docs: doc_id, n (symbols), spans (removed runs of symbols: start, end), kept (binary).

    A null text has no symbols. A null id counts as larger than any other. Rows are told apart by id and text: rows
    that repeat both are equal copies. An empty table gives an empty result; other columns of docs are ignored.
    """
    spark = docs.sparkSession
    short_batches(spark)
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # as stored; unknown is very large
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // (PART_MB << 20)) if stored < 1 << 60 else 0)
    text, ident = F.col(text_col), F.col(id_col).cast("long")
    docs = docs.select(ident.alias("doc_id"), F.coalesce(ident, F.lit((1 << 63) - 1)).alias("id"), row_key(id_col, text_col).alias("key"), text.alias("text"))
    docs = docs.withColumn("shard", F.pmod("key", F.lit(parts)).cast("int"))  # both groupings below are of this frame, so that its exchange is used twice
    told = docs.mapInArrow(seed_entries(rule, parts), BLOB).groupBy("kind", "part").applyInArrow(joined_seeds(rule, parts), BLOB)
    runs = docs.groupBy("shard").cogroup(told.groupBy("part")).applyInArrow(extended(rule, parts), BLOB)
    runs = runs.groupBy("kind", "part").applyInArrow(joined_contexts(rule, parts), BLOB)
    return docs.groupBy("shard").cogroup(runs.groupBy("part")).applyInArrow(kept(rule), "doc_id long, n long, spans array<struct<start: long, end: long>>, kept binary")

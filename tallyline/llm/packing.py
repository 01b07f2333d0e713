"""Best-fit packing into sequences of fixed length by exact-complement hashing.

Only the histogram of piece lengths, at most one row per length, reaches the driver. There the gap that a longest
piece leaves is filled exactly by a single, pair or triple of lengths looked up among the sums that are available;
what no combination completes takes the best fit. Each choice is made for as many sequences at once as the counts
allow, so the plan has a few thousand runs however many pieces there are. Pieces find their place by their rank among
pieces of the same length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._bytes import blocks, joined, ragged, slices
from tallyline.llm._frames import running_total, short_batches, table, written

CAPACITY = 1024
END = 2
#: Pieces of one length that one task sorts: fewer on small tables, so that these spread over all partitions as well.
CELL_ROWS, LEAST_ROWS = 2_000, 64
#: Slots of a worker's cache of encoded units, and the longest unit that it takes, in blocks of eight bytes.
SLOTS, UNIT = 1 << 20, 3
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of many texts at once, equal to the tokenizer's own.

    The byte-level pre-tokenizer always splits before a single space between two visible characters, after a run of
    letters, and on both sides of a lone line feed between visible characters, so a text's ids are those of its units, split
    there. A direct-mapped cache of fixed size keeps short units, whole, and their ids; units that it lacks are encoded
    together, one call a slice. A text that holds an added token's string, which the tokenizer takes out before it splits, is
    one unit. literal: such strings are ordinary text instead.
    """

    def __init__(self, path: str, literal: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal
        self.added = [] if literal else [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab(with_added_tokens=False)
        self.spaced = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        for s, i in vocab.items():
            self.spaced[i] = s.startswith("Ġ")
        self.clear()
        # Visible beyond doubt: ASCII beyond the space, and leads of two-byte and longer characters that hold no white space.
        self.first = np.zeros(256, bool)
        self.first[[*range(0x21, 0x7F), *range(0xC3, 0xE0), *range(0xE4, 0xF5)]] = True
        self.ascii = np.zeros(256, bool)
        self.ascii[0x21:0x7F] = True
        self.two = np.zeros(256, bool)
        self.two[0xC3:0xE0] = True
        self.letter = np.zeros(256, bool)
        self.letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
        self.wide = np.zeros(256, bool)  # leads of two-byte letters, but for two signs that begin with 0xC3
        self.wide[0xC3:0xC9] = True

    def clear(self) -> None:
        self.key = np.zeros((UNIT, SLOTS), np.uint64)
        self.size = np.full(SLOTS, -1, np.int32)
        self.off = np.zeros(SLOTS, np.int64)
        self.len = np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, new: np.ndarray) -> int:
        at = self.used
        if at + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(max(len(self.ids), len(new)), np.uint32)])
        self.ids[at : at + len(new)] = new
        self.used += len(new)
        return at

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tok.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts at offsets, and the texts' offsets among them."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > 1 << 22:
            self.clear()
        prev_ok = np.zeros(n + 1, bool)  # of the byte before each place
        prev_ok[1:] = self.ascii[buf]
        prev_ok[2:] |= (buf[1:] >= 0x80) & self.two[buf[:-1]]
        next_ok = np.zeros(n, bool)
        next_ok[:-1] = self.first[buf[1:]]
        cut = (buf == 0x20) & prev_ok[:-1] & next_ok
        prev_letter = np.zeros(n, bool)
        prev_letter[1:] = self.letter[buf[:-1]]
        prev_letter[2:] |= self.wide[buf[:-2]] & (buf[1:-1] >= 0x80) & ~((buf[:-2] == 0xC3) & ((buf[1:-1] == 0x97) | (buf[1:-1] == 0xB7)))
        line = buf == 0x0A
        cut |= prev_letter & (buf < 0x80) & ~self.letter[buf]
        cut |= line & prev_ok[:-1]
        cut[1:] |= line[:-1] & prev_ok[:-2] & self.letter[buf[1:]]
        regular = cut & (buf == 0x20) & next_ok  # where a unit that may be joined to others begins
        raw = buf.tobytes()
        for added in self.added:
            at = raw.find(added)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, "right")) - 1
                cut[offsets[doc] : offsets[doc + 1]] = False
                at = raw.find(added, int(offsets[doc + 1]))
        cut[offsets[:-1][offsets[:-1] < n]] = True
        regular[offsets[:-1][offsets[:-1] < n]] = False
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        spaces = np.zeros(n + 1, np.int64)
        np.cumsum(buf == 0x20, out=spaces[1:])
        joins = regular[starts] & prev_ok[ends] & (spaces[ends] - spaces[starts] == 1)
        size = ends - starts
        eight = blocks(buf)
        unit = np.zeros((UNIT, len(starts)), np.uint64)
        slot = size.astype(np.uint64)
        for j in range(UNIT):
            some = np.flatnonzero(size > 8 * j)
            short = np.uint64(8) * (np.uint64(8) - np.minimum(size[some] - 8 * j, 8).astype(np.uint64))
            unit[j, some] = eight[starts[some] + 8 * j] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> short)
            slot = joined(slot, unit[j])
        slot = (slot & np.uint64(SLOTS - 1)).astype(np.int64)
        hit = self.size[slot] == size
        for j in range(UNIT):
            hit &= self.key[j][slot] == unit[j]
        hit &= size <= 8 * UNIT
        off, length = self.off[slot], self.len[slot].astype(np.int64)
        if not hit.all():
            lack = np.flatnonzero(~hit)
            seen: dict[bytes, int] = {}
            back = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts[lack].tolist(), ends[lack].tolist(), strict=True)])
            one = lack[np.unique(back, return_index=True)[1]]
            o, ln = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
            j = np.flatnonzero(joins[one])
            if len(j):
                got = self._encode([b"".join([raw[a:b] for a, b in zip(starts[one[j]].tolist(), ends[one[j]].tolist(), strict=True)])])[0]
                begin = np.flatnonzero(self.spaced[got])
                if len(begin) == len(j) and begin[0] == 0:
                    o[j], ln[j] = self._add(got) + begin, np.diff(np.append(begin, len(got)))
                else:  # pragma: no cover - a unit that held a token of several words
                    joins[one[j]] = False
            r = np.flatnonzero(~joins[one])
            if len(r):
                for k, got in zip(r.tolist(), self._encode([raw[starts[i] : ends[i]] for i in one[r]]), strict=True):
                    o[k], ln[k] = self._add(got), len(got)
            off[lack], length[lack] = o[back], ln[back]
            keep = size[one] <= 8 * UNIT
            s = slot[one[keep]]
            self.key[:, s], self.size[s], self.off[s], self.len[s] = unit[:, one[keep]], size[one[keep]], o[keep], ln[keep]
        ids = self.ids[ragged(off, length)]
        total = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(length, out=total[1:])
        return ids, total[np.searchsorted(starts, offsets)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a Python worker, as loading a vocabulary takes a while."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end: int) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        tail = np.array([end], "<u4")
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b, buf, offsets in slices(texts):
                ids, at = enc.encode(buf, offsets)
                size = np.diff(at) + 1
                count = -(-size // capacity)
                first = size - (count - 1) * capacity
                doc = np.repeat(np.arange(b - a), count)
                piece = ragged(np.zeros(b - a, np.int64), count)
                start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, first[doc], capacity)
                ids = np.insert(ids, at[1:], tail).astype("<u4", copy=False)
                raw, begin = memoryview(ids.tobytes()), (at[:-1] + np.arange(b - a))[doc] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc + a)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class _Sums:
    """Which lengths are available, and which sums of two."""

    def __init__(self, counts: np.ndarray):
        self.n, self.c = counts, len(counts)
        self.refresh()

    def refresh(self) -> None:
        self.one = self.n > 0
        x = self.one.astype(np.int64)
        self.two = np.convolve(x, x)[: self.c] > 0

    def use(self, length: int, k: int) -> None:
        had = self.n[length] > 0
        self.n[length] -= k
        if had != (self.n[length] > 0):
            self.refresh()

    def _pair(self, g: int) -> tuple[int, ...] | None:
        b = np.arange((g + 1) // 2, g)
        ok = self.one[b] & self.one[g - b] & ((b * 2 != g) | (self.n[b] > 1))
        return (int(b[ok][-1]), g - int(b[ok][-1])) if ok.any() else None

    def exact(self, g: int) -> tuple[int, ...] | None:
        """A single, pair or triple of available lengths that sums to g, the longest first."""
        if self.n[g]:
            return (g,)
        if self.two[g] and (pair := self._pair(g)):
            return pair
        for a in np.flatnonzero(self.one[: max(0, g - 1)] & self.two[g - np.arange(max(0, g - 1))])[::-1].tolist():
            if 3 * a < g:
                break
            self.n[a] -= 1  # it can't stand in the rest as well, unless there is another
            self.one[a] = self.n[a] > 0
            rest = self._pair(g - a)
            self.n[a] += 1
            self.one[a] = True
            if rest:
                return (a, *rest)
        return None


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, last rank + 1, first sequence, copies a sequence, offset) and the number of sequences.

    The piece of a length with rank r of a run goes to sequence first + (r - first rank) // copies, at
    offset + length * ((r - first rank) % copies). A step completes a group of sequences or uses up a length.
    """
    n = np.zeros(capacity + 1, np.int64)
    for length, k in counts.items():
        n[length] = k
    s, given, runs, sequences = _Sums(n), np.zeros(capacity + 1, np.int64), [], 0

    def take(length: int, group: int, first: int, copies: int, offset: int) -> None:
        runs.append((length, int(given[length]), int(given[length]) + group * copies, first, copies, offset))
        given[length] += group * copies
        s.use(length, group * copies)

    for longest in range(capacity, 0, -1):
        while n[longest]:
            first, gap = sequences, capacity - longest
            s.use(longest, 1)  # the piece that is placed is no part of its own complement
            combo = (s.exact(gap) or s_best(s, gap)) if gap else ()
            s.use(longest, -1)
            need: dict[int, int] = {}
            for x in (longest, *combo):
                need[x] = need.get(x, 0) + 1
            group = min(int(n[x]) // k for x, k in need.items())
            offset = 0
            for x, k in sorted(need.items(), reverse=True):
                take(x, group, first, k, offset)
                offset += x * k
            sequences += group
    return runs, sequences


def s_best(s: _Sums, gap: int) -> tuple[int, ...]:
    """What fills a gap best when no single, pair or triple fills it: the longest fit, then again exact or best."""
    left, out = s.n.copy(), []
    while gap:
        fits = np.flatnonzero(left[: gap + 1])
        if not len(fits):
            break
        x = int(fits[-1])
        out.append(x)
        left[x] -= 1
        gap -= x
        probe = _Sums(left) if gap else None
        if probe and (rest := probe.exact(gap)):
            out += rest
            break
    return tuple(out)


def best_fit_pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids without special tokens, then `end`; a null or empty text is `end` alone. Documents longer
    than `capacity` are cut into pieces of that length, the first taking the remainder. Repeated rows are packed each
    on their own. An empty table gives an empty result; other columns of docs are ignored.
    """
    short_batches(docs.sparkSession)
    pieces = written(tokenized(docs, tokenizer, id_col, text_col, capacity, end))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = pack(counts, capacity)
    runs.sort()
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = min(CELL_ROWS, max(LEAST_ROWS, sum(counts.values()) // (8 * partitions)))
    cells = max([1, *(-(-k // cell) for k in counts.values())])
    ranked = running_total(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], F.lit(1), F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)), "rank")
    run = np.array(runs, np.int64).reshape(-1, 6)
    wide = int(run[:, 2].max(initial=0)) + 1
    starts = run[:, 0] * wide + run[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {k: np.asarray(batch.column(k)) for k in ("length", "rank")}
            r = run[np.searchsorted(starts, x["length"] * wide + x["rank"], "right") - 1]
            at = x["rank"] - r[:, 1]
            cols = [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 3] + at // r[:, 4]), pa.array(r[:, 5] + x["length"] * (at % r[:, 4]))], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long")).mapInArrow(place, PIECES + ", sequence_id long, offset long")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), byte_bpe())

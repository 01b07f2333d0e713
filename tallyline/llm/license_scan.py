"""License scans by a positional index of rare tokens.

Templates are well-known licence sentences and notices by name, base phrases among them. A first scan counts in how many
documents each word of their small vocabulary occurs. Of the licence words that a file holds, those of the highest idf are
looked up; each posting gives a place where a template would begin. Places on which several words agree, and all places for
the rarest word of a mandatory phrase, which is always looked up so that no phrase is missed, are verified word by word,
whole mandatory phrases above all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._bytes import LOWER, LOWER_ALNUM, slices, word_hashes, words
from tallyline.llm._frames import short_batches, table

# Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Label, sentence, mandatory phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("bsd", "released under the bsd 3 clause license", "bsd 3 clause"),
    ("bsd", "released under the bsd 2 clause license", "bsd 2 clause"),
    ("isc", "released under the isc license", "isc license"),
    ("mpl-2.0", "released under the mozilla public license version 2 0", "mozilla public license version 2 0"),
    ("apache-2.0", "released under the apache license 2 0", "apache license 2 0"),
    ("gpl-2.0", "released under the gnu gpl version 2", "gpl version 2"),
    ("gpl-3.0", "released under the gnu gpl version 3", "gpl version 3"),
    ("cc0-1.0", "released under cc0 1 0 universal", "cc0 1 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)
#: A file's licence words that are looked up, those of the highest idf; the share of all documents beyond which a word is too
#: common for that; the share of a template's weight that a match must hold.
LOOKUPS, COMMON, COVER = 8, 0.1, 0.7


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    must: tuple[int, int]  # first and last + 1 word of the mandatory phrase
    base: bool


def templates(base: dict[str, str] = BASE, extra: tuple = TEMPLATES) -> list[Template]:
    out = [Template(label, tuple(p.split()), (0, len(p.split())), True) for p, label in base.items()]
    for label, sentence, must in extra:
        w, m = sentence.split(), must.split()
        at = next(i for i in range(len(w)) if w[i : i + len(m)] == m)
        out.append(Template(label, tuple(w), (at, at + len(m)), False))
    return out


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class Vocabulary:
    """The words of all templates, a few hundred at most, found in texts by their hash."""

    def __init__(self, every: list[Template]):
        names = sorted({w for t in every for w in t.words}, key=_hash)
        self.index = {w: i for i, w in enumerate(names)}
        self.hashes = np.array([_hash(w) for w in names], np.uint64)

    def of(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number, or -1, and texts' offsets among the words."""
        low = LOWER[buf]
        s, e, o = words(low, offsets, LOWER_ALNUM)
        h = word_hashes(low, s, e)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1).astype(np.int16), o


def document_counts(vocabulary: Vocabulary) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.hashes) + 1, np.int64)  # the last counts documents
        for batch in batches:
            for a, z, buf, offsets in slices(batch.column("text")):
                v, o = vocabulary.of(buf, offsets)
                at = np.flatnonzero(v >= 0)
                doc = np.searchsorted(o, at, "right") - 1
                n[:-1] += np.bincount(np.unique(doc * len(n) + v[at]) % len(n), minlength=len(n))[:-1]
                n[-1] += z - a
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["word", "n"])

    return run


class Index:
    """Templates as rows of word numbers and idf weights, and postings of all their words."""

    def __init__(self, every: list[Template], vocabulary: Vocabulary, counts: np.ndarray):
        idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1e-3
        self.idf, self.common = idf, counts[:-1] > COMMON * counts[-1]
        wide = max(len(t.words) for t in every)
        self.every = every
        self.ids = np.full((len(every), wide), -2, np.int16)
        self.weight = np.zeros((len(every), wide))
        self.must = np.zeros((len(every), wide), bool)
        anchor, template, place, whole = [], [], [], []
        for k, t in enumerate(every):
            ids = [vocabulary.index[w] for w in t.words]
            self.ids[k, : len(ids)] = ids
            self.weight[k, : len(ids)] = idf[ids] / idf[ids].sum()
            self.must[k, t.must[0] : t.must[1]] = True
            inside = sorted(range(*t.must), key=lambda i: (-idf[ids[i]], i))
            for i in range(len(ids)):
                anchor.append(ids[i]), template.append(k), place.append(i), whole.append(i == inside[0])
        order = np.argsort(anchor, kind="stable")
        self.anchor, self.template, self.place, self.whole = (np.array(x)[order] for x in (anchor, template, place, whole))
        self.first = np.searchsorted(self.anchor, np.arange(len(vocabulary.hashes) + 1))
        self.always = np.isin(np.arange(len(vocabulary.hashes)), self.anchor[self.whole])

    def looked_up(self, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Flags the licence words (doc, word) that are looked up."""
        n = len(self.idf)
        held, back = np.unique(doc * n + word, return_inverse=True)
        d, w = held // n, held % n
        order = np.lexsort((w, -np.where(self.common[w], -1, self.idf[w]), d))
        d = d[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(d, d)
        return ((rank < LOOKUPS) & ~self.common[w] | self.always[w])[back]

    def matches(self, v: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of verified places: text, template, first word in its text, share of weight, and whether the phrase is whole."""
        hit = np.flatnonzero(v >= 0)
        doc = np.searchsorted(o, hit, "right") - 1
        asked = self.looked_up(doc, v[hit].astype(np.int64))
        hit, doc = hit[asked], doc[asked]
        count = (self.first[1:] - self.first[:-1])[v[hit]]
        at = np.repeat(self.first[v[hit]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        template, start, doc = self.template[at], np.repeat(hit, count) - self.place[at], np.repeat(doc, count)
        wide, n = self.ids.shape[1], len(self.every)
        span = len(v) + 2 * wide
        key, back, votes = np.unique((doc * n + template) * span + start + wide, return_inverse=True, return_counts=True)
        sure = np.bincount(back, self.whole[at], len(key)) > 0
        key = key[sure | (votes > 1)]
        doc, template, start = key // span // n, key // span % n, key % span - wide
        place = start[:, None] + np.arange(self.ids.shape[1])
        inside = (place >= o[doc][:, None]) & (place < o[doc + 1][:, None])
        same = inside & (np.append(v, -1)[np.clip(place, 0, len(v))] == self.ids[template])
        share = (same * self.weight[template]).sum(axis=1)
        whole = (same | ~self.must[template]).all(axis=1)
        return doc, template, start - o[doc], share, whole


def scanner(index: object) -> Callable:
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, ix = index.value
        base = np.array([t.base for t in ix.every])
        for batch in batches:
            for a, z, buf, offsets in slices(batch.column("text")):
                v, o = vocabulary.of(buf, offsets)
                doc, template, start, share, whole = ix.matches(v, o)
                ok = whole & (base[template] | (share >= COVER))
                doc, template, start, share = doc[ok], template[ok], start[ok], share[ok]
                m = z - a
                b = base[template]
                n = np.bincount(doc[b], minlength=m)
                first, last = np.full(m, 1 << 62), np.full(m, -1)
                np.minimum.at(first, doc[b], start[b])
                np.maximum.at(last, doc[b], start[b])
                score = np.zeros(m)
                np.maximum.at(score, doc, np.minimum(share, 1.0))
                found: list[list] = [[] for _ in range(m)]
                for d, k, s in zip(doc.tolist(), template.tolist(), start.tolist(), strict=True):
                    found[d].append((k, s))
                labels = [",".join(sorted({ix.every[k].label for k, _ in f})) for f in found]
                own = [",".join(sorted({ix.every[k].label for k, _ in f if base[k]})) for f in found]
                places = [[{"label": ix.every[k].label, "start": s, "end": s + len(ix.every[k].words)} for k, s in f] for f in found]
                none = n == 0
                kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, m), pa.array(np.diff(o)), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(own, pa.string()), pa.array(labels, pa.string()), pa.array(score), pa.array(places, kind)], names)

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE, extra: tuple = TEMPLATES) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words are runs of a-z, 0-9 and characters beyond ASCII in the lower-cased (A-Z) text; a null text is empty. Every
    place of a base phrase counts, overlapping ones too. Other templates count where their mandatory phrase stands
    whole and words of COVER of their weight match. score is the best share of weight; 0, no labels ('') and null
    places in words if nothing was found. Repeated rows are scanned alike; an empty table gives an empty result; other
    columns are ignored.
    """
    short_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = templates(base, extra)
    vocabulary = Vocabulary(every)
    counted = docs.select("text").mapInArrow(document_counts(vocabulary), "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(vocabulary.hashes) + 1)
    for r in counted.collect():  # a row per word of the vocabulary
        counts[r["word"]] = r["n"]
    index = spark.sparkContext.broadcast((vocabulary, Index(every, vocabulary, counts)))
    return docs.mapInArrow(scanner(index), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label: string, start: long, end: long>>")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places").withColumn("score", F.round("score", 6))


def sql() -> str:
    """The same: places of whole mandatory phrases, and the share of their templates' idf that matches there."""
    listed = lambda w: "[" + ", ".join(f"'{x}'" for x in w) + "]"
    rows = ", ".join(f"('{t.label}', {listed(t.words)}, {listed(t.words[slice(*t.must)])}, {t.must[0]}, {t.base})" for t in templates())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT row_number() OVER () AS k, * FROM (VALUES {rows}) v(label, words, must, skip, base)),
v AS (SELECT DISTINCT unnest(words) AS word FROM t),
f AS (SELECT x.word, count(*) AS df FROM (SELECT r, unnest(list_distinct(w)) AS word FROM d) x GROUP BY x.word),
idf AS (SELECT v.word, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(df, 0))) + 1e-3 AS idf FROM v LEFT JOIN f ON v.word = f.word),
p AS (SELECT t.k, unnest(range(0, len(words))) AS j, unnest(words) AS word FROM t),
u AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
m AS (SELECT u.r, t.k, t.label, t.base, u.i - t.skip AS start, u.w FROM u JOIN t ON u.word = t.must[1] WHERE u.w[u.i:u.i + len(t.must) - 1] = t.must),
s AS (SELECT m.r, m.k, m.label, m.base, m.start, sum(CASE WHEN m.start + p.j >= 1 AND m.w[m.start + p.j] = p.word THEN idf ELSE 0 END) / sum(idf) AS share
  FROM m JOIN p ON m.k = p.k JOIN idf ON p.word = idf.word GROUP BY m.r, m.k, m.label, m.base, m.start),
g AS (SELECT r, count(*) FILTER (base) AS n, min(start) FILTER (base) - 1 AS a, max(start) FILTER (base) - 1 AS z, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS own, string_agg(DISTINCT label, ',' ORDER BY label) AS every, max(least(share, 1.0)) AS best
  FROM s WHERE base OR share >= {COVER} GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(own, '') AS base_labels, coalesce(every, '') AS labels, round(coalesce(best, 0.0), 6)::DOUBLE AS score FROM d LEFT JOIN g ON d.r = g.r
"""

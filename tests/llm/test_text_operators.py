"""License scan, language ID, quality, packing, exact dedup, mixing, search, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import license_scan, packing, quality, topk_search
from tallyline.llm.exact_dedup import exact_dedup
from tallyline.llm.language_id import BITS, PENALTY, held_out_fifth, language_id, language_model, op6_language_id
from tallyline.llm.mixing import mix, op8_mix_sources
from tallyline.llm.quality import op10_quality_classifier, quality_scores

SF = "/root/testdata/sf0.01"


# License scan ---------------------------------------------------------------------------------------------------


def scan(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for p, label in license_scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def check_scan(df, rows):
    want = sorted([(i, *scan(t)) for i, t in rows], key=str)
    have = df.collect()
    assert sorted([tuple(r)[:6] for r in have], key=str) == want
    assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in have)
    return have


def test_license_scan(spark, awkward):
    check_scan(license_scan.license_scan(awkward), [(r["doc_id"], r["text"]) for r in awkward.collect()])
    texts = ["Licensed under CC BY-NC 4.0.", "CC by cc BY cc", "all rights\nreserved ALL RIGHTS RESERVED", "cc b", "xcc by", "Licensed under the Apache License, Version 2.0!", "the GNU general public license general public license version 3", "cc", ""]
    rows = list(enumerate(texts))
    have = {r["doc_id"]: r for r in check_scan(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)), rows)}
    assert have[0]["labels"] == "cc-by,cc-by-nc-4.0" and have[5]["labels"] == "apache-2.0" and have[5]["score"] == pytest.approx(1)


def test_license_lines_of_the_tables(spark, nothing):
    """Every licence line gets its label; licences by name count, their words elsewhere don't."""
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "All rights reserved.": "reserved", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "Released under the BSD License": "bsd", "Released under the BSD 3-Clause License": "bsd", "Released under the ISC License": "isc", "the license of MIT was released under no name": ""}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    df = docs.union(spark.createDataFrame([(10**9 + i, f"some words before\n{t}\nand after") for i, t in enumerate(lines)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in license_scan.license_scan(df).collect()}
    assert [got[10**9 + i]["labels"] for i in range(len(lines))] == list(lines.values())
    for r in docs.collect():
        for line, label in lines.items():
            if label and line in (r["text"] or ""):
                assert set(label.split(",")) <= set(got[r["doc_id"]]["labels"].split(",")), (r["doc_id"], line)
    assert license_scan.license_scan(nothing).count() == 0


def test_license_phrases_among_many_rare_words(spark):
    """A file that holds more licence words than are looked up loses no phrase."""
    every = " ".join(sorted({w for t in license_scan.templates() for w in t.words}))
    rows = [(1, f"{every} {every} general public license {every} all rights reserved"), (2, "plain " * 50), (3, None)] + [(10 + i, "the of and") for i in range(20)]
    check_scan(license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")), rows)


def test_license_scan_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_scan(license_scan.op1_license_scan(spark, SF), rows)


# Language ID and quality ----------------------------------------------------------------------------------------


def test_language_id(spark, awkward, nothing):
    rows = [(i, f"{'der die und ein' if i % 2 else 'the of and one'} {i} nicht" if i % 2 else f"the house of the king and queen {i}", "de" if i % 2 else "en") for i in range(200)]
    rows += [(1000, None, "de"), (1001, "12 34 —", "en"), (1002, "the king and the queen of the house", None), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id(df, held_out_fifth()).collect()}
    assert all(got[i]["lang_pred"] == ("de" if i % 2 else "en") for i in range(200))
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "en", "und"]
    assert got[1000]["score"] == 0 and got[5]["held_out"] == (zlib.crc32(b"5") % 5 == 0)
    assert language_id(awkward, held_out_fifth()).count() == awkward.count()
    assert language_id(nothing, held_out_fifth()).count() == 0
    assert {r["lang_pred"] for r in language_id(awkward.withColumn("lang", F.lit(None).cast("string")), held_out_fifth()).collect()} == {"und"}


def plain_mixture(text, logs):
    """Proportions of the chosen set, by slow estimation in doubles, from the log likelihoods of slots."""
    raw = text.encode()
    words_, ll = re.findall(rb"[A-Za-z\x80-\xff]+", raw), []
    for w in re.finditer(rb"[A-Za-z\x80-\xff]+", raw):
        b = bytes([32]) + bytes(c + 32 if 65 <= c <= 90 else c for c in w.group()) + bytes([32])
        slots = [((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 0x9E3779B1 % 2**32) >> (32 - BITS) for i in range(1, len(b) - 1)]
        ll.append(logs[:, slots].astype(float).sum(axis=1))
    x = np.exp(np.array(ll) - np.array(ll).max(axis=1)[:, None])
    price = PENALTY * 0.5 * np.log(max(len(words_), 2))

    def fit(allowed):
        p = np.where(allowed, 1.0, 0) / allowed.sum()
        for _ in range(2000 if allowed.sum() > 1 else 0):
            j = p * x
            p = (j / j.sum(axis=1)[:, None]).mean(axis=0)
        return p, np.log((p * x).sum(axis=1)).sum()

    order = np.argsort(-fit(np.ones(len(logs), bool))[0], kind="stable")
    best = None
    for m in range(1, len(logs) + 1):
        allowed = np.zeros(len(logs), bool)
        allowed[order[:m]] = True
        p, score = fit(allowed)
        if best is None or score - m * price > best[0]:
            best = (score - m * price, p)
    return best[1]


def test_mixtures_match_plain_estimation(spark):
    """Five languages, and texts of one to five of them, ties and single words among them."""
    r = random.Random(8)
    tongues = {f"l{k}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyzäöéß"[5 * k : 5 * k + 9]) for _ in range(r.randint(2, 9))) for _ in range(60)] for k in range(5)}
    rows = [(i, " ".join(r.choices(tongues[f"l{i % 5}"], k=40)), f"l{i % 5}") for i in range(60)]
    for i in range(60):
        some = r.sample(sorted(tongues), i % 5 + 1)
        rows.append((100 + i, " ".join(w for s in some for w in r.choices(tongues[s], k=r.randint(1, 90))), None))
    rows += [(300, "a", None), (301, "zz Zz ZZ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, logs = language_model(df.filter("lang is not null"))
    got = {r["doc_id"]: r for r in language_id(df, F.lit(False)).collect()}
    several = 0
    for i, text, _ in rows:
        want = plain_mixture(text, logs)
        have = np.array([got[i]["proportions"].get(x, 0.0) for x in langs])
        assert np.abs(have - want).max() < 0.03 and ((have > 0.03) == (want > 0.03)).all(), (i, have, want)
        assert got[i]["lang_pred"] == langs[int(np.argmax(have))] and got[i]["score"] == have.max()
        several += (want > 0).sum() > 3
    assert several > 3


def test_mixture_proportions(spark):
    """A text in two languages keeps both, in about the right shares."""
    a, b = ["alpha", "gamma", "lambda", "sigma", "omega"], ["krk", "vlk", "smrt", "prst", "hrb"]
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(a if i % 2 else b, k=30)), "x" if i % 2 else "y") for i in range(40)]
    rows.append((99, " ".join(r.choices(a, k=60) + r.choices(b, k=40)), None))
    got = {r["doc_id"]: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(False)).collect()}
    assert got[99]["lang_pred"] == "x" and got[99]["proportions"]["y"] == pytest.approx(0.4, abs=0.05)
    assert len(got[1]["proportions"]) == 1


def test_language_ties(spark):
    """Languages that a text fits equally well: the first by code point."""
    rows = [(i, "same words for both", lang) for i, lang in enumerate(["zz", "aa", "zz", "aa"])] + [(9, "same words", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id(df, F.lit(False)).collect()} == {"aa"}


def test_quality_ties_and_clashing_columns(spark):
    """Two labels of a row that cancel out count as good; other columns, whatever their names, change nothing."""
    rows = [(i, f"good words {i}" if i % 2 else f"bad stuff {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, i % 2) for i in range(20)]
    one = quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(False)).orderBy("doc_id").collect()
    twice = [(i, 0) for i, y in labels if y] + [(i, 1) for i, y in labels if y] + [(i, y) for i, y in labels if not y]
    clash = docs.selectExpr("*", "doc_id as k", "text as h", "1 as y", "2 as i", "true as held_out", "0.5 as score")
    two = quality_scores(clash, spark.createDataFrame(twice, "doc_id long, quality int"), F.lit(False)).orderBy("doc_id").collect()
    assert [r["score"] for r in one] == [r["score"] for r in two]
    assert all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in one)


def test_language_id_held_out_accuracy(spark):
    got = op6_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() / got.count() > 0.97


def test_quality_held_out_accuracy(spark):
    got = op10_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95


def test_quality_matches_plain_updates(spark):
    """Scores against updates of follow-the-regularised-leader written out per coordinate."""
    r = random.Random(6)
    good, bad = ["clear", "Well", "made", "prose", "12"], ["BUY", "now", "!!!", "now", "x9"]
    rows = [(i, " ".join(r.choices(good if i % 2 else bad, k=r.randint(1, 12))), i % 2) for i in range(80)] + [(200, "", 1), (201, None, 0)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i != 7], "doc_id long, quality int")
    held = F.col("doc_id") % 4 == 3
    got = {x["doc_id"]: x for x in quality_scores(docs, labels, held).collect()}
    hashes = {x["doc_id"]: x["h"] for x in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}

    def example(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        slots, values, _ = quality.features(raw, np.array([0, len(raw)]))
        x = {}
        for i, v in zip(slots.tolist(), values.tolist(), strict=True):
            x[i] = x.get(i, 0.0) + v
        return {i: float(np.float32(v)) for i, v in x.items()} | {quality.SLOTS: 1.0}

    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for i, text, y in sorted([x for x in rows if x[0] % 4 != 3 and x[0] != 7], key=lambda x: hashes[x[0]]):
            x = example(text)
            w = {k: weight(k) for k in x}
            p = 1 / (1 + np.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / quality.ALPHA
                z[k], n[k] = z.get(k, 0.0) + g - sigma * w[k], n.get(k, 0.0) + g * g
    for i, text, _ in rows:
        want = 1 / (1 + np.exp(-sum(weight(k) * v for k, v in example(text).items())))
        assert got[i]["score"] == pytest.approx(want, abs=1e-4) and got[i]["held_out"] == (i % 4 == 3)


def test_quality_features_are_plain_counts():
    """Each view of a text has as many n-grams as its words allow, and equal n-grams share a slot."""
    text = "One two two Three two two one"
    raw = np.frombuffer(text.encode(), np.uint8)
    slots, values, owners = quality.features(raw, np.array([0, len(raw)]))
    w = text.lower().split()
    views = [w, list(zip(w[:-1], w[1:], strict=True))]
    at = 0
    for v in views:
        mine = slots[at : at + len(v)]
        assert [[a == b for b in v] for a in v] == [[a == b for b in mine] for a in mine]
        at += len(v)
    repeats = sum(a == b for k in (1, 2, 3) for a, b in zip(w[:-k], w[k:], strict=True))
    assert len(slots) == 7 + 6 + 7 + 6 + 5 + repeats and np.allclose(values, 1 / 7) and not owners.any()


def test_quality_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (7, 0, 0), (7, 0, 1), (14, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_scores(awkward, labels, F.lit(False)).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality_scores(nothing, labels, F.lit(False)).count() == 0
    assert {r["score"] for r in quality_scores(awkward, labels.limit(0), F.lit(False)).collect()} == {0.5}


# Packing --------------------------------------------------------------------------------------------------------


def check_packing(got, rows, capacity=packing.CAPACITY):
    tok = Tokenizer.from_file(packing.byte_bpe())  # as the file says, with nothing set
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4")
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert not at or max(at.values()) <= capacity
    return len(at), sum(at.values()) / capacity


def test_packing(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Tokenizer.from_file(packing.byte_bpe()).encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    swap = str.maketrans("ab", "ba")
    morse = ["".join("ab"[bin(i).count("1") % 2] for i in range(k)) for k in (512, 1024, 2048, 4096)]
    odd = [f"{w} q0 q1" for a in morse for w in (a, a.translate(swap))]
    odd += ["<|endoftext|>", "a<|endoftext|>", "one two <|endoftext|>three  four\n\n<|endoftext|> five six", "<|endoftext", "a  b", " a b ", "x <|endoftext|> y", "é è  z", "don't  can't 12 34", "a \n\n b\t c", "日本 語", "a\x85 b", "　x  y", "×a÷ b", "a\n\nB"]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    df = awkward.select("doc_id", "text").union(extra)
    check_packing(packing.best_fit_pack(df, packing.byte_bpe()).collect(), rows + [(1000 + i, t) for i, t in enumerate(odd)])
    assert packing.best_fit_pack(nothing, packing.byte_bpe()).count() == 0


def test_packing_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n, least = check_packing(packing.op5_best_fit_packing(spark, SF).collect(), rows)
    assert n <= 1.02 * least + 1


def test_literal_added_tokens():
    enc = packing.Encoder(packing.byte_bpe(), literal=True)
    raw = np.frombuffer(b"x <|endoftext|> y", np.uint8)
    assert len(enc.encode(raw, np.array([0, len(raw)]))[0]) == 9


def test_a_piece_is_not_its_own_complement():
    assert packing.pack({500: 1, 24: 1, 400: 1, 76: 1}, 1000)[1] == 1
    assert packing.pack({50: 3}, 100)[1] == 2


@pytest.mark.parametrize("seed", range(4))
def test_pack_plans(seed):
    r = np.random.default_rng(seed)
    lengths = [r.integers(1, 101, 5000), np.minimum(100, r.lognormal(3, 1, 5000).astype(int) + 1), np.full(999, 30), r.integers(40, 60, 777)][seed]
    counts = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    runs, n = packing.pack(counts, 100)
    fill, seen = np.zeros(n, np.int64), {}
    for length, a, b, first, copies, _ in sorted(runs):
        assert a == seen.get(length, 0)
        seen[length] = b
        np.add.at(fill, first + np.arange(b - a) // copies, length)
    assert seen == counts and fill.max() <= 100 and fill.min() > 0
    if seed < 2:
        assert n <= 1.02 * lengths.sum() / 100 + 1


# Exact dedup and mixing -----------------------------------------------------------------------------------------


def test_exact_dedup(awkward, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t) for _, t in rows]
    want = []
    for (i, t), n in zip(rows, norm, strict=True):
        group = [(len(u), j) for (j, u), m in zip(rows, norm, strict=True) if m == n]
        best = min(group, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        want.append((i, best[1], len(group), (len(t), i) == best, hashlib.sha256(n.encode()).hexdigest()))
    for digest in (True, False):
        have = [tuple(r) for r in exact_dedup(awkward, digest=digest).collect()]
        assert sorted([r[:4] for r in have], key=str) == sorted([r[:4] for r in want], key=str)
        if digest:
            assert sorted(have, key=str) == sorted(want, key=str)
    assert exact_dedup(nothing).count() == 0


def shared(sizes, weights=(5, 2, 1), epochs=3):
    """Targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, target = set(names), sum(sizes.values()), {}
    while left:
        level = (total - sum(target.values())) / sum(w[s] for s in left)
        above = {s for s in left if level * w[s] > epochs * sizes[s]}
        if not above:
            return target | {s: level * w[s] for s in left}
        target |= {s: epochs * sizes[s] for s in above}
        left -= above
    return target


def check_mix(df, rows):
    got = df.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = shared(sizes)
    assert sorted([(r["doc_id"], r["size"], r["source_size"]) for r in got], key=str) == sorted([(i, size(t), sizes[s]) for i, t, s in rows], key=str)
    taken = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert [r["position"] for r in got if r["position"] is not None] == sorted(r["position"] for r in got if r["position"] is not None)
    return sorted(map(tuple, got), key=str)


def test_mix(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
    assert check_mix(mix(awkward), rows) == check_mix(mix(awkward.repartition(9)), rows)
    few = [(1, "a b c", "x"), (2, "a " * 1000, "y"), (3, "", "z"), (4, None, "z"), (5, "b " * 10, None), (6, "c", "v")]
    check_mix(mix(spark.createDataFrame(few, "doc_id long, text string, source string")), few)
    assert mix(nothing).count() == 0


def test_mix_query(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_mix(op8_mix_sources(spark, SF), rows)


# Search ---------------------------------------------------------------------------------------------------------


def plain_top(rows, k=5):
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in dict(sorted(fine, key=lambda r: (r[0], r[1]), reverse=True)).items():
        if i % 50 == 0:
            best = sorted([(-sum(a * b for a, b in zip(v, u, strict=True)), j) for j, u in fine if j != i])[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["unit", "spread", "alike", "few"])
def test_top_k(spark, shape, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 16)
    monkeypatch.setattr(topk_search, "BLOCK", 4)
    monkeypatch.setattr(topk_search, "PASS", 40)
    r = np.random.default_rng(1)
    n = 4 if shape == "few" else 400
    x = r.normal(size=(n, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if shape == "spread":
        x *= r.lognormal(0, 1.5, n)[:, None]
    if shape == "alike":
        x = np.repeat(x[:20], 20, axis=0) + r.normal(size=(n, 8)) * 0.01
    rows = [(i, x[i].tolist()) for i in range(n)] + [(0 if shape == "few" else 50, x[1].tolist()), (9000, None), (9050, [1.0, None] * 4), (9100, [float("inf")] * 8), (9150, [float("nan")] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()) == plain_top(rows)


def test_top_k_of_several_dimensions_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BUCKET", 8)
    monkeypatch.setattr(topk_search, "BLOCK", 2)
    r = np.random.default_rng(2)
    rows = [(10 * i, r.normal(size=[3, 8, 5][i % 3] if i % 7 else 8).tolist()) for i in range(60)] + [(50, []), (2000, [])]
    rows = [(*x, x[0] + 1, 2.5, "z", 7, 8) for x in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, d long, length double, v string, p int, is_query int").repartition(3)
    want = [x for n in (3, 5, 8) for x in plain_top([y[:2] for y in rows if len(y[1]) == n])]
    assert sorted(tuple(x) for x in topk_search.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_top_k_of_nothing(spark):
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0

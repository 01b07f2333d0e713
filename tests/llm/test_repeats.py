import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import repeats
from tallyline.llm.columns import repeated_windows
from tallyline.llm.repeats import Rule, without_repeats
from tallyline.llm.substring_dedup import op2_substring_dedup, substring_dedup
from tallyline.llm.suffix_dedup import op4_suffix_dedup, repeated_bytes


def brute(rows, length, bytewise, smaller):
    """(id, n, removed runs, kept) of every row, from a table of all windows."""
    seqs, top = [], 1 << 70
    for i, t in rows:
        raw = (t or "").encode()
        seqs.append((top if i is None else i, raw if bytewise else raw.split()))
    where = defaultdict(list)
    for i, s in seqs:
        for a in range(len(s) - length + 1):
            where[s[a : a + length] if bytewise else tuple(s[a : a + length])].append(i)
    least = {k: min(v) for k, v in where.items()}
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for a in range(len(s) - length + 1):
            k = s[a : a + length] if bytewise else tuple(s[a : a + length])
            if (least[k] < i) if smaller else (len(where[k]) > 1):
                gone[a : a + length] = [True] * length
        runs, a = [], 0
        while a < len(s):
            b = a
            while b < len(s) and gone[b] == gone[a]:
                b += 1
            if gone[a]:
                runs.append((a, b))
            a = b
        left = [x for x, g in zip(s, gone, strict=True) if not g]
        out.append((None if i == top else i, len(s), tuple(runs), bytes(left) if bytewise else b" ".join(left)))
    return sorted(out, key=str)


def got(df):
    return sorted([(r[0], r[1], tuple((s["start"], s["end"]) for s in r[2]), bytes(r[3])) for r in df.collect()], key=str)


@pytest.mark.parametrize("length,seed", [(13, 8), (13, 13), (5, 2)])
def test_words_match_brute_force(awkward, length, seed):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    df = substring_dedup(awkward, words=length, seed=seed).withColumn("kept", F.col("kept").cast("binary"))
    assert got(df) == brute(rows, length, False, True)


@pytest.mark.parametrize("length,seed", [(400, 300), (40, 10)])
def test_bytes_match_brute_force(awkward, length, seed):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(repeated_bytes(awkward, length=length, seed=seed)) == brute(rows, length, True, False)


@pytest.mark.parametrize("many,very", [(1, 2048), (16, 1), (1, 1)])
@pytest.mark.parametrize("length,seed,bytewise", [(40, 20, True), (13, 8, False)])
def test_common_seeds_match_brute_force(awkward, monkeypatch, many, very, length, seed, bytewise):
    monkeypatch.setattr(repeats, "MANY", many)
    monkeypatch.setattr(repeats, "VERY_MANY", very)
    monkeypatch.setattr(repeats, "FLUSH", 200)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(without_repeats(awkward, Rule(length, seed, bytewise, not bytewise), "doc_id", "text")) == brute(rows, length, bytewise, not bytewise)


@pytest.mark.parametrize("smaller", [False, True])
def test_columns_match_brute_force(smaller):
    r = np.random.default_rng(4)
    reach, n = 6, 400
    left, right = (r.integers(0, 2, (n, reach)).astype(np.uint8) for _ in range(2))
    nl, nr = (np.where(r.random(n) < 0.3, r.integers(0, reach, n), reach) for _ in range(2))
    group, ids = r.integers(0, 12, n), r.integers(0, 50, n)
    rows, first, last = repeated_windows(group, left, nl, right, nr, ids if smaller else None)
    have = {(i, k) for i, a, b in zip(rows.tolist(), first.tolist(), last.tolist()) for k in range(a, b + 1)}
    held = defaultdict(list)
    for i in range(n):
        for k in range(reach + 1):
            if nl[i] >= k and nr[i] >= reach - k:
                held[group[i], k, left[i, :k].tobytes(), right[i, : reach - k].tobytes()].append(i)
    want = {(i, key[1]) for key, v in held.items() for i in v if (ids[i] > min(ids[j] for j in v) if smaller else len(v) > 1)}
    assert have == want


def test_words_on_which_polynomials_modulo_two_to_the_64_collide(spark):
    swap = str.maketrans("ab", "ba")
    rows = []
    for k in (512, 1024, 2048, 4096):
        a = "".join("ab"[bin(i).count("1") % 2] for i in range(k))
        for w in (a, a.translate(swap)):
            rows.append((len(rows), f"{w} " + " ".join(f"q{k}x{i}" for i in range(12))))
            rows.append((len(rows) + 100, f"u{len(rows)} " * 3 + w[: k // 2] + " ".join(w[:40])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for rule in (Rule(13, 8, False, True), Rule(400, 300, True, False), Rule(3, 1, False, True)):
        assert got(without_repeats(df, rule, "doc_id", "text")) == brute(rows, rule.length, rule.bytewise, rule.smaller)


def test_nothing(nothing):
    assert substring_dedup(nothing).count() == 0
    assert repeated_bytes(nothing).count() == 0


def test_many_copies_meet_once_a_batch(spark):
    """A group of copies and a passage in every text, over many partitions."""
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(i, f"copy {passage} end") for i in range(300)] + [(300 + i, f"u{i} v{i} {passage} x{i} y{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert got(substring_dedup(df).withColumn("kept", F.col("kept").cast("binary"))) == brute(rows, 13, False, True)
    assert got(without_repeats(df, Rule(30, 20, True, False), "doc_id", "text")) == brute(rows, 30, True, False)


@pytest.mark.parametrize("query,length,bytewise", [(op2_substring_dedup, 13, False), (op4_suffix_dedup, 400, True)])
def test_queries_over_a_table(spark, query, length, bytewise):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, length, bytewise, not bytewise)
    have = sorted([tuple(r) for r in query(spark, sf).collect()], key=str)
    spans = lambda r: (len(r),) if bytewise else ()
    assert have == sorted([(i, n, sum(b - a for a, b in runs), *spans(runs), hashlib.sha256(k).hexdigest()) for i, n, runs, k in want], key=str)


@pytest.mark.parametrize("length,seed,bytewise", [(40, 20, True), (40, 10, True), (13, 8, False)])
def test_staggered_fragments_match_brute_force(spark, length, seed, bytewise):
    """Two texts share a passage and a third quotes a part of it, near the passage's end or not."""
    r = random.Random(7)
    unit = (lambda k: "".join(r.choice("abcdefgh") for _ in range(k))) if bytewise else (lambda k: [f"w{r.randrange(9000)}" for _ in range(k)])
    join = (lambda x: x) if bytewise else " ".join
    rows = []
    for k in range(300):
        passage = unit(r.randint(2 * length, 4 * length))
        size = length + r.randrange(length // 2)
        a = r.randint(0, len(passage) - size)
        parts = r.sample([passage, passage, passage[a : a + size]], 3)
        rows += [(3 * k + j, join(unit(length) + x + unit(length))) for j, x in enumerate(parts)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(without_repeats(df, Rule(length, seed, bytewise, not bytewise), "doc_id", "text")) == brute(rows, length, bytewise, not bytewise)

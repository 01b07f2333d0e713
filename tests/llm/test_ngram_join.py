import random

from tallyline.llm.ngram_join import bands, components, ngram_join, op3_ngram_jaccard_join


def brute(rows, n=5, similarity=0.8):
    """(id, class, n-grams, links, group) of every row, from all pairs."""
    top = 1 << 70
    items = []
    for i, t in rows:
        w = (t or "").encode().split()
        s = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        items.append((top if i is None else i, frozenset(s)))
    near = lambda a, b: bool(a) and bool(b) and len(a & b) >= similarity * len(a | b) - 1e-9
    out, group = [], list(range(len(items)))
    for x, (_, s) in enumerate(items):
        for y, (_, u) in enumerate(items[:x]):
            if near(s, u):
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]
    for x, (i, s) in enumerate(items):
        links = sum(near(s, u) for y, (_, u) in enumerate(items) if y != x)
        cls = min([j for j, u in items if u == s]) if s else i
        least = min(j for (j, _), g in zip(items, group, strict=True) if g == group[x])
        out.append(tuple(None if v == top else v for v in (i, cls, len(s), links, least)))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    if "representative" in df.columns:
        assert all(r["doc_id"] == r["group_id"] for r in rows if r["representative"])
        assert {r["group_id"] for r in rows} == {r["group_id"] for r in rows if r["representative"]}
    return sorted([tuple(r)[:5] for r in rows], key=str)


def test_awkward_rows(awkward):
    assert got(ngram_join(awkward)) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_nothing(nothing):
    assert ngram_join(nothing).count() == 0


def test_large_family_in_blocks(spark, monkeypatch):
    import tallyline.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 16)
    r = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"{i}u{j}" for j in range(50))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(ngram_join(df)) == brute(rows)


def test_chain_of_groups_in_blocks(spark, monkeypatch):
    """A family that chains groups of near copies: only blocks that a band ties meet, and no link is lost."""
    import tallyline.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK", 8)
    r = random.Random(11)
    rows, base = [], [f"b{i}" for i in range(100)]
    for g in range(12):  # each group's text shares most with the one before, and drifts away from the first
        for _ in range(8):
            base[r.randrange(100)] = f"g{g}x{r.randrange(9999)}"
        for _ in range(10):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.randrange(100)] = f"y{r.randrange(9999)}"
            rows.append((len(rows), " ".join(w)))
    assert got(ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_bands_reach_the_recall():
    b, r = bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 128


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50}


def thue_morse(n):
    return bytes(97 + bin(i).count("1") % 2 for i in range(n)).decode()


def test_words_on_which_polynomials_modulo_two_to_the_64_collide(spark):
    swap = str.maketrans("ab", "ba")
    rows = []
    for k in (512, 1024, 2048, 4096):
        a = thue_morse(k)
        rows += [(len(rows) + j, f"{w} " + " ".join(f"q{i}" for i in range(12))) for j, w in enumerate((a, a.translate(swap)))]
    words = thue_morse(4096)
    rows += [(20, " ".join(words)), (21, " ".join(words.translate(swap)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join(df)) == brute(rows)


def test_one_node_with_most_neighbours(spark):
    edges = [(1, i) for i in range(2, 3000)] + [(i, i + 5000) for i in range(2, 500)] + [(9000, 9001)]
    have = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert have == {i: 1 for i in [*range(1, 3000), *range(5002, 5500)]} | {9000: 9000, 9001: 9000}


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op3_ngram_jaccard_join(spark, sf)) == brute(rows)

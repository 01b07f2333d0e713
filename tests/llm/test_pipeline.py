"""The pipeline against plain versions of its stages."""

import re

import corpus_pipeline
from tests.llm.conftest import SCHEMA
from tests.llm.test_text_operators import check_packing, shared

WORDS = r"[^\x20\x09-\x0D]+"
TOP = 1 << 70


def order(i):
    return TOP if i is None else i


def plain_kept(rows):
    """(doc_id, text, source) after language ID, exact and near dedup."""
    rows = list(dict.fromkeys(r for r in rows if re.search(r"[^\W\d_]", r[1] or "")))
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r[1]), []).append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), order(r[0]))) for g in groups.values()]
    sets = []
    for _, t, _ in rows:
        w = re.findall(WORDS, t)
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9 and group[x] != group[y]:
                a, b = group[x], group[y]
                group = [b if g == a else g for g in group]
    least = {}
    for r, g in zip(rows, group, strict=True):
        if g not in least or order(r[0]) < order(least[g][0]):
            least[g] = r
    return list(least.values())


def check(spark, docs, sf_dir):
    columns = docs.columns
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    docs = docs.cache()
    have = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    assert sorted(have, key=str) == sorted(plain_kept(rows), key=str)
    check_mixed(spark, docs, sf_dir)


def check_mixed(spark, docs, sf_dir):
    have = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    sizes, taken, texts, most = {}, {}, {}, {}
    for i, t, s in have:
        own = re.findall(WORDS, t or "")
        sizes[s] = sizes.get(s, 0) + len(own)
        texts.setdefault((i, s), []).append(own)
        most[i, s] = most.get((i, s), 0) + 3 * len(own)
    out = mixed.collect()
    for r in out:
        got = re.findall(WORDS, r["text"])
        assert got and any(got == own[: len(got)] for own in texts[r["doc_id"], r["source"]])
        assert r["n_chars"] == len(r["text"])
        taken[r["source"]] = taken.get(r["source"], 0) + len(got)
        most[r["doc_id"], r["source"]] -= len(got)
    target = shared(sizes)
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in sizes) and min(most.values(), default=0) >= 0
    check_packing(corpus_pipeline.pack_sequences(spark, mixed, sf_dir).collect(), [(r["doc_id"], r["text"]) for r in out])
    return out


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def test_awkward_rows(spark, awkward):
    """Null and repeated ids, repeated rows, and columns that the stages use themselves."""
    clash = awkward.selectExpr("*", "id as s", "id as position", "text as row", "1 as size", "'x' as passes", "2 as k", "3 as _row_key", "4 as pass")
    check(spark, clash, "")


def test_mix_of_repeated_ids(spark):
    """Each text of an id is mixed by its own size, and each time it is due stands at its own place."""
    rows = [(1, "a b c d", "en", "x", 7), (1, "w1 x1", "en", "x", 5), (1, "w1 x1", "en", "x", 5), (None, "n1 n2", None, "x", None), (2, "b " * 400, "en", "y", 800), (3, None, None, None, None), (4, "", "en", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = check_mixed(spark, docs, "")
    texts = [r["text"] for r in out if r["source"] == "x"]
    assert len(texts) == 12 and any(a != b for a, b in zip(texts[:4], sorted(texts)[:4], strict=True))
    assert sorted(texts[:4]) == sorted(texts[4:8]) == sorted(texts[8:])  # one pass after another


def test_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and corpus_pipeline.ORACLE_SQL is None

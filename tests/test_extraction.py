"""Lines, ruled tables, roles, items and the sweep over hand-made pages."""

from pyspark.sql import functions as F

from tallyline.operators.extraction import column_items, detect_types, line_notices, nearest_items, page_context, read_documents, split_party_counsel
from tallyline.operators.layout import cells, centres, completed, lines, regimes

PAGES = "file string, page int, width double, height double, was_ocr boolean"
SPANS = "file string, page int, ord long, x double, y double, w double, text string"


def spans_of(rows, file="f", page=1):
    return [(file, page, i, float(x), float(y), float(len(t) * 5), t) for i, (x, y, t) in enumerate(rows)]


def frames(spark, pages, spans, hs=(), vs=()):
    return (
        spark.createDataFrame(pages, PAGES),
        spark.createDataFrame(spans, SPANS),
        spark.createDataFrame(list(hs), "file string, page int, y double, x0 double, x1 double"),
        spark.createDataFrame(list(vs), "file string, page int, x double, y0 double, y1 double"),
    )


def test_lines_and_joins(spark):
    rows = [(10, 100, "M/s.K.S"), (45, 100, "a"), (50, 99, "nkaran"), (10, 80, "next"), (200, 78.5, "right"), (10, 60, " "), (10, 50, "lone")]
    _, s, _, _ = frames(spark, [], spans_of(rows))
    got = [(r["line"], r["text"]) for r in lines(s).orderBy("line").collect()]
    assert got == [(0, "M/s.K.Sankaran"), (1, "next right"), (2, "lone")]
    # The line's height moves to the middle of what it took, so steps of less than the tolerance can add up.
    _, s, _, _ = frames(spark, [], spans_of([(1, 10, "a"), (2, 8.2, "b"), (3, 7.2, "c"), (4, 4, "d")]))
    assert [r["text"] for r in lines(s).orderBy("line").collect()] == ["a bc", "d"]


def test_centres(spark):
    df = spark.createDataFrame([("f", 1, v) for v in (1.0, 2.0, 4.0, 10.0, 11.0)], "file string, page int, y double")
    assert sorted((r["centre"], r["members"]) for r in centres(df, ["file", "page"], "y").collect()) == [(7 / 3, 3), (10.5, 2)]


GRID_X = [20, 60, 160, 300, 440]


def grid(rows, skip=()):
    """Rules of a table with rows of 20 points from y = 400; skip: (row, column) whose lower rule is missing."""
    hs = [("f", 1, 400.0, 20.0, 440.0)]
    for r in range(rows):
        for c in range(4):
            if (r, c) not in skip:
                hs.append(("f", 1, 380.0 - 20 * r, float(GRID_X[c]), float(GRID_X[c + 1])))
    return hs, [("f", 1, float(x), 400.0 - 20 * rows, 400.0) for x in GRID_X]


def table_spans(rows):
    return spans_of([(GRID_X[c] + 5, 387 - 20 * r, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t])


def test_merged_cells(spark):
    hs, vs = grid(4, skip={(1, 3)})
    rows = [["S.No", "Case No", "Petitioner", "Reposted to"], ["1.", "R.P.1/2020", "x", "4.8.2026"], ["2.", "R.P.2/2020", "y", ""], ["3.", "R.P.3/2020", "z", "5.8.2026"]]
    _, s, h, v = frames(spark, [], table_spans(rows), hs, vs)
    got = {(r["r"], r["c"]): (r["owner_r"], r["text"]) for r in cells(s, h, v).collect()}
    assert got[1, 3] == (1, "4.8.2026") and got[2, 3] == (1, "4.8.2026") and got[3, 3] == (3, "5.8.2026") and got[2, 1] == (2, "R.P.2/2020")
    assert len(got) == 16


def test_split_party_counsel(spark):
    texts = ["L.Purusothamman through M/s.E.Ganesh", "1. R1 and R2 through M/s.N.Soundarrajan 4. E.O throughThiru. E. Ganesh", "AKILESH KUMAR FOR R1", "no one throughout", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", split_party_counsel(F.col("t")).alias("s")).orderBy("i")
    got = [(r["s"]["party"], [(a["name"], a["side_detail"]) for a in r["s"]["advocates"]]) for r in df.collect()]
    assert got[0] == ("L.Purusothamman", [("E.Ganesh", None)])
    assert got[1] == ("1. R1 and R2", [("N.Soundarrajan", "R1 and R2"), ("E. Ganesh", "E.O")])
    assert got[2] == ("R1", [("AKILESH KUMAR", "R1")])
    assert got[3] == ("no one throughout", []) and got[4] == got[5] == ("", [])


def test_documents_with_rules(spark):
    hs, vs = grid(5)
    rows = [["S.No", "Case No", "Petitioner", "Respondent"], ["1.", "R.P.66/2022", "A.Raman through Thiru. E. Ganesh", "The State"], ["", "R.P.70 to 72/2022", "B.Velan through M/s.X.Babu", "C.Mani"], ["2.", "A.P.5/2021", "E.Srikanth and others", "D.Kumar"], ["3.", "none", "skipped", "x"]]
    pages = [("f", 1, 500.0, 800.0, False)]
    roster = spark.createDataFrame([(0, "E. Ganesh", None, None), (1, "E. Srikanth", None, None)], "advocate_ord long, name string, enrolment string, role string")
    out = read_documents(*frames(spark, pages, table_spans(rows), hs, vs), roster)
    items = {r["case_numbers"][0]: r for r in out["items"].collect() if r["case_numbers"]}
    assert items["R.P.66/2022"]["item_no"] == "1" and items["R.P.70 to 72/2022"]["item_no"] == "1" and items["R.P.70 to 72/2022"]["item_no_inherited"]
    assert items["R.P.70 to 72/2022"]["case_keys"] == ["RP/70/2022", "RP/71/2022", "RP/72/2022"] and len(items) == 3
    roles = {r["c"]: r["role"] for r in out["roles"].collect()}
    assert roles[1] == "caseNumber"
    names = {(r["item_id"], r["name"]): r for r in out["item_names"].collect()}
    party = [r for r in names.values() if r["source"] == "B" and r["match_role"] == "party"]
    assert {(r["item_id"], r["advocate_key"]) for r in party} == {(items["A.P.5/2021"]["item_id"], "ESRIKANTH")}


def test_documents_without_rules(spark):
    rows = [(150, 780, "HIGH COURT OF JUDICATURE AT MADRAS"), (180, 770, "COURT NO. 5")]
    y = 700
    listed = [("1 WP/10/2026", "A.KUMAR", ["E.GANESH", "R.PRABAKAR"]), ("2 WP/11/2026", "B.RAJA", ["S.BABU", "------", "E.SRIKANTH"]), ("3 CRP/12/2025", "C.MANI", ["T.DEVI"])]
    for head, p, counsel in listed:
        left = [f"{head} {p}", "VS", "THE STATE"]
        for k in range(3):
            rows.append((30, y, left[k]))
            if k < len(counsel):
                rows.append((320, y, counsel[k]))
            y -= 12
    rows.append((30, 20, "1 / 4"))
    pages, s, h, v = frames(spark, [("f", 1, 500.0, 800.0, False)], spans_of(rows))
    page_lines = lines(s)
    assert detect_types(page_lines).first()["doc_type"] == "causelist.hc"
    context = page_context(page_lines, pages)
    assert context.first()["hall"] == "5" and "HIGH COURT" in context.first()["court"]
    assert regimes(pages, s, h, v).first()["regime"] == "columns"
    items, names = column_items(page_lines, pages, s, context)
    got = {r["item_no"]: r for r in items.collect()}
    assert {k: (r["petitioner"], r["respondent"], r["case_keys"]) for k, r in got.items()} == {"1": ("A.KUMAR", "THE STATE", ["WP/10/2026"]), "2": ("B.RAJA", "THE STATE", ["WP/11/2026"]), "3": ("C.MANI", "THE STATE", ["CRP/12/2025"])}
    sides = {r["name"]: r["side"] for r in names.collect()}
    assert sides == {"E.GANESH": "petitioner", "R.PRABAKAR": "petitioner", "S.BABU": "petitioner", "E.SRIKANTH": "respondent", "T.DEVI": "petitioner"}
    roster = spark.createDataFrame([(0, "E. Ganesh", None, None)], "advocate_ord long, name string, enrolment string, role string")
    out = read_documents(pages, s, h, v, roster)
    confirmed = {r["name"]: r["confirmed_by_both"] for r in out["item_names"].collect()}
    assert confirmed["E.GANESH"] and not confirmed["T.DEVI"]
    assert out["bad_pages"].count() == out["capped_ranges"].count() == 0


def test_notices_by_line(spark):
    rows = [(10, 100, "1. W.P.10/2026 reposted to 04.08.2026 at 10.30 a.m."), (10, 80, "2. W.P.11/2026"), (10, 60, "nothing here")]
    _, s, _, _ = frames(spark, [], spans_of(rows))
    got = [(r["case_keys"], r["reposted_to"], r["date_confidence"]) for r in line_notices(lines(s)).orderBy("notice_ord").collect()]
    assert got == [(["WP/10/2026"], "2026-08-04", "ruled"), (["WP/11/2026"], "2026-08-04", "inferred")]


def test_thin_pages_take_recognised_spans(spark):
    pages, s, h, v = frames(spark, [("f", 1, 500.0, 800.0, True), ("f", 2, 500.0, 800.0, False)], spans_of([(1, 1, "thin")]) + spans_of([(1, 1, "x" * 300)], page=2))
    more = frames(spark, [], spans_of([(5, 5, "seen")]) + spans_of([(5, 5, "not")], page=2))[1]
    assert sorted(r["text"] for r in completed(s, more, regimes(pages, s, h, v)).collect()) == ["seen", "thin", "x" * 300]


def test_nearest(spark):
    items = spark.createDataFrame([("a", "f", 1, 100.0, 80.0), ("b", "f", 1, 60.0, 50.0)], "item_id string, file string, page int, y_top double, y_bot double")
    points = spark.createDataFrame([("f", 1, y) for y in (90.0, 70.0, 55.0, 10.5, 5.0)], "file string, page int, y double")
    got = {r["y"]: (r["item_id"], r["within"]) for r in nearest_items(points, items).collect()}
    assert got == {90.0: ("a", True), 70.0: ("a", False), 55.0: ("b", True), 10.5: ("b", False), 5.0: (None, False)}


def test_nearest_items_is_a_sweep(spark):
    """The same as comparing all pairs, with equal tops, bands within bands, bands upside down and none; and no pairs are made."""
    import random

    from tallyline.operators.extraction import nearest_items

    r = random.Random(5)
    bands = [("f", p, f"i{k:03d}", float(t := r.randrange(0, 400)), float(t - r.choice([0, 1, 3, 30, 90, -5]))) for p in (1, 2) for k in range(40)] + [("f", 4, "x", None, 3.0), (None, 1, "n", 5.0, 1.0), ("f", 1, "b", 300.0, None)]
    points = [("f", p, float(r.randrange(-60, 460)) + r.choice([0.0, 0.5])) for p in (1, 2, 3, 4) for _ in range(60)] + [(None, 1, 4.0)]

    def plain(f, p, y):
        found = []
        for bf, bp, i, top, bot in bands:
            if (bf, bp) != (f, p) or f is None or top is None or (bot is None and y <= top):
                continue
            inside = bot is not None and bot - 1 <= y <= top + 1
            found.append((not inside, 0.0 if inside else y - top if y > top else bot - y, -top, i))
        best = min(found, default=None)
        return (best[3], not best[0]) if best and best[1] <= 40 else (None, False)

    items = spark.createDataFrame(bands, "file string, page int, item_id string, y_top double, y_bot double")
    got = nearest_items(spark.createDataFrame(points, "file string, page int, y double"), items)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((str(x["file"]), x["page"], x["y"], x["item_id"], x["within"]) for x in got.collect()) == sorted((str(f), p, y, *plain(f, p, y)) for f, p, y in set(points))

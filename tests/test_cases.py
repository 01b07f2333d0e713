"""Case identifiers and ranges."""

from pyspark.sql import functions as F

from tallyline import constants as K
from tallyline.functions.text import case_key, case_key_from_parts, case_mentions, dates_iso, highlight_spans, is_noise
from tallyline.operators.ranges import expand_case_cells

# Two spellings, and whether they are one case.
EQUAL = [("WA 2025 of 2026", "WA/2025/2026", True), ("WP Crl 2077 of 2026", "WP Crl./2077/2026", True), ("CRP 414 of 2023", "CRP/414/2023", True), ("CS 813 of 2016", "CS/813/2016", True), ("CC 212 of 2026", "C.C.No.212/2026", True), ("WMP 11451 of 2026", "WMP/11451/2026", True), ("CC 212 of 2026", "CC 213 of 2026", False), ("CC 212 of 2026", "CC 212/26", False)]
EQUAL_OCR = [("CC 212 of 2026", "CC 2l2/2026", True), ("CC 212 of 2026", "C.C.No.2I2/2026", True), ("WP 14523 of 2025", "W.P.No.145Z3 of 2025", True), ("OS 88 of 2024", "O.S. 8B/2024", True), ("CRP 901 of 2026", "C.R.P.NO.9O1 OF 2026", True), ("CC 212 of 2026", "CC 213 of 2026", False)]
# A cell and its number of keys.
CELLS = [("R.P.66/2022", 1), ("R.P.384 to 387/2022", 4), ("R.P.384 to 387/2022, A.P.141 to 144/2022", 8), ("R.P.Nos.243 to 261 and 262/2022", 20), ("R.P.48 to 96/ 2023", 49), ("R.P.27 to 29/2025, R.P.88/2025", 4), ("R.P.05 and 06/2026", 2), ("R.P.17 of 2026", 1), ("R.P.No.289 to 294 of 2026", 6), ("A.P.38 to 40/2026", 3), ("R.P.146 and 147/2026", 2), ("SMR.1/2025", 1), ("R.P.109 to 114/2025, R.P.125 to 127/2025, R.P.220/2025", 10), ("R.P.Nos.412 to 428/2025, R.P.433/2025", 18), ("R.P.212/2023, A.P.135/2022", 2), ("R.P.No.427 and 428/2024", 2), ("R.P.5 and 6, 7 and A.P.8/2020", 4), ("WA/2025/2026", 0), ("", 0), (None, 0)]


def test_keys(spark):
    for ocr, table in ((False, EQUAL), (True, EQUAL_OCR)):
        df = spark.createDataFrame(table, "a string, b string, same boolean")
        assert [r for r in df.select("*", (case_key(F.col("a"), ocr) == case_key(F.col("b"), ocr)).alias("got")).collect() if r["same"] != r["got"]] == []
    got = spark.createDataFrame([("66/2022",), ("R.P.66/2022",), ("W.P.No. 007 of 2020",), ("no case",), (None,)], "x string").coalesce(1).select(case_key(F.col("x"))).collect()
    assert [r[0] for r in got][:3] == ["6/6/2022", "RP/66/2022", "WPNO/7/2020"] and got[4][0] == ""
    assert spark.createDataFrame([("R.P", "192", "2026")], "a string, b string, c string").select(case_key_from_parts(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "RP/192/2026"


def test_ranges(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CELLS)], "id long, cell string")
    keys, refused = expand_case_cells(df, "id", "cell")
    got = {}
    for r in keys.orderBy("id", "key_ord").collect():
        got.setdefault(r["id"], []).append(r["case_key"])
    assert [len(got.get(i, [])) for i in range(len(CELLS))] == [n for _, n in CELLS]
    assert got[6] == ["RP/5/2026", "RP/6/2026"] and got[16] == ["RP/5/2020", "RP/6/2020", "RP/7/2020", "AP/8/2020"] and refused.count() == 0
    wide = spark.createDataFrame([(1, "R.P.1 to 900/2024"), (2, "R.P.1 to 900, 5/2024"), (3, "R.P.1 to 500/2024"), (4, "R.P.9 to 3/2024")], "id long, cell string")
    keys, refused = expand_case_cells(wide, "id", "cell")
    assert sorted((r["id"], r["n"]) for r in keys.groupBy("id").agg(F.count("*").alias("n")).collect()) == [(2, 1), (3, 500)]
    assert sorted((r["id"], r["kind"], r["members"], r["year"]) for r in refused.collect()) == [(1, "RP", 900, "2024"), (2, "RP", 900, "2024")]


def test_mentions_dates_noise_spans(spark):
    df = spark.createDataFrame([("see W.P.No. 12 of 2020 and CRP 4/2021 today",)], "x string")
    found = df.select(case_mentions(F.col("x"))).first()[0]
    assert len(found) == 2 and found[1].endswith("CRP 4/2021")
    df = spark.createDataFrame([("on 4.8.2026 at 10.30 a.m.",), ("31/02/2026",), ("none",)], "x string").coalesce(1)
    assert [r[0] for r in df.select(dates_iso(F.col("x"))).collect()] == ["2026-08-04", "2026-02-31", None]
    df = spark.createDataFrame([("E.GANESH",), ("---",), ("12345",), ("ANNA NAGAR",), (" ",), ("X" * 46,)], "x string").coalesce(1)
    assert [r[0] for r in df.select(is_noise(F.col("x"))).collect()] == [False, True, True, True, True, True]
    df = spark.createDataFrame([("a.b x a.b", "a.b"), ("aaa", "aa"), ("x", "")], "t string, n string").coalesce(1)
    assert [[(s["start"], s["end"]) for s in r[0]] for r in df.select(highlight_spans(F.col("t"), F.col("n"))).collect()] == [[(0, 3), (6, 9)], [(0, 2)], []]


def test_long_numbers(spark):
    """Numbers of any length keep all digits, without leading zeros."""
    table = [("W.P.No.1234567890/2024", "WP/1234567890/2024"), ("WP/00150000/2024", "WP/150000/2024"), ("wp 12345678 of 2024", "WP/12345678/2024"), ("WP12345678/2024", "WP/12345678/2024"), ("W.P. 123456789012345678901 / 2024", "WP/123456789012345678901/2024")]
    df = spark.createDataFrame(table, "x string, y string")
    assert [r for r in df.select("*", case_key(F.col("x")).alias("got")).collect() if r["got"] != r["y"]] == []


def test_long_numbers_in_lines(spark):
    """Lines open items and notices also where case numbers have more than six digits."""
    df = spark.createDataFrame([("W.P.Nos.9000000 and 9000001/2024 as above",), ("CRP 1234567 of 2021",)], "x string").coalesce(1)
    assert [list(r[0]) for r in df.select(case_mentions(F.col("x"))).collect()] == [["W.P.Nos.9000000 and 9000001/2024"], ["CRP 1234567 of 2021"]]
    opened = spark.createDataFrame([("12  WP/9000000/2024 PARTY7",)], "x string").select(F.regexp_extract("x", K.ITEM_START, 1), F.regexp_extract("x", K.ITEM_START, 2)).first()
    assert tuple(opened) == ("12", "WP/9000000/2024")

"""Rosters and registers from files; the ledger, decisions and profiles."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyline.functions.tiers import register_age
from tallyline.sources.store import LEDGER, MEMORY, Store, ledger_entries, load_profile_json, merge_ledger, profile_json, remember
from tallyline.sources.tabular import detect_columns, header_score, parse_register, read_register, read_roster, separator, sheet
from tallyline import constants as K
from tallyline.sources.workbook import write_workbook
from tallyline.streaming.notices import NOTICES, follow_notices, merge_batch

TWO = [("E. Ganesh", "MS/1/2005"), ("M. Krishnamurthy", "MS/2/2001")]


def workbook(path, rows):
    cells = lambda r, row: "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row))
    body = "".join(f'<row r="{i}">{cells(i, row)}</row>' for i, row in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_roster_formats(spark, tmp_path):
    files = {
        "a.csv": "Advocate Name,Enrolment No,Role\nE. Ganesh,MS/1/2005,Senior\n\nM. Krishnamurthy,MS/2/2001,\nE.GANESH,again,\n",
        "b.csv": "﻿Name of the Advocate;Bar Enrolment\n E. Ganesh ;MS/1/2005\n;\nM. Krishnamurthy;MS/2/2001\n",
        "c.tsv": "S.No\tAdv Name\tEnrolment\n1\tE. Ganesh\tMS/1/2005\n2\tM. Krishnamurthy\tMS/2/2001\n",
        "d.txt": "Advocates\nE. Ganesh, MS/1/2005, Senior\n\n  M. Krishnamurthy | MS/2/2001\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    workbook(tmp_path / "e.xlsx", [["Advocate Name", "Enrolment No"], ["E. Ganesh", "MS/1/2005"], ["", ""], ["M. Krishnamurthy", "MS/2/2001"]])
    for name in [*files, "e.xlsx"]:
        got = [(r["name"], r["enrolment"]) for r in read_roster(spark, f"{tmp_path}/{name}").orderBy("advocate_ord").collect()]
        assert got == TWO, name
    (tmp_path / "f.csv").write_text("E. Ganesh\nM. Krishnamurthy\n")
    assert [r["name"] for r in read_roster(spark, f"{tmp_path}/f.csv").orderBy("advocate_ord").collect()] == [n for n, _ in TWO]
    assert separator('"a,b";c') == ";"


def test_register(spark, tmp_path):
    heads = {
        "a.csv": 'DiaryNo,CaseType,CaseNo,Year,CauseTitle,PartyName,CNR\n"B1","R.P","66","2022","x, y -Vs- z","x",""\n,,,,,,\n"B2","","","","only a title","",""\n',
        "b.csv": "Client Name,Case Number,Mobile Number,Cause Title\nx,R.P.66/2022,98,t\n",
        "c.csv": "Cause Title,Mobile,Case Number,Client\nt,98,RP 66 of 2022,x\n",
        "d.csv": "Case Number\nR.P.No.66/2022\n",
    }
    for name, text in heads.items():
        (tmp_path / name).write_text(text)
        rows = read_register(spark, f"{tmp_path}/{name}").orderBy("case_ord").collect()
        assert rows[0]["case_key"] == "RP/66/2022", name
    rows = read_register(spark, f"{tmp_path}/a.csv").orderBy("case_ord").collect()
    assert [r["diary_no"] for r in rows] == ["B1", "B2"] and rows[0]["raw"]["CauseTitle"] == "x, y -Vs- z" and rows[1]["case_key"] is None and rows[0]["cnr"] is None
    assert read_register(spark, f"{tmp_path}/c.csv").first()["cause_title"] == "t"
    assert parse_register(sheet(spark, f"{tmp_path}/d.csv"), {"cnr": 0}).first()["cnr"] == "R.P.No.66/2022"


def test_workbook_round_trip(spark, tmp_path):
    """Sheets hold the tables, with maps as columns; text that XML can't hold is left out."""
    rows = [(1, "a <b> & 'c'", None, {"k": "v", "j": ""}, 1.5), (2, "bell \x07 and\nline", True, {}, None)]
    df = spark.createDataFrame(rows, "n long, s string, b boolean, Register map<string, string>, x double").coalesce(1)
    path = f"{tmp_path}/out.xlsx"
    write_workbook(spark, {"rows/1": df, "summary": spark.createDataFrame([("Matched", 3)], "name string, value long")}, f"file://{path}")
    got = [r["cells"] for r in sheet(spark, path).orderBy("ord").collect()]
    assert got == [["n", "s", "b", "j", "k", "x"], ["1", "a <b> & 'c'", "", "", "v", "1.5"], ["2", "bell  and\nline", "True"]]
    with zipfile.ZipFile(path) as z:
        assert 'name="rows 1"' in z.read("xl/workbook.xml").decode() and "Matched" in z.read("xl/worksheets/sheet2.xml").decode()


def test_headers():
    assert detect_columns(["Cause Title", "Case Type", "Diary"], K.REGISTER_HEADERS) == {"cause_title": 0, "case_type": 1, "diary_no": 2}
    assert header_score("NAME OF THE ADVOCATE", K.ROSTER_HEADERS["name"]) == 1 and header_score("", ["name"]) == 0


def seen(spark, rows):
    return spark.createDataFrame(rows, "case_keys array<string>, seen_ord long, petitioner string, respondent string, advocate string, court string")


def test_ledger(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.keys() == [] and store.get("ledger", LEDGER).count() == 0
    one = ledger_entries(seen(spark, [(["A/1/2020", "A/2/2020"], 1, "p", "q", None, "c"), (["A/1/2020"], 0, "", None, "E", "")]), "2026-08-01")
    store.put("ledger", merge_ledger(store.get("ledger", LEDGER), one))
    two = ledger_entries(seen(spark, [(["A/1/2020", "B/3/2020"], 0, "late", None, "F", "d")]), "2026-08-02")
    store.put("ledger", merge_ledger(store.get("ledger", LEDGER), two))
    got = {r["case_key"]: r for r in store.get("ledger", LEDGER).collect()}
    a = got["A/1/2020"]
    assert (a["cause_title"], a["parties"], a["advocate"], a["court"], a["dates"]) == ("p vs q", "p", "E", "c", ["2026-08-01", "2026-08-02"])
    assert got["B/3/2020"]["cause_title"] == "late" and len(got) == 3
    kept = merge_ledger(store.get("ledger", LEDGER), two.limit(0), cap=1).collect()
    assert [r["case_key"] for r in kept] == ["B/3/2020"]
    memory = remember(spark.createDataFrame([("k1", True), ("k2", False)], MEMORY), spark.createDataFrame([("k2", None), ("k3", True)], MEMORY))
    assert sorted(map(tuple, memory.collect())) == [("k1", True), ("k3", True)]
    store.put("memory", memory)
    text = profile_json(store)
    other = Store(spark, f"file://{tmp_path}/other")
    load_profile_json(other, text)
    assert other.get("ledger", LEDGER).count() == 3 and other.get("memory", MEMORY).count() == 2
    with pytest.raises(ValueError):
        load_profile_json(other, json.dumps({}))
    assert sorted(store.erase()) == ["ledger", "memory"] and store.keys() == []


def test_store_survives_what_was_left_half_done(spark, tmp_path):
    """A version without a pointer, and a pointer that was not put in place, change nothing."""
    store = Store(spark, f"file://{tmp_path}/store")
    table = lambda *keys: spark.createDataFrame([(k, True) for k in keys], MEMORY)
    store.put("memory", table("a"), "7")
    table("lost").write.parquet(f"file://{tmp_path}/store/memory-half")
    (tmp_path / "store" / "memory.current" / ".memory-half").write_text("memory-half 8\n")
    assert store.get("memory", MEMORY).first()["confirm_key"] == "a" and store.note("memory") == "7"
    store.put("memory", table("a", "b"))
    assert store.get("memory", MEMORY).count() == 2 and store.note("memory") == "7"
    store.tidy("memory")
    assert store.get("memory", MEMORY).count() == 2 and len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("memory-")]) == 1


def test_batches_of_notices_count_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    batch = lambda key, day: spark.createDataFrame([(1, [key], day, None, "ruled", None, 1)], NOTICES)
    merge_batch(store, batch("A/1/2020", "2026-09-01"), 0)
    merge_batch(store, batch("B/1/2020", "2026-09-02"), 0)  # the same number again
    merge_batch(store, batch("C/1/2020", "2026-09-03"), 1)
    assert sorted(r["case_key"] for r in store.get("ledger", LEDGER).collect()) == ["A/1/2020", "C/1/2020"]


def test_register_age(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00", d) for d in ("2026-01-14 23:00:00", "2026-01-15 00:00:00", "2026-02-15 00:00:00")], "a string, b string").coalesce(1)
    got = df.select(register_age(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")).alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [(13, "ok"), (14, "amber"), (45, "red")]


def test_notices_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps({"notice_ord": 1, "case_keys": ["A/1/2020"], "reposted_to": "2026-09-01"}) + "\n")
    store = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        follow_notices(spark, str(folder), store, f"{tmp_path}/cp").awaitTermination()
        (folder / "2.json").write_text(json.dumps({"notice_ord": 2, "case_keys": ["A/1/2020", "B/2/2021"], "reposted_to": "2026-09-02"}) + "\n")
    got = {r["case_key"]: r["dates"] for r in store.get("ledger", LEDGER).collect()}
    assert got == {"A/1/2020": ["reposted 2026-09-01", "reposted 2026-09-02"], "B/2/2021": ["reposted 2026-09-02"]}

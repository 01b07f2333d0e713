"""The planted listing, end to end."""

import pytest
from pyspark.sql import functions as F

import bench
from tallyline.operators.extraction import bad_files, read_documents
from tallyline.operators.matching import decide
from tallyline.operators.views import confirm_queue, visible, write_csv
from tallyline.plans.run import Inputs, run
from tests import planted

RANK = {"none": 0, "weak": 1, "review": 2, "auto": 3}
NOTICE = "notice_ord long, case_keys array<string>, reposted_to string, reposted_time string, date_confidence string, source_file string, page int"


@pytest.fixture(scope="module")
def inputs(spark):
    return {"items": planted.items(spark).cache(), "item_names": planted.item_names(spark).cache(), "roster": planted.roster(spark).cache(), "register": planted.register(spark).cache()}


@pytest.fixture(scope="module")
def results(inputs):
    out = run(Inputs(**inputs, date="2026-08-14"))
    out["matches"] = out["matches"].cache()
    return out


@pytest.fixture(scope="module")
def matches(results):
    return results["matches"].collect()


def best(matches):
    out = {}
    for m in matches:
        if m["item_id"] not in out or RANK[m["tier"]] > RANK[out[m["item_id"]]["tier"]]:
            out[m["item_id"]] = m
    return out


def test_tiers(matches):
    b = best(matches)
    tier = {i: b[i]["tier"] if i in b else "none" for i, *_ in planted.ITEMS}
    autos = ["P01", "P02", "P03", "P04", "P05", "P06", "P09", "P11", "P12", "P18", "P19", "P20", "P21"]
    assert {i: tier[i] for i in autos} == dict.fromkeys(autos, "auto")
    assert [tier[i] for i in ("D05", "D06", "D07")] == ["none"] * 3 and tier["D09"] == tier["D10"] == "review"
    assert all(tier[i] in ("weak", "none") for i in ("D01", "D02", "D03", "D04"))
    assert tier["P16"] == tier["P17"] == tier["D08"] == "auto" and tier["P13"] == tier["P14"] == tier["P15"] == "review"
    assert b["P17"]["advocate"] == "T. Thamarai Selvan"


def test_signals_and_roles(matches):
    b = best(matches)
    assert sum(m["item_id"] == "P01" for m in matches) == 4
    kinds = lambda m: [s["kind"] for s in m["signals"]]
    assert kinds(b["P01"]) == ["advocateName", "caseNumber", "partyName", "cluster"] and b["P01"]["confidence"] == 1
    assert b["P03"]["side"] == "respondent" and not b["P03"]["side_mismatch"]
    assert b["P19"]["advocate"] is None and b["P19"]["identified_by"] == "caseNumber" and b["P19"]["register_advocate"] == "D. Lokeshwaran"
    assert b["P18"]["match_role"] == "party" and "caseNumber" in kinds(b["P18"])
    assert all(RANK[m["tier"]] <= RANK[m["tier_before_cap"]] for m in matches)
    assert len({(m["item_id"], m["advocate"]) for m in matches}) == len(matches)


def test_views_and_exports(results):
    owned = {(r["item_id"], r["owner"]): r for r in results["by_advocate"].collect()}
    assert owned["P19", "D. Lokeshwaran"]["attributed_via"] == "register" and owned["P19", "D. Lokeshwaran"]["also_under"] == []
    assert owned["P01", "E. Ganesh"]["also_under"] == ["E. Srikanth", "D. Lokeshwaran", "T. Thamarai Selvan"]
    assert results["orphans"].count() == 0
    cases = {r["item_id"]: r["advocates"] for r in results["by_case"].collect()}
    assert cases["P21"] == ["E. Ganesh", "T. Thamarai Selvan"] and cases["P19"] == []
    halls = [(r["view_court"], r["view_hall"]) for r in results["by_court"].collect()]
    assert halls == sorted(halls, key=lambda x: (x[0], int(x[1])))
    rows = results["export_rows"].collect()
    p19 = next(r for r in rows if r["item_id"] == "P19")
    assert p19["MatchRole"] == "Found by case number; no name could be read" and p19["DiaryNo"] == "B045" and p19["Register"]["Register: DiaryNo"] == "B045"
    n = results["counts"].first()
    assert n["auto"] + n["review"] + n["weak"] == len(rows) and n["courts"] == 3 and n["adjourned"] == 0
    summary = {r["name"]: r["value"] for r in results["export_summary"].collect()}
    assert summary["Matched"] == n["auto"]
    assert results["export_byAdvocate"].count() == len(owned) and results["export_byCase"].count() == len(cases) and results["export_byCourt"].count() == len(rows)


def test_evidence(results):
    ev = {r["item_id"]: r for r in results["evidence"].filter("item_id in ('P19', 'P13', 'P05')").collect()}
    assert ev["P19"]["decisive_field"] == "caseNumber" and ev["P19"]["register_hit"]
    rows = {r["field"]: r for r in ev["P13"]["evidence"]}
    assert list(rows) == ["caseNumber", "cnr", "causeTitle", "parties", "advocate", "side", "nextStage"]
    assert rows["caseNumber"]["verdict"] == "absent" and rows["caseNumber"]["in_register"] == "Not in your register"
    assert "No initial" in rows["advocate"]["note"]
    assert {r["field"]: r["verdict"] for r in ev["P05"]["evidence"]}["advocate"] == "differ"
    assert [(s["start"], s["end"]) for s in ev["P13"]["highlight_spans"]]
    some = {(r["item_id"], r["advocate"]): r["colleagues"] for r in results["colleagues"].collect()}
    assert some["P01", "E. Ganesh"] == ["E.SRIKANTH", "D.LOKESHWARAN", "T.THAMARAI SELVAN"]


def test_adjournments(spark, inputs, matches):
    notices = [(0, ["ZZ/1/2020", "WA/2025/2026"], "2026-09-01", "10.30 a.m.", "ruled", "notice.pdf", 1), (1, ["WP/9090/2026"], "2026-09-02", None, "inferred", "notice.pdf", 1), (2, ["WA/2025/2026", "WP/7777/2026"], "2026-09-03", None, "ruled", "notice.pdf", 2), (3, ["XX/5/2021"], None, None, "ruled", "notice.pdf", 2)]
    ledger = spark.createDataFrame([("XX/5/2021", "a vs b")], "case_key string, cause_title string")
    out = run(Inputs(**inputs, reposted=spark.createDataFrame(notices, NOTICE), ledger=ledger, date="2026-08-14"))
    gone = out["adjourned"].collect()
    assert {r["item_id"] for r in gone} == {"P01", "P09"} and {r["adjourned"]["reposted_to"] for r in gone if r["item_id"] == "P01"} == {"2026-09-01"}
    assert {r["tier"] for r in gone if r["item_id"] == "P09"} == {"review"}
    assert {r["item_id"] for r in out["matches"].collect()} == {m["item_id"] for m in matches} - {"P01", "P09"}
    only = {r["case_key"]: r["identified_from"] for r in out["notice_only"].collect()}
    assert only == {"WP/7777/2026": "register", "XX/5/2021": "ledger"}
    assert out["counts"].first()["adjourned"] == 4 + 1 + 2
    export = out["export_adjourned"].collect()
    assert {r["CaseNumber"] for r in export if r["Adjourned"].endswith("was loaded")} == set(only)
    assert out["notes"].count() == 0


def test_memory(spark, inputs, matches):
    by = {m["item_id"]: m for m in matches}
    decisions = spark.createDataFrame([(by["P13"]["confirm_key"], True), (by["P14"]["confirm_key"], False), (by["D01"]["confirm_key"], True)], "confirm_key string, confirmed boolean")
    out = {r["item_id"]: r["tier"] for r in run(Inputs(**inputs, memory=decisions))["matches"].filter("item_id in ('P13', 'P14', 'D01')").collect()}
    assert out == {"P13": "auto", "D01": "weak"}


def test_caps_and_fallback(spark):
    items = planted.items(spark).filter("item_id in ('P01', 'P13', 'D06')").withColumn("low_page", F.col("item_id") == "P01")
    names = planted.item_names(spark).filter("item_id in ('P01', 'P13', 'D06')")
    loose = [("D06", 9, "E.GANESH", "unplaced", "unknown", None, "B", False, "EGANESH", False), ("P13", 9, "E.SRIKANTH", "unplaced", "unknown", None, "B", True, "ESRIKANTH", False)]
    names = names.unionByName(spark.createDataFrame(loose, names.schema))
    keyless = spark.createDataFrame([(0, None, None, "K1", "P.Anbu vs The State", "P.Anbu", "Petitioner", "E. Ganesh", None, None, {}), (1, None, None, "K2", "F.Arun and others", "somebody", None, None, None, None, {})], planted.register(spark).schema)
    got = {(r["item_id"], r["advocate"]): r for r in run(Inputs(items, names, planted.roster(spark), keyless))["matches"].collect()}
    assert got["P01", "E. Ganesh"]["tier"] == "review" and got["P01", "E. Ganesh"]["tier_before_cap"] == "auto"
    assert got["D06", "E. Ganesh"]["tier"] == "review" and got["D06", "E. Ganesh"]["tier_before_cap"] == "auto"
    assert got["P13", "E. Srikanth"]["tier"] == "weak"
    assert got["P13", "E. Ganesh"]["register_case"]["diary_no"] == "K1" and got["P13", "E. Ganesh"]["tier"] == "auto"


def test_visible_rows_and_the_queue(results, matches):
    by = lambda *tiers: sum(m["tier"] in tiers for m in matches)
    assert visible(results["matches"]).count() == by("auto", "review") and visible(results["matches"], weak=True).count() == len(matches)
    assert confirm_queue(results["matches"]).count() == by("review") > 0


def test_decisions_are_written_back(spark, inputs, matches):
    key = next(m["confirm_key"] for m in matches if m["item_id"] == "P13")
    memory = spark.createDataFrame([(key, False), ("other", True)], "confirm_key string, confirmed boolean")
    memory = decide(memory, key, True)
    assert sorted(map(tuple, memory.collect())) == sorted([(key, True), ("other", True)])
    out = run(Inputs(**inputs, memory=memory))["matches"].filter("item_id = 'P13'")
    assert [r["tier"] for r in out.collect()] == ["auto"] and confirm_queue(out).count() == 0


def test_csv(spark, results, tmp_path):
    write_csv(results["export_rows"], f"{tmp_path}/rows")
    write_csv(results["export_rows"], f"{tmp_path}/one", single=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/rows")
    assert back.count() == results["export_rows"].count() and {"CaseNumber", "Tier", "Register: DiaryNo"} <= set(back.columns)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    p19 = back.filter("item_id = 'P19'").first()
    assert p19["DiaryNo"] == p19["Register: DiaryNo"] == "B045"


def test_printed_enrolments_and_cnrs(spark, inputs):
    """An enrolment number or a CNR in an item's text decides, however it is spaced."""
    items = planted.items(spark).filter("item_id in ('P13', 'D06')").withColumn("raw_text", F.concat("raw_text", F.when(F.col("item_id") == "P13", " Enrol. MS-1234/2005").otherwise(" CNR TNCH01-004567-2026")))
    names = planted.item_names(spark).filter("item_id in ('P13', 'D06')")
    roster = planted.roster(spark).withColumn("enrolment", F.when(F.col("name") == "E. Ganesh", "MS/1234/2005"))
    cnr = spark.createDataFrame([(0, None, "TNCH010045672026", "K1", None, None, None, None, None, None, {})], planted.register(spark).schema)
    got = {(r["item_id"], r["advocate"]): r for r in run(Inputs(items, names, roster, cnr))["matches"].collect()}
    p13 = got["P13", "E. Ganesh"]
    assert p13["tier"] == "auto" and "enrolment" in [s["kind"] for s in p13["signals"]]
    d06 = [r for (i, _), r in got.items() if i == "D06"]
    assert d06 and all("cnr" in [s["kind"] for s in r["signals"]] and r["register_case"]["diary_no"] == "K1" for r in d06)


def test_notices_without_lists(spark, inputs):
    notices = spark.createDataFrame([(0, ["WP/7777/2026"], "2026-09-01", None, "ruled", "n", 1)], NOTICE)
    out = run(Inputs(**(inputs | {"items": planted.items(spark).limit(0)}), reposted=notices))
    assert [r["level"] for r in out["notes"].collect()] == ["warn"] and out["notice_only"].count() == 1


def test_files_with_many_bad_pages(spark):
    pages = spark.createDataFrame([("a", k) for k in range(10)] + [("b", 0)], "file string, page int")
    items = spark.createDataFrame([("a", k, k < 3) for k in range(10)] + [("b", 0, False)], "file string, page int, low_page boolean")
    assert [(r["file"], r["low_share"]) for r in bad_files(items, pages).collect()] == [("a", 0.3)]


def test_from_pages_to_exports(spark):
    """Spans and rules are read and matched, and the matches exported."""
    x = bench.listing(spark, pages=4, rows=6)
    roster = spark.createDataFrame([(0, "H. Navirukan", None, None)], "advocate_ord int, name string, enrolment string, role string")
    found = read_documents(**x, roster=roster)
    assert found["items"].count() == 24 and found["bad_files"].count() == 0
    names = {r["name"] for r in found["item_names"].filter("match_role = 'counsel'").collect()}
    assert len(names) == 24
    register = spark.createDataFrame([(0, "WP/7/2026", None, "D7", None, None, None, None, None, None, {})], planted.register(spark).schema)
    out = run(Inputs(found["items"], found["item_names"], spark.createDataFrame([(0, sorted(names)[3], None, None)], roster.schema), register))
    rows = {r["CaseNumber"]: r for r in out["export_rows"].collect()}
    assert rows["W.P.No.7/2026"]["DiaryNo"] == "D7" and any(r["PrintedName"] == sorted(names)[3] and r["Tier"] == "Matched" for r in rows.values())


def test_parties_are_compared_once_for_each_text(spark, monkeypatch):
    """Items that print the same parties are not compared with the register one by one."""
    from pyspark.sql import functions as F

    from tallyline.operators import matching
    from tallyline.plans.listings import register_of

    n = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(title):
        n.add(1)
        return 0.9 if title.startswith("red") else 0.1

    monkeypatch.setattr(matching, "party_similarity", lambda title, party: seen(title))
    items = spark.range(50).select(F.col("id").alias("item_id"), F.lit("red bolt").alias("petitioner"), F.lit(None).cast("string").alias("respondent"))
    register = register_of(spark.createDataFrame([(0, "red bolt vs X"), (1, "red's bolt"), (2, "bolt works")], "k long, t string").filter("k <> 1"), case_ord=F.col("k"), cause_title=F.col("t"))
    got = matching.match_parties(items, register).select("item_id", "by_party.case_ord").collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(50)] and n.value <= 4


def test_ranked_numbers_rows_without_one_task(spark):
    from tallyline.operators._common import ranked

    got = ranked(spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 as v"), ["v"], "n")
    assert got.filter("n <> v").count() == 0 and got.count() == 5000

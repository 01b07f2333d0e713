"""From lines and cells to items, names and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline import constants as K
from tallyline.functions.text import case_key, case_mentions, dates_iso, is_noise, letters
from tallyline.functions.tiers import classify
from tallyline.operators._common import first_by, small, written
from tallyline.operators.layout import PAGE, cells, counsel_columns, joined, lines
from tallyline.operators.linking import link_names, name_windows
from tallyline.operators.ranges import expand_case_cells

NAME = ["name", "match_role", "side", "side_detail", "source", "near_only", "advocate_key", "confirmed_by_both"]


# Document types and column roles -----------------------------------------------------------------------------------


def detect_types(page_lines: DataFrame) -> DataFrame:
    """(file, doc_type, confident, hits): the layout with most signatures in the first two pages; ties are not confident."""
    text = page_lines.filter("page <= 2").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda s: s["text"]), "\n").alias("text"))
    hits = [F.struct(sum((F.col("text").rlike(p).cast("int") for p in profile["detect"]), F.lit(0)).alias("hits"), F.lit(-k).alias("k"), F.lit(profile["id"]).alias("id")) for k, profile in enumerate(K.PROFILES)]
    out = text.withColumn("_s", F.reverse(F.array_sort(F.array(*hits))))
    best, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    return out.select("file", F.when(best["hits"] > 0, best["id"]).otherwise("unknown").alias("doc_type"), ((best["hits"] >= 2) & (second["hits"] < best["hits"])).alias("confident"), best["hits"].alias("hits"))


def probe_columns(table_cells: DataFrame) -> DataFrame:
    """(file, n_cols, c, cells, pf, cf, density, direction): how many cells of a column join a party to its counsel."""
    body = table_cells.filter((F.col("r") > 0) & (F.col("r") == F.col("owner_r")) & (F.length("text") >= 4))
    first = F.col("text").rlike(K.PARTY_FIRST)
    out = body.groupBy("file", "n_cols", "c").agg(F.count("*").alias("cells"), F.count_if(first).alias("pf"), F.count_if(~first & F.col("text").rlike(K.COUNSEL_FIRST)).alias("cf"))
    return out.withColumns({"density": F.greatest("pf", "cf") / F.col("cells"), "direction": F.when((F.col("pf") >= F.col("cf")) & (F.col("pf") > 0), "party-first").when(F.col("cf") > 0, "counsel-first")})


def infer_roles(table_cells: DataFrame) -> DataFrame:
    """(file, n_cols, c, name, role, side, label): columns of a layout that nothing declares, from their first 40 cells."""
    body = table_cells.filter((F.col("r") > 0) & (F.col("r") == F.col("owner_r")) & (F.col("text") != ""))
    reposting = table_cells.filter("r = 0").groupBy("file", "n_cols").agg(F.max(F.col("text").rlike("(?i)reposted")).alias("reposting"))
    body = body.withColumn("_n", F.row_number().over(Window.partitionBy("file", "n_cols", "c").orderBy("page", "table_no", "r"))).filter("_n <= 40").join(small(reposting), ["file", "n_cols"])
    share = lambda p: F.avg(F.col("text").rlike(p).cast("int"))
    s = body.groupBy("file", "n_cols", "c", "reposting").agg(share(K.INDEX_CELL).alias("index"), share(K.CASE_CELL).alias("case"), share(K.REPOST_DATE).alias("date"))
    role = F.when((F.col("c") == 0) & (F.col("index") > 0.5), "index").when(F.col("case") > 0.4, "caseNumber").when(F.when(F.col("reposting"), F.col("date") > 0.4).otherwise(F.col("date") > 0.6), "extra").otherwise("party")
    name = F.when((role == "extra") & F.col("reposting"), "repostedTo").otherwise(F.concat(F.lit("column"), F.col("c").cast("string")))
    side = F.when(role == "party", F.when(F.col("c") == 2, "petitioner").when(F.col("c") == 3, "respondent"))
    return s.select("file", "n_cols", "c", name.alias("name"), role.alias("role"), side.alias("side"), name.alias("label"))


def assign_roles(table_cells: DataFrame, types: DataFrame) -> DataFrame:
    """infer_roles() with declared columns where a layout has as many, and party columns upgraded by the probe."""
    spark = table_cells.sparkSession
    declared = spark.createDataFrame([(p["id"], len(p["columns"]), c, n, r, s, label or n) for p in K.PROFILES for c, (n, r, s, label) in enumerate(p["columns"])], "doc_type string, n_cols int, c int, name string, role string, side string, label string")
    known = table_cells.select("file", "n_cols").distinct().join(types.select("file", "doc_type"), "file").join(F.broadcast(declared), ["doc_type", "n_cols"]).drop("doc_type")
    guessed = infer_roles(table_cells).join(known.select("file", "n_cols").distinct(), ["file", "n_cols"], "left_anti")
    out = known.unionByName(guessed).join(probe_columns(table_cells).select("file", "n_cols", "c", "cells", "density"), ["file", "n_cols", "c"], "left")
    upgrade = (F.col("role") == "party") & (F.col("density") >= K.PROBE_DENSITY) & (F.col("cells") >= K.PROBE_CELLS)
    return out.withColumn("role", F.when(upgrade, "party+counsel").otherwise(F.col("role"))).drop("cells", "density")


# Parties and counsel in one cell -----------------------------------------------------------------------------------


def respondent_numbering(before: Column) -> Column:
    """Which respondents an advocate acts for, from the entry before the connector: a range, a list, or an office."""
    entry = F.element_at(F.split(before, r"\s(?=\d{1,2}\s*\.\s*)"), -1)
    found = [r"(?i)\bR-?\d+\s*(?:to|and|&|,|-)\s*R?-?\d+", r"(?i)\bR-?\d+(?:\s*(?:,|and|&)\s*R?-?\d+)*", r"(?i)\b(?:E\.?O|J\.?C(?:/E\.?O)?|Executive Officer|Joint Commissioner|Commissioner|Thakkar|Madathipathi|Chairman[^,]{0,30})\b"]
    return F.coalesce(*[F.nullif(F.trim(F.regexp_replace(F.regexp_extract(entry, p, 0), r"\s+", " ")), F.lit("")) for p in found])


def split_party_counsel(cell: Column) -> Column:
    """struct(party, advocates: array(struct(name, side_detail))) of a cell with parties and their counsel."""
    text = F.trim(F.coalesce(cell, F.lit("")))
    parts = F.split(text, K.PARTY_FIRST)
    links = F.regexp_extract_all(text, F.lit(K.PARTY_FIRST), F.lit(0))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), r"[\s.,]+$", ""))
    name = lambda c: bare(F.regexp_replace(F.trim(c), K.HONORIFIC, ""))
    before = lambda i: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), i), lambda k: F.concat(F.when(k > 0, F.get(links, k - 1)).otherwise(""), F.get(parts, k))), ""))
    cut = lambda c: F.regexp_replace(F.trim(c), r"(?s)(?<=.)\s\d{1,2}\s*\.+\s*(?=[A-Z]).*$", "")
    each = F.transform(F.sequence(F.lit(0), F.size(links) - 1), lambda i: F.struct(name(cut(F.get(parts, i + 1))).alias("name"), respondent_numbering(before(i)).alias("side_detail")))
    counsel_first = text.rlike(K.COUNSEL_FIRST)
    head, tail = (F.regexp_extract(text, rf"(?is)^(.*?){K.COUNSEL_FIRST[4:]}(.*)$", k) for k in (1, 2))
    one = F.array(F.struct(name(head).alias("name"), respondent_numbering(F.substring(text, F.length(head) + 1, F.length(text))).alias("side_detail")))
    none = F.expr("cast(array() as array<struct<name: string, side_detail: string>>)")
    advocates = F.filter(F.when(F.size(links) > 0, each).when(counsel_first, one).otherwise(none), lambda a: a["name"] != "")
    party = F.when(F.size(links) > 0, bare(F.get(parts, F.lit(0)))).when(counsel_first, bare(tail)).otherwise(text)
    return F.struct(party.alias("party"), advocates.alias("advocates"))


# Page context ------------------------------------------------------------------------------------------------------


def page_context(page_lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, page, court, hall, coram, list_type); what a page does not state is carried from the page before."""
    x = page_lines.join(pages.select(*PAGE, F.col("width").alias("page_width")), PAGE)
    last = F.max("line").over(Window.partitionBy(*PAGE))
    middle = F.abs(F.col("x0") + F.col("width") / 2 - F.col("page_width") / 2) < F.col("page_width") * 0.12
    top, foot = F.col("line") < 14, F.col("line") > last - 6
    text = F.col("text")
    x = x.withColumns(
        {
            "_court": F.when(middle & (F.length(text) > 8), F.trim(text)),
            "_hall": F.when(top, F.nullif(F.regexp_extract(text, K.HALL, 1), F.lit(""))),
            "_coram": F.when(top & text.rlike(K.CORAM) & text.rlike("(?i)CORAM|HON"), F.trim(F.regexp_replace(text, r"(?i)^\s*CORAM\s*:?\s*", ""))),
            "_type": F.when(foot, F.nullif(F.trim(F.regexp_extract(text, K.LIST_TYPE, 1)), F.lit(""))),
        }
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("line")))
    own = pages.select(*PAGE).join(x.groupBy(*PAGE).agg(first("_court").alias("court"), first("_hall").alias("hall"), first("_coram").alias("coram"), first("_type").alias("list_type")), PAGE, "left")
    so_far = Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first("court", ignorenulls=True).over(so_far)
    real = F.last(F.when(F.col("court").rlike("(?i)COURT|COMMISSION|TRIBUNAL|FORUM"), F.col("court")), ignorenulls=True).over(so_far)
    own = own.withColumn("court", F.coalesce(real, start))
    return own.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in ("hall", "coram", "list_type")})


# Items -------------------------------------------------------------------------------------------------------------


def _keys(cells_: DataFrame, id_col: str, cell_col: str) -> DataFrame:
    keys, _ = expand_case_cells(cells_, id_col, cell_col)
    return keys.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("key_ord", "case_key"))), lambda k: k["case_key"]).alias("case_keys"))


def _none() -> Column:
    return F.expr("cast(array() as array<string>)")


def ruled_rows(table_cells: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows of ruled tables as arrays of (c, name, role, side, label, text), with serial and case cell; headings are left out.

    A heading is a first row without a digit in its case cell and with a heading's words. A blank serial is carried; without a
    column of serials rows count from 1.
    """
    at = [*PAGE, "table_no"]
    x = table_cells.join(small(roles), ["file", "n_cols", "c"])
    rows = x.groupBy(*at, "r").agg(F.first("top").alias("top"), F.first("bot").alias("bot"), F.array_sort(F.collect_list(F.struct("c", "name", "role", "side", "label", "text"))).alias("cols"))
    of = lambda role: F.get(F.transform(F.filter("cols", lambda c: c["role"] == role), lambda c: c["text"]), F.lit(0))
    whole = F.array_join(F.transform("cols", lambda c: c["text"]), " ")
    heading = (F.col("r") == 0) & ~F.coalesce(of("caseNumber"), F.lit("")).rlike(r"\d") & whole.rlike(r"(?i)\b(case|no|s\.?\s*no|serial|petitioner|respondent|advocate|temple|subject|section|sec)\b")
    reposting = F.max(F.exists("cols", lambda c: c["name"] == "repostedTo") | ((F.col("r") == 0) & whole.rlike("(?i)reposted"))).over(Window.partitionBy(*at))
    rows = rows.withColumns({"heading": heading, "reposting": reposting, "case_cell": F.coalesce(of("caseNumber"), F.lit("")), "printed": F.when(of("index").isNull(), (F.col("r") + 1).cast("string")).otherwise(F.nullif(F.regexp_extract(of("index"), r"\d+", 0), F.lit("")))})
    rows = rows.filter(~F.col("heading") & F.col("case_cell").rlike(r"\d"))
    serial = F.last("printed", ignorenulls=True).over(Window.partitionBy(*at).orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"item_no": F.coalesce(serial, F.lit("")), "item_no_inherited": F.col("printed").isNull() & serial.isNotNull()})
    raw = F.array_join(F.filter(F.transform("cols", lambda c: c["text"]), lambda t: t != ""), "  |  ")
    return rows.withColumns({"item_id": F.concat_ws(":", "file", F.col("page").cast("string"), F.lit("t"), F.col("table_no").cast("string"), F.col("r").cast("string")), "raw_text": raw})


def ruled_items(rows: DataFrame, context: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and their names from the rows of cause-list tables."""
    rows = rows.filter(~F.col("reposting")).join(_keys(rows, "item_id", "case_cell"), "item_id", "left").join(context, PAGE, "left").join(pages.select(*PAGE, "was_ocr"), PAGE, "left")
    party = F.filter("cols", lambda c: c["role"].isin("party", "party+counsel") & (c["text"] != ""))
    split = F.transform(party, lambda c: F.struct(c["c"], c["side"], F.when(c["role"] == "party", F.struct(c["text"].alias("party"), F.expr("cast(array() as array<struct<name: string, side_detail: string>>)").alias("advocates"))).otherwise(split_party_counsel(c["text"])).alias("s")))
    rows = rows.withColumn("_split", split)
    side = lambda wanted: F.coalesce(F.try_element_at(F.transform(F.filter("_split", lambda c: c["side"].eqNullSafe(F.lit("respondent")) == F.lit(wanted == "respondent")), lambda c: c["s"]["party"]), F.lit(-1)), F.lit(""))
    extras = F.filter("cols", lambda c: (c["role"] == "extra") & (c["text"] != ""))
    extra = F.map_from_entries(F.transform(extras, lambda c: F.struct(c["label"], c["text"])))
    items = rows.select("item_id", *PAGE, F.col("file").alias("source_file"), "court", "hall", "coram", "list_type", "item_no", "item_no_inherited", F.array("case_cell").alias("case_numbers"), F.coalesce("case_keys", _none()).alias("case_keys"), side("petitioner").alias("petitioner"), side("respondent").alias("respondent"), "raw_text", extra.alias("extra"), "was_ocr", F.col("top").alias("y_top"), F.col("bot").alias("y_bot"))
    parties = rows.select("item_id", F.explode("_split").alias("s")).filter("s.s.party <> ''").select("item_id", (F.col("s.c") * 1000).alias("name_ord"), F.col("s.s.party").alias("name"), F.lit("party").alias("match_role"), F.col("s.side").alias("side"), F.lit(None).cast("string").alias("side_detail"))
    advocates = rows.select("item_id", F.explode("_split").alias("s")).select("item_id", F.col("s.c").alias("c"), F.col("s.side").alias("side"), F.posexplode("s.s.advocates").alias("n", "a"))
    advocates = advocates.select("item_id", (F.col("c") * 1000 + 1 + F.col("n")).alias("name_ord"), F.col("a.name").alias("name"), F.lit("counsel").alias("match_role"), "side", F.col("a.side_detail").alias("side_detail"))
    counsel = rows.select("item_id", F.explode(F.filter("cols", lambda c: c["role"] == "counsel")).alias("c")).select("item_id", F.col("c.c").alias("c"), F.posexplode(F.split("c.text", r"\s{2,}|\n")).alias("n", "name")).filter(~is_noise(F.col("name")))
    counsel = counsel.select("item_id", (F.col("c") * 1000 + 1 + F.col("n")).alias("name_ord"), F.trim("name").alias("name"), F.lit("counsel").alias("match_role"), F.lit("unknown").alias("side"), F.lit(None).cast("string").alias("side_detail"))
    return items, _named(parties.unionByName(advocates).unionByName(counsel))


def _named(names: DataFrame) -> DataFrame:
    out = names.withColumns({"side": F.coalesce("side", F.lit("unknown")), "source": F.lit("A"), "near_only": F.lit(False), "advocate_key": F.lit(None).cast("string"), "confirmed_by_both": F.lit(False)})
    return out.select("item_id", F.col("name_ord").cast("int").alias("name_ord"), *NAME)


def ruled_notices(rows: DataFrame) -> DataFrame:
    """Reposted matters from the rows of notice tables; a date in a merged cell is read off the page."""
    rows = rows.filter("reposting").join(_keys(rows, "item_id", "case_cell"), "item_id", "left")
    cell = F.coalesce(F.get(F.transform(F.filter("cols", lambda c: (c["name"] == "repostedTo") | (c["role"] == "extra")), lambda c: c["text"]), F.lit(0)), F.lit(""))
    return rows.select(F.xxhash64("item_id").alias("_h"), *PAGE, "table_no", "r", F.col("file").alias("source_file"), F.coalesce("case_keys", _none()).alias("case_keys"), dates_iso(cell).alias("reposted_to"), F.nullif(F.trim(F.regexp_extract(cell, K.REPOST_TIME, 1)), F.lit("")).alias("reposted_time"), F.lit("ruled").alias("date_confidence")).withColumn("notice_ord", F.col("page").cast("long") * 1_000_000 + F.col("table_no") * 10_000 + F.col("r")).drop("_h", "table_no", "r")


def line_notices(page_lines: DataFrame) -> DataFrame:
    """Reposted matters from pages without rules; a line without a date takes that of a line before, as inferred."""
    x = page_lines.withColumn("_m", case_mentions(F.col("text"))).filter(F.size("_m") > 0)
    x = x.withColumns({"_d": dates_iso(F.col("text")), "_id": F.concat_ws(":", "file", F.col("page").cast("string"), F.col("line").cast("string")), "_cell": F.array_join("_m", ", ")})
    x = x.withColumn("_both", F.when(F.col("_d").isNotNull(), F.struct("_d", F.nullif(F.trim(F.regexp_extract("text", K.REPOST_TIME, 1)), F.lit("")).alias("t"))))
    above = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_both", F.last("_both", ignorenulls=True).over(above)).join(_keys(x, "_id", "_cell"), "_id", "left")
    return x.select(*PAGE, F.col("file").alias("source_file"), F.coalesce("case_keys", _none()).alias("case_keys"), F.col("_both._d").alias("reposted_to"), F.col("_both.t").alias("reposted_time"), F.when(F.col("_d").isNotNull(), "ruled").otherwise("inferred").alias("date_confidence"), (F.col("page").cast("long") * 1_000_000 + F.col("line")).alias("notice_ord"))


def column_items(page_lines: DataFrame, pages: DataFrame, spans: DataFrame, context: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and their names from pages without rules: a number and a case open an item, a footer closes it."""
    x = page_lines.join(counsel_columns(pages, spans), PAGE).join(pages.select(*PAGE, "height", "was_ocr"), PAGE)
    x = x.withColumns({"left": joined(F.filter("spans", lambda s: s["x"] < F.col("counsel_x"))), "right": joined(F.filter("spans", lambda s: s["x"] >= F.col("counsel_x")))})
    footer = F.col("text").rlike(K.LIST_TYPE) | ((F.col("y") < F.col("height") * 0.07) & F.col("text").rlike(r"^\s*\d+\s*/\s*\d+\b"))
    head = F.coalesce(F.nullif("left", F.lit("")), F.col("text"))
    x = x.withColumns({"footer": footer, "head": head, "opens": ~footer & head.rlike(K.ITEM_START)})
    so_far = Window.partitionBy(*PAGE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("item", F.sum(F.col("opens").cast("int")).over(so_far))
    inside = Window.partitionBy(*PAGE, "item").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("closed", F.max(F.col("footer").cast("int")).over(inside) == 1).filter((F.col("item") > 0) & ~F.col("closed"))
    x = x.withColumn("item_id", F.concat_ws(":", "file", F.col("page").cast("string"), F.lit("c"), F.col("item").cast("string")))
    tail = F.trim(F.substring("head", F.length(F.regexp_extract("head", K.ITEM_START, 0)) + 1, F.length("head")))
    own = F.when(F.col("opens"), F.when(F.col("left") == "", "").otherwise(tail)).otherwise(F.col("left"))
    x = x.withColumn("own", own)
    versus = (F.col("opens") & F.col("own").rlike(r"(?i)\bVS\b")) | (~F.col("opens") & F.col("own").rlike(r"(?i)^VS\b"))
    x = x.withColumn("own", F.when(~F.col("opens") & F.col("own").rlike("^-+$"), "").otherwise(F.col("own")))
    x = x.withColumns({"vs": versus, "past_vs": F.max(versus.cast("int")).over(inside) == 1, "divider": F.col("right").rlike(K.DIVIDER)})
    x = x.withColumn("below", F.max(F.col("divider").cast("int")).over(inside) == 1)
    second = F.col("past_vs") & ~F.col("opens")
    said = F.trim(F.when(~F.col("opens"), F.regexp_replace("own", r"(?i)^VS\b\.?\s*", "")).otherwise(F.col("own")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["v"])
    entry = lambda when, v: F.when(when & (v != ""), F.struct("line", v.alias("v")))
    more = F.when(~F.col("opens") & F.col("left").rlike(r"(?i)^AND\b") & F.col("left").rlike(r"\d{4}"), F.struct("line", case_mentions(F.col("left")).alias("v")))
    start = F.max_by(F.struct(F.regexp_extract("head", K.ITEM_START, 1).alias("no"), F.regexp_replace(F.regexp_extract("head", K.ITEM_START, 2), r"\s+", "").alias("case")), F.when(F.col("opens"), 1))
    g = x.groupBy("item_id", *PAGE).agg(start.alias("s"), F.array_join(ordered(entry(~second, said)), " ").alias("p"), F.array_join(ordered(entry(second, said)), " ").alias("q"), F.flatten(ordered(more)).alias("more"), F.array_join(ordered(F.struct("line", F.col("text").alias("v"))), "\n").alias("raw_text"), F.max("y").alias("y_top"), F.min("y").alias("y_bot"), F.any_value("was_ocr").alias("was_ocr"))
    halves = F.split("p", r"(?i)\bVS\b", 2)
    split = (F.col("q") == "") & (F.size(halves) > 1)
    g = g.withColumns({"petitioner": F.trim(F.when(split, F.get(halves, F.lit(0))).otherwise(F.col("p"))), "respondent": F.trim(F.when(split, F.get(halves, F.lit(1))).otherwise(F.col("q"))), "case_numbers": F.concat(F.array("s.case"), F.coalesce("more", _none()))})
    first = _keys(g.select("item_id", F.col("s.case").alias("cell")), "item_id", "cell").withColumnRenamed("case_keys", "k1")
    later = _keys(g.select("item_id", F.array_join("more", ",").alias("cell")), "item_id", "cell").withColumnRenamed("case_keys", "k2")
    g = g.join(first, "item_id", "left").join(later, "item_id", "left").join(context, PAGE, "left")
    keys = F.array_distinct(F.concat(F.coalesce("k1", F.array(case_key(F.col("s.case")))), F.coalesce("k2", _none())))
    items = g.select("item_id", *PAGE, F.col("file").alias("source_file"), "court", "hall", "coram", "list_type", F.col("s.no").alias("item_no"), F.lit(False).alias("item_no_inherited"), "case_numbers", keys.alias("case_keys"), "petitioner", "respondent", "raw_text", F.expr("cast(map() as map<string, string>)").alias("extra"), "was_ocr", "y_top", "y_bot")
    names = x.filter(~is_noise(F.col("right")) & ~F.col("divider")).select("item_id", F.col("line").alias("name_ord"), F.col("right").alias("name"), F.lit("counsel").alias("match_role"), F.when(F.col("below"), "respondent").otherwise("petitioner").alias("side"), F.lit(None).cast("string").alias("side_detail"))
    return items, _named(names)


# The sweep ---------------------------------------------------------------------------------------------------------


def sweep(page_lines: DataFrame, pages: DataFrame, roster: DataFrame, most: int = 5) -> DataFrame:
    """The best run of words of each line for each advocate that it reads as: file, page, y, printed, person, combined."""
    runs = page_lines.select(*PAGE, "line", "y", F.posexplode(name_windows(F.col("text"), most)).alias("ord", "name"))
    runs = runs.join(pages.select(*PAGE, "was_ocr"), PAGE)
    found = link_names(roster, runs, ocr=True).select("q_name", F.col("c_name").alias("name"), "combined", "core", "state", "tier_rank")
    hits = runs.join(found, "name").filter(classify(F.col("core"), F.col("combined"), F.col("state"), F.col("was_ocr")) > 0)
    return first_by(hits.withColumn("yr", F.round("y")), [*PAGE, "q_name", "yr"], [F.desc("combined"), F.col("line"), F.col("ord")]).select(*PAGE, "line", "y", F.col("name").alias("printed"), F.col("q_name").alias("advocate"), letters(F.col("q_name")).alias("person"), "combined")


def nearest_items(points: DataFrame, items: DataFrame, reach: float = 40.0) -> DataFrame:
    """points (file, page, y, ...) with item_id and within: the item whose band holds the point, else the nearest within reach.

    Points and bands of a page are sorted together and swept, so no pairs are made. Of the bands that begin at or below a
    point the one with the highest top holds it, if any does. If none does, the nearest is the highest top below the
    point, or the lowest bottom of the bands whose top is not below it. Ties: the higher top, then the first item.
    """
    keys = list(points.columns)
    band = F.struct(F.col("y_top").cast("double").alias("y_top"), F.col("y_bot").cast("double").alias("y_bot"), "item_id")
    bands_ = items.filter("file is not null and page is not null and y_top is not null").select(*PAGE, band.alias("b"))
    marks = points.distinct().select(*PAGE, F.struct(*keys).alias("p")).unionByName(bands_, allowMissingColumns=True)
    y, b = F.col("p.y"), F.col("b")
    marks = marks.withColumns({"_from": F.when(b.isNull(), y).otherwise(b["y_bot"] - 1), "_top": F.when(b.isNull(), y).otherwise(b["y_top"]), "_point": b.isNull()})
    sweep_by = lambda *order: Window.partitionBy(*PAGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upward, below, down = sweep_by("_from", "_point"), sweep_by("_top", F.desc("_point")), sweep_by(F.desc("_top"), "_point")
    highest = F.min_by(b, F.when(b.isNotNull(), F.struct((-b["y_top"]).alias("k"), b["item_id"])))
    begun = F.min_by(b, F.when(b["y_bot"].isNotNull(), F.struct((-b["y_top"]).alias("k"), b["item_id"])))
    lowest = F.min_by(b, F.when(b["y_bot"].isNotNull(), F.struct(b["y_bot"], (-b["y_top"]).alias("k"), b["item_id"])))
    swept = marks.withColumn("_in", begun.over(upward)).withColumn("_under", highest.over(below)).withColumn("_over", lowest.over(down)).filter("_point")
    within = F.coalesce(y <= F.col("_in.y_top") + 1, F.lit(False))
    choice = lambda c, gap: F.when(gap.isNotNull(), F.struct(gap.alias("gap"), (-c["y_top"]).alias("k"), c["item_id"]))
    nearest = F.array_min(F.filter(F.array(choice(F.col("_under"), y - F.col("_under.y_top")), choice(F.col("_over"), F.col("_over.y_bot") - y)), lambda c: c.isNotNull()))
    near = F.when(nearest["gap"] <= reach, nearest["item_id"])
    return swept.select("p.*", F.when(within, F.col("_in.item_id")).otherwise(near).alias("item_id"), within.alias("within"))


def reconcile(items: DataFrame, names: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, names) with the sweep's findings: confirmed names, party names, unplaced names, orphan items, low pages."""
    flat = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z]", "")
    same = lambda a, b: (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    where = items.select("item_id", *PAGE)
    counsel = names.filter("source = 'A' and match_role = 'counsel'").join(where, "item_id").select(*PAGE, flat(F.col("name")).alias("a")).distinct()
    hits = hits.withColumn("f", flat(F.col("printed")))
    page_names = counsel.groupBy(*PAGE).agg(F.collect_set("a").alias("placed"))
    hits = hits.join(page_names, PAGE, "left").withColumn("also", F.exists(F.coalesce("placed", _none()), lambda a: same(a, F.col("f"))))
    party = items.select(*PAGE, "item_id", F.explode(F.array("petitioner", "respondent")).alias("t")).unionByName(names.filter("source = 'A' and match_role = 'party'").join(where, "item_id").select(*PAGE, "item_id", F.col("name").alias("t")))
    party = party.select(*PAGE, "item_id", flat(F.col("t")).alias("t")).filter("t <> ''").distinct()
    only = hits.filter(~F.col("also"))
    in_party = only.filter(F.length("f") >= 4).join(party, PAGE).filter(F.contains(F.col("t"), F.col("f")))
    in_party = first_by(in_party, [*PAGE, "line", "advocate"], [F.col("item_id")]).select(*PAGE, "line", "advocate", F.col("item_id").alias("party_item"))
    only = only.join(in_party, [*PAGE, "line", "advocate"], "left")
    low = only.filter("party_item is null").groupBy(*PAGE).agg(F.count("*").alias("n")).filter(F.col("n") >= K.LOW_PAGE_HITS).join(counsel.select(*PAGE).distinct(), PAGE, "left_anti").select(*PAGE, F.lit(True).alias("low_page"))
    confirmed = hits.filter("also").groupBy(*PAGE).agg(F.collect_set("f").alias("seen"))
    names = names.join(where, "item_id").join(confirmed, PAGE, "left")
    names = names.withColumn("confirmed_by_both", (F.col("source") == "A") & F.exists(F.coalesce("seen", _none()), lambda b: same(b, flat(F.col("name"))))).drop("seen", *PAGE)
    placed = nearest_items(only.select(*PAGE, "line", "y", "printed", "advocate", "person", "combined", "party_item"), items)
    host = F.coalesce("party_item", "item_id")
    orphan = F.concat_ws(":", "file", F.col("page").cast("string"), F.lit("o"), F.round("y").cast("long").cast("string"))
    placed = placed.withColumns({"host": F.coalesce(host, orphan), "orphan": host.isNull()})
    best = first_by(placed, ["host", "advocate"], [F.desc("combined"), F.col("line")])
    added = best.select(F.col("host").alias("item_id"), (F.col("line") + 1_000_000).cast("int").alias("name_ord"), F.col("printed").alias("name"), F.when(F.col("party_item").isNotNull(), "party").otherwise("unplaced").alias("match_role"), F.lit("unknown").alias("side"), F.lit(None).cast("string").alias("side_detail"), F.lit("B").alias("source"), (F.col("party_item").isNull() & ~F.col("within") & ~F.col("orphan")).alias("near_only"), F.col("person").alias("advocate_key"), F.lit(False).alias("confirmed_by_both"))
    orphans = best.filter("orphan").groupBy("host", *PAGE).agg(F.max("y").alias("y_top"), F.first("printed").alias("raw_text"))
    orphans = orphans.select(F.col("host").alias("item_id"), *PAGE, F.col("file").alias("source_file"), "raw_text", "y_top", F.col("y_top").alias("y_bot"), _none().alias("case_numbers"), _none().alias("case_keys"))
    items = items.unionByName(orphans, allowMissingColumns=True).join(low, PAGE, "left").withColumns({"low_page": F.coalesce("low_page", F.lit(False)), "was_ocr": F.coalesce("was_ocr", F.lit(False))})
    return items, names.unionByName(added)


def bad_files(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(file, low_share) of files of which too many pages could not be read with confidence."""
    low = items.filter("low_page").select(*PAGE).distinct().withColumn("l", F.lit(1))
    return pages.select(*PAGE).join(low, PAGE, "left").groupBy("file").agg(F.avg(F.coalesce("l", F.lit(0))).alias("low_share")).filter(F.col("low_share") > K.LOW_FILE_SHARE)


def bad_pages(items: DataFrame, page_lines: DataFrame, most: int = 4000) -> DataFrame:
    """(file, page, why, text) of pages whose columns could not be separated, with the beginning of their text to look at."""
    low = items.filter("low_page").select(*PAGE).distinct()
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n")
    pages = page_lines.join(low, PAGE, "left_semi").groupBy(*PAGE).agg(F.substring(text, 1, most).alias("text"))
    return pages.select(*PAGE, F.lit("names were found, but none where counsel names sit").alias("why"), "text")


def read_documents(pages: DataFrame, spans: DataFrame, hsegs: DataFrame, vsegs: DataFrame, roster: DataFrame) -> dict[str, DataFrame]:
    """All that documents given as spans and rules hold, by name: items, item_names, reposted, and how they were read."""
    page_lines, table_cells = written(lines(spans)), written(cells(spans, hsegs, vsegs))
    types = written(detect_types(page_lines))
    roles = written(assign_roles(table_cells, types))
    context = written(page_context(page_lines, pages))
    rows = written(ruled_rows(table_cells, roles))
    a_items, a_names = ruled_items(rows, context, pages)
    open_pages = pages.join(table_cells.select(*PAGE).distinct(), PAGE, "left_anti")
    notice = types.filter("doc_type = 'adjournment'").select("file")
    list_pages, notice_pages = open_pages.join(notice, "file", "left_anti"), open_pages.join(notice, "file", "left_semi")
    on = lambda p: page_lines.join(p.select(*PAGE), PAGE, "left_semi")
    b_items, b_names = column_items(on(list_pages), list_pages, spans, context)
    items, names = written(a_items.unionByName(b_items)), written(a_names.unionByName(b_names))
    swept = written(sweep(page_lines.join(notice, "file", "left_anti"), pages, roster))
    items, names = (written(df) for df in reconcile(items, names, swept))
    reposted = ruled_notices(rows).unionByName(line_notices(on(notice_pages)))
    return {"items": items, "item_names": names, "reposted": reposted, "types": types, "roles": roles, "bad_files": bad_files(items, pages), "bad_pages": bad_pages(items, page_lines), "capped_ranges": expand_case_cells(rows, "item_id", "case_cell")[1], "probes": probe_columns(table_cells), "lines": page_lines}

"""Rosters and registers from text, delimited files and workbooks, with columns found by fuzzy headers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline import constants as K
from tallyline.functions.similarity import jaro_winkler, ratio
from tallyline.functions.text import case_key, case_key_from_parts, clean, letters

CELLS = "ord long, cells array<string>"


def _tag(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _column_number(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def workbook_rows(data: bytes) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet (xlsx, xlsm, ods) as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "content.xml" in z.namelist():
            sheet = next(e for e in ElementTree.fromstring(z.read("content.xml")).iter() if _tag(e) == "table")
            for row in (e for e in sheet.iter() if _tag(e) == "table-row"):
                out: list[str] = []
                for cell in (e for e in row if _tag(e) in ("table-cell", "covered-table-cell")):
                    text = "\n".join("".join(p.itertext()) for p in cell if _tag(p) == "p")
                    times = next((int(v) for k, v in cell.attrib.items() if k.endswith("number-columns-repeated")), 1)
                    out += [text] * (times if text else min(times, 64))
                yield out
            return
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(si) == "si"]
        sheets = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for row in (e for e in ElementTree.fromstring(z.read(sheets[0])).iter() if _tag(e) == "row"):
            cells: dict[int, str] = {}
            for k, c in enumerate(e for e in row if _tag(e) == "c"):
                value = "".join(t.text or "" for t in c.iter() if _tag(t) in ("v", "t"))
                cells[_column_number(c.attrib["r"]) if "r" in c.attrib else k] = shared[int(value)] if c.attrib.get("t") == "s" else value
            yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            rows = list(workbook_rows(content))
            yield pd.DataFrame({"ord": range(len(rows)), "cells": rows})


def separator(line: str) -> str:
    """The most frequent of comma, semicolon and tab outside quotes; the first of equals."""
    plain = re.sub(r'"[^"]*"', "", line)
    return max(",;\t", key=plain.count)


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """(ord, cells): the rows of a file that are not blank, cells trimmed, in the file's order."""
    kind = path.lower().rsplit(".", 1)[-1]
    if kind in ("xlsx", "xlsm", "ods"):
        rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_workbooks, CELLS)
    else:
        first = spark.read.text(path).limit(1).collect()  # the line that shows the separator
        sep = "\t" if kind == "tsv" else separator(first[0][0]) if first else ","
        raw = spark.read.option("header", False).option("sep", sep).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
        rows = raw.select(F.monotonically_increasing_id().alias("ord"), F.array(*raw.columns).alias("cells"))
    rows = rows.select("ord", F.transform("cells", lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\u00A0\\uFEFF]", " "))).alias("cells"))
    return rows.filter(F.exists("cells", lambda c: c != ""))


def _header(text: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).upper()
    return " ".join(re.sub(r"[^A-Z0-9]", " ", plain).split())


def header_score(cell: str, spellings: list[str]) -> float:
    """How well a header cell fits a field's known spellings."""
    h = _header(cell)
    scores = [max(ratio(h, p), jaro_winkler(h, p), float(h == p), 0.9 if p in h and len(p) >= 4 else 0.0) for p in map(_header, spellings)]
    return max(scores, default=0.0) if h else 0.0


def detect_columns(header: list[str], fields: dict[str, list[str]]) -> dict[str, int]:
    """Field to column: the strongest pairs first, each field and column once; ties in the order of fields, then columns."""
    pairs = [(header_score(cell, spellings), f, i) for f, spellings in fields.items() for i, cell in enumerate(header)]
    found: dict[str, int] = {}
    for s, f, i in sorted(pairs, key=lambda p: -p[0]):
        if s >= K.HEADER_MIN and f not in found and i not in found.values():
            found[f] = i
    return found


def _cell(columns: dict[str, int], field: str) -> Column:
    return clean(F.get("cells", F.lit(columns[field]))) if field in columns else F.lit(None).cast("string")


def first_row(rows: DataFrame) -> list[str]:
    got = rows.agg(F.min_by("cells", "ord").alias("cells")).first()
    return list(got["cells"]) if got["cells"] is not None else []


def _numbered(roster: DataFrame) -> DataFrame:
    """The first of each person, numbered in order; a roster is a short list."""
    roster = roster.withColumn("_k", letters(F.col("name"))).filter("_k <> ''")
    roster = roster.withColumn("_n", F.row_number().over(Window.partitionBy("_k").orderBy("ord"))).filter("_n = 1")
    return roster.select(F.col("ord").alias("advocate_ord"), "name", "enrolment", "role")


def parse_roster(rows: DataFrame, override: dict[str, int] | None = None) -> DataFrame:
    """(advocate_ord, name, enrolment, role) of a sheet's rows; without a name column the first column holds names."""
    columns = detect_columns(first_row(rows), K.ROSTER_HEADERS) | (override or {})
    if "name" in columns:
        rows = rows.join(F.broadcast(rows.agg(F.min("ord").alias("_head"))), F.col("ord") > F.col("_head")).drop("_head")
    columns.setdefault("name", 0)
    out = rows.select("ord", *[_cell(columns, f).alias(f) for f in ("name", "enrolment", "role")])
    return _numbered(out.filter(F.col("name").isNotNull() & ~F.col("name").rlike(r"(?i)^(s\.?\s*no\.?|sl\.?\s*no\.?|#)$")))


def parse_roster_lines(lines: DataFrame) -> DataFrame:
    """A roster of (ord, value) lines: a name, and an enrolment and role after separators."""
    lines = lines.select("ord", clean(F.col("value")).alias("line")).filter("line is not null")
    parts = F.split("line", r"\s*[,\t;|]\s*")
    lines = lines.filter(~F.col("line").rlike(r"(?i)^(advocate|name|counsel)s?( name)?$"))
    return _numbered(lines.select("ord", *[clean(F.get(parts, F.lit(k))).alias(f) for k, f in enumerate(("name", "enrolment", "role"))]).filter("name is not null"))


def read_roster(spark: SparkSession, path: str, override: dict[str, int] | None = None) -> DataFrame:
    if path.lower().endswith(".txt"):
        return parse_roster_lines(spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.regexp_replace("value", "\t", ",").alias("value")))
    return parse_roster(sheet(spark, path), override)


def parse_register(rows: DataFrame, override: dict[str, int] | None = None) -> DataFrame:
    """Register rows: case_ord, case_key, all known fields, raw (every column as it was). The first row is the header.

    The key comes from type, number and year, else from the number, else from a cell that looks like one. Rows
    without any identity are left out.
    """
    header = first_row(rows)
    columns = detect_columns(header, K.REGISTER_HEADERS) | (override or {})
    rows = rows.join(F.broadcast(rows.agg(F.min("ord").alias("_head"))), F.col("ord") > F.col("_head"))
    fields = {f: _cell(columns, f) for f in K.REGISTER_HEADERS}
    looks = F.get(F.filter("cells", lambda c: c.rlike(r"\d{1,6}\s*/\s*\d{4}")), F.lit(0))
    kind, number, year = fields["case_type"], fields["case_no"], fields["year"]
    whole = F.coalesce(number, looks)
    key = F.when(kind.isNotNull() & number.isNotNull() & year.isNotNull(), case_key_from_parts(kind, number, year)).when(whole.isNotNull(), case_key(whole))
    names = [h or f"Column {i + 1}" for i, h in enumerate(header)]
    names = [n for i, n in enumerate(names) if n not in names[:i]]
    raw = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")) for i in range(len(names))])) if names else F.expr("cast(map() as map<string, string>)")
    out = rows.select(F.col("ord").alias("case_ord"), F.nullif(key, F.lit("")).alias("case_key"), *[c.alias(f) for f, c in fields.items()], raw.alias("raw"))
    return out.filter(F.coalesce("case_key", "cnr", "cause_title", "party_name", "diary_no").isNotNull())


def read_register(spark: SparkSession, path: str, override: dict[str, int] | None = None) -> DataFrame:
    """parse_register() of a file, with the file and the time of loading."""
    return parse_register(sheet(spark, path), override).withColumns({"source_filename": F.lit(path.rsplit("/", 1)[-1]), "uploaded_at": F.current_timestamp()})

"""Expansion of printed case-number cells: lists, ranges, inherited types and back-filled years.

All that a cell holds follows from the cell alone, so it is worked out within its row: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline import constants as K

_PART = "struct<kind: string, year: string, first: bigint, last: bigint>"
_TYPED = rf"^({K.TYPE_PREFIX})\s*(\d+)$"
_SPAN = r"^(\d+)\s*(?:TO|-|–|—)\s*(\d+)$"


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _segments(cell: Column) -> Column:
    """array(struct(own type, year, parts)) of a cell; a part is a struct(p, named: its own type)."""
    text = F.upper(F.coalesce(cell, F.lit("")))
    for pattern, to in (("[\\u00A0]", " "), (r"\bNOS?\b\.?", " "), (r"\bOF\b", "/"), (r"\s*/\s*", "/"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, to)
    raw = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    opened = F.transform(raw, lambda s: F.struct(s.alias("raw"), F.regexp_extract(s, rf"^({K.TYPE_PREFIX})\s*", 0).alias("opener")))
    owned = F.transform(opened, lambda s: F.struct(_given(F.regexp_replace(s["opener"], "[^A-Z]", "")).alias("own"), s["raw"].alias("raw"), F.length(s["opener"]).alias("n")))
    rest = F.transform(owned, lambda s: F.struct(s["own"].alias("own"), F.when(s["own"].isNotNull(), F.substring(s["raw"], s["n"] + 1, F.length(s["raw"]))).otherwise(s["raw"]).alias("rest")))

    def part(p: Column) -> Column:
        named = F.when(p.rlike("^[A-Z]"), _given(F.regexp_replace(F.regexp_extract(p, _TYPED, 1), "[^A-Z]", "")))
        return F.struct(p.alias("p"), named.alias("named"))

    parts = lambda r: F.transform(F.transform(F.split(F.regexp_replace(r, r"/\s*\d{4}\s*$", ""), r"\s*(?:AND|&)\s*"), lambda s: F.trim(s)), part)
    return F.transform(rest, lambda s: F.struct(s["own"].alias("own"), _given(F.regexp_extract(s["rest"], r"/\s*(\d{4})\s*$", 1)).alias("year"), parts(s["rest"]).alias("parts")))


def _read(part: Column, kind: Column, year: Column) -> Column:
    """A part's kind, year and bounds, null where it is neither a number, a range, nor a number with a type of its own."""
    p = part["p"]
    plain, span = p.rlike(r"^\d+$"), p.rlike(_SPAN)
    bounds = F.when(plain, F.array(p)).when(span, F.split(p, r"\s*(?:TO|-|–|—)\s*")).otherwise(F.array(F.regexp_extract(p, _TYPED, 2)))
    number = lambda i: F.element_at(bounds, i).try_cast("bigint")
    own = F.when(plain | span, kind).otherwise(F.coalesce(part["named"], kind))
    return F.struct(own.alias("kind"), year.alias("year"), number(1).alias("first"), number(-1).alias("last")).cast(_PART)


def case_parts(cell: Column) -> Column:
    """array(struct(kind, year, first, last)) of a cell's numbers and ranges, in order.

    A segment's type holds from its first part on, a part's own type from the next segment on.
    """
    start = F.struct(F.lit(None).cast("string").alias("kind"), F.expr(f"cast(array() as array<{_PART}>)").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kind = F.coalesce(s["own"], a["kind"])
        here = F.transform(F.filter(s["parts"], lambda p: (p["p"] != "") & kind.isNotNull()), lambda p: _read(p, kind, s["year"]))
        later = F.try_element_at(F.filter(F.transform(s["parts"], lambda p: p["named"]), lambda n: n.isNotNull()), F.lit(-1))
        return F.struct(F.coalesce(later, s["own"], a["kind"]).alias("kind"), F.concat(a["out"], here).alias("out"))

    found = F.aggregate(_segments(cell), start, step, lambda a: a["out"])
    return F.filter(found, lambda p: p["first"].isNotNull() & (p["last"] >= p["first"]))


def _dated(parts: Column) -> Column:
    """parts, of which those without a year take that of the next one that has one."""
    start = F.struct(F.lit(None).cast("string").alias("year"), F.expr(f"cast(array() as array<{_PART}>)").alias("out"))

    def step(a: Column, p: Column) -> Column:
        year = F.coalesce(p["year"], a["year"])
        return F.struct(year.alias("year"), F.array_prepend(a["out"], F.struct(p["kind"].alias("kind"), year.alias("year"), p["first"].alias("first"), p["last"].alias("last"))).alias("out"))

    return F.aggregate(F.reverse(parts), start, step, lambda a: a["out"])


def expand_case_cells(cells: DataFrame, id_col: str, cell_col: str) -> tuple[DataFrame, DataFrame]:
    """Keys (id, key_ord, case_key) of all cells, and refused ranges (id, kind, first, last, year, members).

    A part without a year takes that of the next part that has one; a range of more than RANGE_CAP members is
    refused, not expanded. Each row of cells counts by itself.
    """
    read = cells.select(F.col(id_col), case_parts(F.col(cell_col)).alias("_p"))
    fits = F.filter("_p", lambda p: p["last"] - p["first"] < K.RANGE_CAP)
    members = lambda p: F.transform(F.sequence(p["first"], p["last"]), lambda n: F.concat_ws("/", p["kind"], n.cast("string"), p["year"]))
    keys = F.flatten(F.transform(F.filter(_dated(fits), lambda p: p["year"].isNotNull()), members))
    refused = F.explode(F.filter("_p", lambda p: p["last"] - p["first"] >= K.RANGE_CAP))
    final = F.try_element_at(fits, F.lit(-1))["year"]
    refused = read.select(F.col(id_col), final.alias("_final"), refused.alias("_r"))
    return read.select(F.col(id_col), F.posexplode(keys).alias("key_ord", "case_key")), refused.select(F.col(id_col), "_r.kind", "_r.first", "_r.last", F.coalesce("_r.year", "_final").alias("year"), (F.col("_r.last") - F.col("_r.first") + 1).alias("members"))

"""The whole run: items, names, notices, roster, register, memory and ledger to named results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators._common import written
from tallyline.operators.adjournments import apply_adjournments, notice_only
from tallyline.operators.matching import apply_memory, match_items
from tallyline.operators.views import by_advocate, by_case, by_court, colleagues, counts, evidence, export_tables, orphans


@dataclass
class Inputs:
    """items and item_names are needed; see operators.matching for their columns."""

    items: DataFrame
    item_names: DataFrame
    roster: DataFrame
    register: DataFrame
    reposted: DataFrame | None = None
    memory: DataFrame | None = None
    ledger: DataFrame | None = None
    date: str = ""
    warning: str = ""
    more: dict[str, DataFrame] = field(default_factory=dict)


def run(x: Inputs) -> dict[str, DataFrame]:
    """Lazy results by name: matches, adjourned, notice_only, views, counts, notes, evidence, exports."""
    spark = x.items.sparkSession
    matches = written(match_items(x.items, x.item_names, x.roster, x.register))  # all results come from these
    if x.memory is not None:
        matches = apply_memory(matches, x.memory)
    out: dict[str, DataFrame] = dict(x.more)
    if x.reposted is None:
        attending, adjourned = matches, matches.limit(0).withColumn("adjourned", F.lit(None).cast("struct<notice_ord: long, reposted_to: string, reposted_time: string, date_confidence: string, source_file: string, page: int>"))
        only = spark.createDataFrame([], "case_key string, reposted struct<reposted_to: string, reposted_time: string, source_file: string, page: int>, register_case struct<cause_title: string, diary_no: string, attended_by: string>, ledger_title string, identified_from string")
    else:
        attending, adjourned = apply_adjournments(matches, x.reposted)
        only = notice_only(matches, x.reposted, x.register, x.ledger)
    has_register = bool(x.register.head(1))
    lone = x.reposted is not None and bool(x.reposted.head(1)) and not x.items.head(1)
    notes = [("warn", "There are notices but no lists: only matters of the register can be named.")] if lone else []
    out |= {
        "matches": attending,
        "adjourned": adjourned,
        "notice_only": only,
        "by_advocate": by_advocate(attending, x.roster),
        "by_court": by_court(attending),
        "by_case": by_case(attending),
        "orphans": orphans(attending, x.roster),
        "counts": counts(attending, adjourned, only),
        "evidence": evidence(attending, has_register),
        "colleagues": colleagues(attending, x.item_names, x.roster),
        "notes": spark.createDataFrame(notes, "level string, text string"),
    }
    return out | {f"export_{k}": df for k, df in export_tables(attending, adjourned, only, x.roster, x.date, x.warning).items()}

"""Notices that repost matters supersede listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.tiers import rank, tier_of
from tallyline.operators._common import first_by, least_by, small
from tallyline.operators.matching import REGISTER_FIELDS, register_by_key

NOTICE = ["notice_ord", "reposted_to", "reposted_time", "date_confidence", "source_file", "page"]


def notice_keys(reposted: DataFrame) -> DataFrame:
    """The first notice row of each case key."""
    keys = reposted.select("notice_ord", F.posexplode("case_keys").alias("key_ord", "case_key"), F.struct(*NOTICE).alias("notice"))
    return first_by(keys, ["case_key"], [F.col("notice_ord"), F.col("key_ord")])


def apply_adjournments(matches: DataFrame, reposted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attending, adjourned): matches without and with a reposted case key; the first key that is reposted counts.

    A date that was inferred holds the tier at review.
    """
    keys = matches.select("item_id", F.posexplode("case_keys").alias("key_ord", "case_key")).distinct()
    hits = least_by(keys.join(small(notice_keys(reposted).select("case_key", "notice")), "case_key"), ["item_id"], ["key_ord"], ["notice"], "h").select("item_id", F.col("h.notice").alias("adjourned"))
    adjourned = matches.join(hits, "item_id")
    held = F.when(F.col("adjourned.date_confidence") == "inferred", F.least(rank(F.col("tier")), F.lit(2))).otherwise(rank(F.col("tier")))
    return matches.join(hits, "item_id", "left_anti"), adjourned.withColumn("tier", tier_of(held))


def key_overlap(items: DataFrame, reposted: DataFrame) -> DataFrame:
    """One row: case keys of the lists, of the notices, of both, and of the lists alone, with the notices' share that is listed."""
    keys = lambda df, c: df.select(F.explode("case_keys").alias("case_key")).distinct().withColumn(c, F.lit(True))
    both = keys(items, "a").join(keys(reposted, "b"), "case_key", "full")
    n = both.agg(F.count("a").alias("listed"), F.count("b").alias("noticed"), F.count_if(F.col("a") & F.col("b")).alias("both_have"), F.count_if(F.col("a") & F.col("b").isNull()).alias("only_listed"))
    return n.withColumn("share", F.try_divide("both_have", "noticed"))


def notice_only(matches: DataFrame, reposted: DataFrame, register: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Reposted matters of the register, or else of the ledger, that no match has; the first key of a notice row counts."""
    keys = reposted.select("notice_ord", F.posexplode("case_keys").alias("key_ord", "case_key"), F.struct(*NOTICE).alias("reposted"))
    seen = matches.select(F.explode("case_keys").alias("case_key")).distinct()
    keys = keys.join(seen, "case_key", "left_anti")
    keys = keys.join(small(register_by_key(register).select("case_key", F.struct(*REGISTER_FIELDS).alias("register_case"))), "case_key", "left")
    if ledger is None:
        keys = keys.withColumn("ledger_title", F.lit(None).cast("string")).withColumn("in_ledger", F.lit(False))
    else:
        keys = keys.join(small(ledger.select("case_key", F.col("cause_title").alias("ledger_title"), F.lit(True).alias("in_ledger"))), "case_key", "left")
    keys = keys.filter(F.col("register_case").isNotNull() | F.coalesce("in_ledger", F.lit(False)))
    keys = keys.withColumn("identified_from", F.when(F.col("register_case").isNotNull(), "register").otherwise("ledger"))
    return first_by(keys, ["notice_ord"], [F.col("key_ord")]).select("case_key", "reposted", "register_case", "ledger_title", "identified_from")

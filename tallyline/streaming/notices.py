"""Notices that arrive as files, merged into the ledger batch by batch.

There are no windows or watermarks here: a notice has no event time that later ones depend on. Each micro-batch is
merged with the ledger as a whole, and the write that puts the ledger in place notes its number, so a batch that is run
again, after a crash at whatever point, changes nothing. One stream feeds a ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyline.sources.store import LEDGER, Store, ledger_entries, merge_ledger

NOTICES = "notice_ord long, case_keys array<string>, reposted_to string, reposted_time string, date_confidence string, source_file string, page int"


def merge_batch(store: Store, batch: DataFrame, number: int) -> None:
    """Adds the matters of a batch of notices to the ledger, once: the ledger's own pointer notes the last batch."""
    if number <= int(store.note("ledger") or -1):
        return
    none = F.lit(None).cast("string")
    matches = batch.select("case_keys", F.col("notice_ord").alias("seen_ord"), none.alias("petitioner"), none.alias("respondent"), none.alias("advocate"), none.alias("court"), F.struct("reposted_to").alias("adjourned"))
    store.put("ledger", merge_ledger(store.get("ledger", LEDGER), ledger_entries(matches, "")), str(number))


def follow_notices(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Reads what is there and what is new in a folder of JSON notices, then stops."""
    stream = spark.readStream.schema(NOTICES).json(folder)
    return stream.writeStream.foreachBatch(lambda batch, number: merge_batch(store, batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

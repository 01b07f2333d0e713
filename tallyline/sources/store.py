"""Stores that outlive a run: the ledger of matters seen, remembered decisions, and the saved profile."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline import constants as K

LEDGER = "case_key string, cause_title string, parties string, advocate string, court string, dates array<string>, first_seen long"
MEMORY = "confirm_key string, confirmed boolean"
MARKER = "tallyline-profile"


def _hadoop(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Store:
    """Tables under one folder. A write goes to a new version first; a numbered pointer, put in place by one rename, then
    names it, with a note. The pointer with the highest number counts, so a reader or a crash between the two sees the
    table as it was. Older pointers and versions stay until erase() or tidy()."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, path: str) -> list[str]:
        p, fs = _hadoop(self.spark, path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _pointers(self, name: str) -> list[str]:
        return [x for x in self._names(f"{self.folder}/{name}.current") if x.isdigit()]

    def _current(self, name: str) -> tuple[str, str] | None:
        """The version that counts, and its note."""
        found = self._pointers(name)
        if not found:
            return None
        version, _, note = self.spark.read.text(f"{self.folder}/{name}.current/{found[-1]}").first()[0].partition(" ")
        return version, note

    def get(self, name: str, schema: str) -> DataFrame:
        """The table of a name; empty if it was never written."""
        at = self._current(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{at[0]}") if at else self.spark.createDataFrame([], schema)

    def note(self, name: str) -> str:
        """What was noted with the table; empty if nothing was."""
        at = self._current(name)
        return at[1] if at else ""

    def put(self, name: str, df: DataFrame, note: str | None = None) -> None:
        """Replaces a table. Without a note the one before stays."""
        note = self.note(name) if note is None else note
        version = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{version}")
        number = int((self._pointers(name) or ["0"])[-1]) + 1
        folder = f"{self.folder}/{name}.current"
        part, fs = _hadoop(self.spark, f"{folder}/.{version}")
        out = fs.create(part)
        out.write(bytearray(f"{version} {note}\n", "utf-8"))
        out.close()
        if not fs.rename(part, _hadoop(self.spark, f"{folder}/{number:012d}")[0]):
            raise RuntimeError(f"{name} was written by another at the same time")

    def tidy(self, name: str) -> None:
        """Removes versions and pointers that no longer count; only while nothing reads them."""
        at, pointers = self._current(name), self._pointers(name)
        gone = [f"{name}.current/{x}" for x in pointers[:-1]] + [x for x in self._names(self.folder) if at and x.startswith(f"{name}-") and x != at[0]]
        for x in gone:
            p, fs = _hadoop(self.spark, f"{self.folder}/{x}")
            fs.delete(p, True)

    def keys(self) -> list[str]:
        return sorted(x.removesuffix(".current") for x in self._names(self.folder) if x.endswith(".current"))

    def erase(self, name: str | None = None) -> list[str]:
        """Removes one table, or all; the names of what is gone."""
        gone = [k for k in self.keys() if name in (None, k)]
        for own in self._names(self.folder) if gone else []:
            if any(own == f"{k}.current" or own.startswith(f"{k}-") for k in gone):
                p, fs = _hadoop(self.spark, f"{self.folder}/{own}")
                fs.delete(p, True)
        return gone


def ledger_entries(matches: DataFrame, date: str) -> DataFrame:
    """A row per case key of matches: what the ledger would hold of them alone; the first match with a value counts."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    reposted = F.concat(F.lit("reposted "), F.col("adjourned.reposted_to")) if "adjourned" in matches.columns else F.lit(None).cast("string")
    keys = matches.select(F.explode("case_keys").alias("case_key"), F.col("seen_ord"), F.nullif(F.concat_ws(" vs ", given("petitioner"), given("respondent")), F.lit("")).alias("cause_title"), given("petitioner").alias("parties"), F.col("advocate"), given("court").alias("court"), F.coalesce(reposted, F.nullif(F.lit(date), F.lit(""))).alias("date"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen_ord"))).alias(c)
    dates = F.transform(F.array_sort(F.collect_set(F.when(F.col("date").isNotNull(), F.struct("seen_ord", "date")))), lambda d: d["date"])
    return keys.groupBy("case_key").agg(*[first(c) for c in ("cause_title", "parties", "advocate", "court")], F.array_distinct(dates).alias("dates"), F.min("seen_ord").alias("first_seen"))


def merge_ledger(ledger: DataFrame, entries: DataFrame, cap: int = K.LEDGER_CAP) -> DataFrame:
    """ledger with entries: earlier values stay, dates are added, and of more than `cap` matters the first seen go."""
    base = ledger.agg((F.coalesce(F.max("first_seen"), F.lit(-1)) + 1).alias("_base"))  # one row
    new = entries.crossJoin(F.broadcast(base)).withColumn("first_seen", F.col("first_seen") + F.col("_base")).drop("_base")
    both = ledger.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = lambda c: F.min_by(c, F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("_new"))).alias(c)
    dates = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_new", "dates"))), lambda d: d["dates"])))
    merged = both.groupBy("case_key").agg(*[first(c) for c in ("cause_title", "parties", "advocate", "court")], dates.alias("dates"), F.min("first_seen").alias("first_seen"))
    return merged.orderBy(F.desc("first_seen"), F.desc("case_key")).limit(cap)


def remember(memory: DataFrame, decisions: DataFrame) -> DataFrame:
    """memory with decisions (confirm_key, confirmed) written over it; a null decision revokes."""
    return memory.join(decisions.select("confirm_key"), "confirm_key", "left_anti").unionByName(decisions.filter("confirmed is not null"))


def profile_json(store: Store) -> str:
    """The ledger and memory as one JSON text, for carrying to another place."""
    tables = {"ledger": LEDGER, "memory": MEMORY}
    return json.dumps({"marker": MARKER} | {k: [json.loads(r) for r in store.get(k, s).toJSON().collect()] for k, s in tables.items()})  # capped at LEDGER_CAP


def load_profile_json(store: Store, text: str) -> None:
    data = json.loads(text)
    if data.get("marker") != MARKER:
        raise ValueError("Not a profile: the marker is missing.")
    for k, schema in {"ledger": LEDGER, "memory": MEMORY}.items():
        names = [f.split()[0] for f in schema.split(", ")]
        store.put(k, store.spark.createDataFrame([tuple(r.get(n) for n in names) for r in data.get(k, [])], schema))

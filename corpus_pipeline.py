"""A training-data pipeline over documents: language ID, exact dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result and reads it back
as the next one's docs. All stages but the last return the columns of documents, and any others that docs has, whatever
their names. Rows are told apart by id and text, so ids may be null or stand for several texts. An empty table gives an empty
result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm._frames import row_key, written
from tallyline.llm.exact_dedup import exact_dedup
from tallyline.llm.language_id import UNKNOWN, held_out_fifth, language_id
from tallyline.llm.mixing import schedule
from tallyline.llm.ngram_join import ngram_join
from tallyline.llm.packing import best_fit_pack, byte_bpe

_KEY = "_row_key_of_the_pipeline"


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of docs whose key is in keys (k); of rows that repeat id and text, one."""
    rows = docs.withColumn(_KEY, row_key("doc_id", "text"))
    return rows.join(keys, rows[_KEY] == keys["k"], "left_semi").dropDuplicates([_KEY]).drop(_KEY)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: null texts, texts without a letter, and all if no row has a language.

    Repeated rows and ids stay as they are; null ids, languages and sources don't matter. No row is shuffled.
    """
    return language_id(docs, held_out_fifth(), carry=True).filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal without white space, null and empty ones among them.

    The one with the most code points, then the smallest id (null last), then the smallest key of id and text stays.
    """
    kept = exact_dedup(docs, key=row_key("doc_id", "text")).filter("kept")
    group = F.coalesce("text_sha256", F.col("row_key").cast("string"))
    return _only(docs, kept.groupBy(group).agg(F.min("row_key").alias("k")).select("k"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id (null last), then key, of each group tied by near-duplicate links.

    Texts without words, null ones among them, are in no group and stay; rows that repeat id and text come once.
    """
    return _only(docs, ngram_join(docs).filter("representative").select(F.col("row_key").alias("k")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts or drops documents as the mix takes them, in the order of training.

    Each time that a document is due is a row of its own at its own position; one that the mix takes in part ends after
    that many words. Null and empty texts have no words and go; null sources are one source; repeated rows are separate
    documents; ties of position go by id.
    """
    rows = schedule(docs, carry=True).select("size", F.explode("passes").alias("pass"), "row")
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    whole = F.col("pass.taken") == F.col("size")
    text = F.when(whole, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("pass.taken").cast("int")), ""))
    chars = F.char_length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    made = {"text": text, "n_chars": chars}
    cols = [made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns]
    rows = rows.select("pass.position", F.col("row.doc_id").alias("id"), F.struct(*cols).alias("row"))
    return rows.orderBy("position", "id").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs documents into sequences of 1024 tokens: a row per piece, see best_fit_pack().

    Null and empty texts are their end token alone; repeated rows are packed each on their own; other columns go.
    """
    return best_fit_pack(docs, byte_bpe())


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: SQL has no tokenizer and no inference of languages; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

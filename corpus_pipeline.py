"""A corpus pipeline of five stages; each works on all that the one before it kept.

Language identification drops documents without a language; of each near-duplicate group (five-word
shingles, similarity 0.8) the smallest doc_id stays; passages of 50 bytes and more that an earlier
document has are cut; personal data is replaced by its kind; the rest is packed into windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import langid, near_dedup, packing, pii, suffix_dedup
from tracklake.llm.common import tidied
from tracklake.llm.entry import WORDS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; a null text or one without a letter goes. Learned from the documents that aren't
    held out; without any labelled text nothing has a language, so all go. Repeated rows stay; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    return langid.recognised(docs, langid.fit(docs.where(~langid.held_out())))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each kept doc_id: the smallest of its component. Texts without words are linked with nothing and stay;
    of several rows under one doc_id the smallest by its columns stays, null first; rows without a doc_id go."""
    kept = near_dedup.near_duplicates(docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    rest = [c for c in COLUMNS if c != "doc_id"]
    one = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    return one.select("doc_id", "row.*").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes and more that a smaller doc_id has; characters cut in two go, n_chars is counted
    anew. A document of which nothing is left goes; a null or empty text stays, as the empty one."""
    left = suffix_dedup.remove_repeats(docs, text=True).where("n_bytes = 0 or n_removed < n_bytes")
    text = F.col("kept").cast("string")
    return docs.drop("text", "n_chars").join(left.select("doc_id", text.alias("text")), "doc_id").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; of overlapping spans the first by place.
    n_chars is counted anew; a null text stays null."""
    return pii.redact(docs.select(*COLUMNS), pii.fit(pii.labelled(spark))).withColumn("n_chars", F.length("text").cast("long"))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their windows; a null or empty text has the end id alone."""
    return packing.pack_documents(docs, WORDS)


STAGES = [("language", language), ("near_duplicates", near), ("repeated_passages", repeats), ("personal_data", personal), ("packing", windows)]
ORACLE_SQL = None


@tidied
def up_to(spark: SparkSession, sf_dir: str, last: int) -> DataFrame:
    """What a stage keeps; the table of the one before goes when it is written."""
    docs = up_to(spark, sf_dir, last - 1) if last else spark.read.parquet(f"{sf_dir}/documents.parquet")
    return STAGES[last][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return STAGES[-1][1](spark, up_to(spark, sf_dir, len(STAGES) - 2), sf_dir)

"""The corpus pipeline: five stages from raw documents to a weighted mix, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, language, mixing, near_duplicates, secrets
from weftline.llm.common import discard, settle


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay, with their columns; null, empty and letterless texts go."""
    marked = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.xxhash64("text").alias("mark"))
    told = language.identify(marked.select(F.col("row.text").alias("text"), F.col("row.lang").alias("declared"), F.col("row.source").alias("host"), F.lit(None).cast("string").alias("suffix"), "key", "mark"))
    rejected = settle(told.filter("not accepted").select("key", "mark").distinct(), "rejected")
    return marked.join(rejected, ["key", "mark"], "left_anti").select("row.*")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_duplicates.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; n_chars follows."""
    return secrets.mask_found(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often and with how many words the mix takes each document."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", near_duplicate_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
]

#: Language ID learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents that the stages before keep: one row a document, with how often and with how many words it's taken.

    Each stage but the last is written to the shared folder and read again, and its own input, if a stage before wrote it, is removed then; the
    last stage's input stays for whoever reads the result. Null and repeated ids, null, empty and very long texts and further columns of documents
    pass as each stage says; an empty table stays empty.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        after = settle(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)

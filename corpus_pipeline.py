"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from leadspark.llm.store import Workspace


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that score below 0.7; the scorer is fitted on the given documents' labels."""
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def with_row_id(docs: DataFrame) -> DataFrame:
    """Add ``_row``, a 64-bit hash of id and text; ids may be null or stand for several texts."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, the one with the smallest id (null last), and one of equal rows.

    Rows with a null id and different texts of one id are documents of their own.
    """
    rows = with_row_id(docs)
    groups = near_dedup.near_duplicate_groups(rows.select(F.col("_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("_row"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    kept = rows.select("_row", "doc_id").distinct().join(groups, "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a benchmark item or an edited copy of one, whatever their id."""
    rows = with_row_id(docs)
    leaks = decontaminate.find_leaks(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(leaks.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret span; documents stay, null and empty texts as they are, and so does an empty table."""
    return secret_scan.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left into sequences of 2048 tokens."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark_leaks", drop_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.write(docs, name)
    return docs


#: No SQL can express the stages; tests hold the run against plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}

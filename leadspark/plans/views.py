"""The library's tables as views over the given ones, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.columns import payload_key

KEYWORDS_HIGH = ["anvil", "gear", "widget", "red", "rod"]
KEYWORDS_LOW = ["gizmo", "small"]
GEO = r"(?i)\b(CANADA|JAPAN)\b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def projects_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_mktsegment").alias("source"), F.col("o_orderkey").cast("string").alias("external_id"), F.concat_ws(" ", "o_orderpriority", "c_name").alias("title"),
        F.col("n_name").alias("location"), F.floor(F.col("o_totalprice") * 100).cast("bigint").alias("value"), F.col("o_orderdate").cast("date").alias("issued_at"),
    )


PROJECTS_FROM_ORDERS = """projects AS (
  SELECT c_mktsegment AS source, CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority || ' ' || c_name AS title, n_name AS location,
         CAST(floor(o_totalprice * 100) AS BIGINT) AS value, CAST(o_orderdate AS DATE) AS issued_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def projects_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").cast("string").alias("external_id"), F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.lit("").alias("location"), F.floor(F.col("p_retailprice") * 1000).cast("bigint").alias("value"), F.lit(None).cast("date").alias("issued_at"),
    )


PROJECTS_FROM_PARTS = """projects AS (
  SELECT p_brand AS source, CAST(p_partkey AS VARCHAR) AS external_id, p_name || ' ' || p_type AS title, '' AS location,
         CAST(floor(p_retailprice * 1000) AS BIGINT) AS value, CAST(NULL AS DATE) AS issued_at FROM part)"""


def raw_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored payloads."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int")).cast("timestamp")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), payload_key("text").alias("hash"), "source", "lang", "text", day.alias("created_at"))


RAW_INPUTS = """raw_inputs AS (
  SELECT doc_id AS id, sha256(text) AS hash, source, lang, text, CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS TIMESTAMP) AS created_at FROM documents)"""


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as leads."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    score = (F.pmod(F.col("n_chars"), F.lit(10)) + 1).cast("int")
    status = F.when(F.col("toxic") == 1, "skipped").when(F.pmod("doc_id", F.lit(3)) == 0, "notified").otherwise("new")
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(90)).cast("int")).cast("timestamp")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("raw_input_id"), "source", F.substring("text", 1, 40).alias("title"), F.col("lang").alias("location"), score.alias("priority_score"),
        status.alias("status"), day.alias("created_at"), F.when(F.col("quality") == 1, F.concat(F.lit("good "), F.col("source"))).alias("rationale"), "quality", "toxic",
    )


LEADS = """leads AS (
  SELECT doc_id AS id, doc_id AS raw_input_id, source, substr(text, 1, 40) AS title, lang AS location, CAST(n_chars % 10 + 1 AS INTEGER) AS priority_score,
         CASE WHEN toxic = 1 THEN 'skipped' WHEN doc_id % 3 = 0 THEN 'notified' ELSE 'new' END AS status,
         CAST(DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) AS TIMESTAMP) AS created_at,
         CASE WHEN quality = 1 THEN 'good ' || source END AS rationale, quality, toxic
  FROM labels JOIN documents USING (doc_id))"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly polls of three airports from the event feed; an error is a cancellation."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("as_of"), "event_type")
    total, bad = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    return rows.groupBy("airport", "as_of").agg(total.alias("total"), bad.alias("cancelled"), F.when(total > 0, bad / total).otherwise(F.lit(0.0)).alias("rate"))


POLLS = """polls AS (
  SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, date_trunc('hour', ts) AS as_of, count(*) AS total, count(*) FILTER (event_type = 'error') AS cancelled,
         CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS rate
  FROM events GROUP BY 1, 2)"""

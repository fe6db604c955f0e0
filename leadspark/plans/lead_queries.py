"""Registered queries of lead assembly, payloads, stores, streams and configuration joins, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import rules
from leadspark.functions.columns import record_key, row_id
from leadspark.operators import dedup, disruption, leads, metrics, model_steps, normalize, vectors
from leadspark.operators.quantised import ProductIndex
from leadspark.operators.store import TableStore, write_bucketed
from leadspark.plans import views
from leadspark.plans.queries import _KEY, _SCORED, ORACLES, QUERIES, _polls_scored, register
from leadspark.sources import feeds, pages, registry
from leadspark.streaming import alerts

__all__ = ["ORACLES", "QUERIES"]


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='leadspark-')).rstrip('/')}/{uuid.uuid4().hex}"


def _uuid_sql(text: str) -> str:
    return f"regexp_replace(substr(sha256({text}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.*)$', '\\1-\\2-\\3-\\4-\\5')"


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


# Leads ------------------------------------------------------------------------------------------------

_AS_OF = "2024-03-31"


def _day(text: str = _AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


@register(
    "assembled_leads",
    f"""WITH {views.PROJECTS_FROM_ORDERS}, h AS (SELECT *, {_KEY} AS hash FROM projects WHERE value % 7 <> 0)
SELECT {_uuid_sql("hash")} AS id, hash AS raw_project_id, CASE WHEN value % 5 <> 0 THEN 'raw' || external_id END AS raw_input_id, source, title, location, value AS project_value,
       CASE WHEN value % 2 = 0 THEN 'GC ' || source ELSE '' END AS general_contractor, CASE WHEN value % 3 = 0 THEN location ELSE '' END AS applicant,
       CASE WHEN value % 4 = 0 THEN 0 ELSE CAST(value % 90 AS INTEGER) END AS estimated_crew_size, CAST(value % 11 AS INTEGER) AS priority_score, 'new' AS status, TIMESTAMP '{_AS_OF}' AS created_at
FROM h""",
)
def assembled_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects joined with model answers; six in seven have one, and some answers lack fields."""
    number = F.col("value")
    projects = views.projects_from_orders(spark, sf_dir).withColumns(
        {"hash": record_key(), "raw_input_id": F.when(number % 5 != 0, F.concat(F.lit("raw"), "external_id")).otherwise(""), "source_url": F.lit(""), "metadata": F.when(number % 3 == 0, F.create_map(F.lit("applicant"), F.col("location")))}
    )
    answers = projects.where(number % 7 != 0).select(
        "hash", F.when(number % 2 == 0, F.concat(F.lit("GC "), "source")).alias("general_contractor"), F.lit("type").alias("project_type"), F.when(number % 4 != 0, (number % 90).cast("int")).alias("estimated_crew_size"),
        F.lit(3).alias("estimated_duration_months"), F.lit(True).alias("out_of_town_crew_likely"), (number % 11).cast("int").alias("priority_score"), *[F.lit("").alias(c) for c in ("priority_reason", "suggested_outreach_timing", "notes")],
    )
    keep = ("id", "raw_project_id", "raw_input_id", "source", "title", "location", "project_value", "general_contractor", "applicant", "estimated_crew_size", "priority_score", "status", "created_at")
    return _naive(leads.assemble(projects, answers, _day()).select(*keep), "created_at")


@register(
    "augmented_projects",
    f"""WITH {views.PROJECTS_FROM_ORDERS}
SELECT external_id, CASE WHEN value % 3 = 0 THEN CASE WHEN value % 2 = 0 THEN 'Org ' || source ELSE '' END ELSE title END AS title,
       CASE WHEN value % 5 = 0 THEN CASE WHEN value % 2 = 0 THEN 'Place' ELSE '' END ELSE location END AS location,
       CASE WHEN value % 2 = 0 THEN 'Org ' || source WHEN value % 4 = 1 THEN 'old' END AS org_name, CASE WHEN value % 2 = 0 THEN 'hotel' END AS project_type, CASE WHEN value % 4 < 2 THEN 'a' END AS applicant
FROM projects""",
)
def augmented_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank titles and locations filled from extracted signals, which overwrite metadata of the same key."""
    number = F.col("value")
    rows = views.projects_from_orders(spark, sf_dir).withColumn("title", F.when(number % 3 == 0, "").otherwise(F.col("title")))
    projects = rows.withColumns(
        {
            "hash": record_key(), "location": F.when(number % 5 == 0, F.lit(None)).otherwise(F.col("location")),
            "metadata": F.when(number % 4 < 2, F.create_map(F.lit("applicant"), F.lit("a"), F.lit("org_name"), F.lit("old"))),
        }
    )
    signals = rows.where(number % 2 == 0).select(record_key().alias("hash"), F.concat(F.lit("Org "), "source").alias("org_name"), F.lit("Place").alias("location"), F.lit("hotel").alias("project_type"))
    meta = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return leads.augment(projects, signals).select("external_id", "title", "location", meta("org_name"), meta("project_type"), meta("applicant"))


_BEST = "SELECT id FROM leads WHERE status = 'new' ORDER BY priority_score DESC, created_at DESC, id LIMIT 20"


def _full_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads with every column that payloads read; some are blank or null."""
    number, rows = F.col("id"), views.leads(spark, sf_dir)
    return rows.withColumns(
        {
            "title": F.concat(F.lit("Lead "), number.cast("string"), F.when(number % 5 == 0, " <A&B>").otherwise("")), "contractor": F.when(number % 2 == 0, "Con & Co").otherwise(""), "applicant": F.when(number % 3 == 0, "App").otherwise(""),
            "source_url": F.when(number % 4 == 0, "http://x/y").otherwise(""), "general_contractor": F.lit("GC"), "suggested_outreach_timing": F.lit("soon"), "notes": F.lit("n"), "project_type": F.lit("hotel"), "priority_reason": F.lit("r"),
            "project_value": number * 1000, "estimated_crew_size": (number % 50).cast("int"), "estimated_duration_months": F.lit(6), "out_of_town_crew_likely": number % 2 == 0, "id": number.cast("string"), "raw_input_id": F.col("raw_input_id").cast("string"),
        }
    )


@register("notified_leads", f"WITH {views.LEADS}, b AS ({_BEST}) SELECT id, CASE WHEN id IN (SELECT id FROM b) THEN 'notified' ELSE status END AS status, (SELECT count(*) FROM b) AS n FROM leads")
def notified_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of all leads once the twenty best new ones are announced, with the number announced."""
    full = _full_leads(spark, sf_dir).withColumn("id", F.lpad("id", 20, "0"))
    message, marked = leads.notify_new(full, F.lit(_AS_OF).cast("date"), 20)
    return marked.select(F.col("id").cast("bigint").alias("id"), "status").crossJoin(message.select("n"))


_JSON_LEAD = """full_leads AS (
  SELECT *, 'Lead ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' <A&B>' ELSE '' END AS t,
         CASE WHEN priority_score >= 9 THEN '🔥' WHEN priority_score >= 7 THEN '⚡' WHEN priority_score >= 5 THEN '👀' ELSE '📌' END AS mark,
         CASE WHEN id % 2 = 0 OR id % 3 = 0 THEN '\\n📞' || CASE WHEN id % 2 = 0 THEN ' *Contractor:* Con & Co' ELSE '' END || CASE WHEN id % 6 = 0 THEN '  |' ELSE '' END || CASE WHEN id % 3 = 0 THEN ' *Applicant:* App' ELSE '' END ELSE '' END AS contact
  FROM leads),
blocks AS (
  SELECT *, '{"type":"section","text":{"type":"mrkdwn","text":"*' || t || '*\\t\\t\\t' || mark || ' *Score: ' || CAST(priority_score AS VARCHAR) || '/10*\\n📍 ' || location || '  |  💰 $' || format('{:,}', id * 1000) || ' CAD  |  🏢 GC: GC' || contact
         || '\\n🔌 *Source:* ' || source || '\\n🕐 *Outreach:* soon\\n📝 n' || CASE WHEN id % 4 = 0 THEN '\\n📄 <http://x/y|View source document>' ELSE '' END || '"},"fields":[{"type":"mrkdwn","text":"*Type:* hotel"},{"type":"mrkdwn","text":"*Crew:* ~'
         || CAST(id % 50 AS VARCHAR) || '  |  ~6 months"},{"type":"mrkdwn","text":"*Out-of-town:* ' || CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END || '"},{"type":"mrkdwn","text":"*Reason:* r"}'
         || CASE WHEN coalesce(rationale, '') <> '' THEN ',{"type":"mrkdwn","text":"*Rationale:* ' || rationale || '"}' ELSE '' END || ']}' AS block
  FROM full_leads)"""


@register("lead_blocks", f"WITH {views.LEADS}, {_JSON_LEAD} SELECT id, block FROM blocks")
def lead_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.lead_blocks(_full_leads(spark, sf_dir)).select(F.col("id").cast("bigint").alias("id"), "block")


@register(
    "digest_message",
    f"""WITH {views.LEADS}, {_JSON_LEAD}, top AS (SELECT * FROM blocks ORDER BY priority_score DESC, created_at DESC, CAST(id AS VARCHAR) LIMIT 100)
SELECT count(*) AS n, '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"🏗️  leadspark — ' || CAST(count(*) AS VARCHAR) || ' new leads  (Mar 31, 2024)"}}}},{{"type":"divider"}},'
       || string_agg(block || ',{{"type":"divider"}}', ',' ORDER BY priority_score DESC, created_at DESC, CAST(id AS VARCHAR)) || ']}}' AS payload, CAST(2 + 2 * count(*) AS INTEGER) AS n_blocks FROM top""",
)
def digest_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message of the best hundred leads: a header and a divider, then two blocks a lead."""
    return leads.digest_message(_full_leads(spark, sf_dir), F.lit(_AS_OF).cast("date"), limit=100)


@register(
    "digest_page",
    f"""WITH {views.LEADS}, top AS (SELECT *, replace(replace(replace('Lead ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' <A&B>' ELSE '' END, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM leads ORDER BY priority_score DESC, created_at DESC, CAST(id AS VARCHAR) LIMIT 200)
SELECT '<html><body><h1>Weekly High-Priority Leads</h1>' || string_agg('<div class="lead-card ' || CASE WHEN priority_score >= 8 THEN 'high-priority' ELSE 'medium-priority' END || '"><h2>' || t || '</h2><div class="score">Priority Score: ' || CAST(priority_score AS VARCHAR)
       || '/10</div><p><strong>Location:</strong> ' || location || '</p><p><strong>Project Type:</strong> hotel</p><p><strong>Reason:</strong> r</p><p><strong>Notes:</strong> n</p><div class="meta">Source: ' || source || ' | Value: $' || CAST(id * 1000 AS VARCHAR)
       || ' | GC: GC</div><a href="' || CASE WHEN id % 4 = 0 THEN 'http://x/y' ELSE '' END || '">View Source</a></div>', chr(10) ORDER BY priority_score DESC, created_at DESC, CAST(id AS VARCHAR)) || '</body></html>' AS html, count(*) AS n FROM top""",
)
def digest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.digest_page(_full_leads(spark, sf_dir), 200)


@register("lead_contexts", f"WITH {views.LEADS} SELECT id, 'Title: Lead ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' <A&B>' ELSE '' END || ' | Location: ' || location || ' | Type: hotel | Value: ' || CAST(id * 1000 AS VARCHAR) || ' | Notes: n | Document: ' || CASE WHEN id % 3 = 0 THEN 'text/plain' ELSE '' END AS context FROM leads")
def lead_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context texts; a third of the leads still has its document."""
    raw = views.table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("text/plain").alias("payload_type"))
    return leads.context_text(_full_leads(spark, sf_dir), raw).select(F.col("id").cast("bigint").alias("id"), "context")


@register("looked_up_orders", "SELECT c_custkey AS id, o_totalprice FROM customer LEFT JOIN orders ON o_orderkey = c_custkey")
def looked_up_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-up of keys of which some are missing: order of every customer number."""
    held = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return leads.find(held, views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


# Stores and counts ---------------------------------------------------------------------------------------


@register("stored_payloads", r"SELECT doc_id, sha256(text) AS hash, sha256(regexp_replace(regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[REDACTED EMAIL]', 'g'), '(\+?\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}', '[REDACTED PHONE]', 'g')) AS kept FROM documents")
def stored_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of the payload as fetched beside the payload that is kept."""
    out = dedup.stored_payloads(views.table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload")))
    return out.select("doc_id", "hash", F.sha2("payload", 256).alias("kept"))


@register("copied_rows", "SELECT doc_id, CAST(n_chars AS INTEGER) AS n FROM documents WHERE doc_id % 3 <> 0")
def copied_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a copy appends to a target which has a third of them; the count is cast on the way."""
    docs = views.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("n_chars").cast("string").alias("n"))
    return dedup.copy_missing(rows, docs.where("doc_id % 3 = 0").select("doc_id"), "doc_id", {"n": "int"})[0]


@register("copy_dry_run", "SELECT count(*) AS would_read, count(*) FILTER (doc_id % 4 = 0) AS lost_values, count(*) FILTER (doc_id % 3 <> 0) AS would_append, count(*) FILTER (doc_id % 3 = 0) AS would_skip FROM documents")
def copy_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "many").otherwise(F.col("n_chars").cast("string")).alias("n"))
    return dedup.copy_dry_run(rows, docs.where("doc_id % 3 = 0").select("doc_id"), "doc_id", {"n": "int"})


@register("table_states", "SELECT 'appended' AS stage, count(*) AS n FROM orders UNION ALL SELECT 'swapped', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'cleared', 0")
def table_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a stored table after an append, after a swap that leaves finished orders out, and after it is cleared."""
    store, orders = TableStore(spark, _folder(spark)), views.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    schema, counts = "o_orderkey bigint, o_orderstatus string", []
    store.append("orders", orders)
    counts.append(("appended", store.read("orders", schema).count()))
    store.swap("orders", store.read("orders", schema).where("o_orderstatus <> 'F'"))
    counts.append(("swapped", store.read("orders", schema).count()))
    store.clear("orders")
    counts.append(("cleared", store.read("orders", schema).count()))
    return spark.createDataFrame(counts, "stage string, n bigint")


_STORED = "id bigint, status string, changed boolean"


def _stored_orders(spark: SparkSession, sf_dir: str) -> TableStore:
    """Orders in a store of sixteen buckets."""
    store = TableStore(spark, _folder(spark))
    store.swap("orders", views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("changed")), "id")
    return store


@register("store_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) THEN 'X' ELSE o_orderstatus END AS status, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50) AS changed FROM orders UNION ALL SELECT -1 - c_custkey, 'N', true FROM customer WHERE c_custkey % 10 = 0")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after an upsert of changed and new rows: only the buckets of their keys are written anew."""
    store = _stored_orders(spark, sf_dir)
    large = views.table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("id"), F.lit("X").alias("status"), F.lit(True).alias("changed")).distinct()
    new = views.table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select((-1 - F.col("c_custkey")).alias("id"), F.lit("N").alias("status"), F.lit(True).alias("changed"))
    store.change("orders", _STORED, large.unionByName(new), lambda old, batch: dedup.upsert(old, batch, "id", F.col("changed").cast("int")))
    return store.read("orders", _STORED)


@register("store_purge", "SELECT o_orderkey AS id, o_orderstatus AS status, false AS changed FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 3 = 0)")
def store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table after finished orders of a list have been deleted from their buckets."""
    store = _stored_orders(spark, sf_dir)
    doomed = views.table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"))
    store.change("orders", _STORED, doomed, lambda old, batch: old.join(batch, "id", "left_anti"))
    return store.read("orders", _STORED)


@register("store_lookup", "SELECT c_custkey AS id, o_orderstatus AS status FROM customer LEFT JOIN orders ON o_orderkey = c_custkey WHERE c_acctbal > 9900")
def store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few keys looked up in a store: named in the filter of a scan of their buckets."""
    asked = views.table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_custkey").alias("id"))
    return _stored_orders(spark, sf_dir).find("orders", _STORED, asked, "id").select("id", "status")


@register("unseen_in_buckets", ORACLES["unseen_documents"])
def unseen_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join of a batch with a large seen table that is bucketed and sorted by hash, so only the batch is shuffled."""
    raw, path = views.raw_inputs(spark, sf_dir).select("id", "hash"), _folder(spark)
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    seen = write_bucketed(raw.where("id % 5 = 0").select("hash").distinct(), f"seen_{path.rsplit('/', 1)[1]}", "hash", path, buckets)
    return dedup.unseen(raw.where("id % 5 <> 0"), seen).select("id", "hash")


@register("scanned_columns", "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_orderstatus")
def scanned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan by a declared column list; nothing else is read."""
    orders = spark.read.schema("o_orderstatus string, o_totalprice double").parquet(f"{sf_dir}/orders.parquet")
    return orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))


@register("total_value", f"WITH {views.PROJECTS_FROM_ORDERS} SELECT source, count(*) AS n, count(*) FILTER (value > 0) AS with_value, CAST(sum(value) AS BIGINT) AS total_value FROM projects GROUP BY source")
def total_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_value(views.projects_from_orders(spark, sf_dir), "value", ["source"])


@register("purgeable_counts", f"WITH {views.RAW_INPUTS} SELECT source, count(*) AS n, min(created_at) AS oldest FROM raw_inputs r WHERE created_at < TIMESTAMP '2024-02-15' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.id) GROUP BY source")
def purgeable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("raw_input_id"))
    return _naive(dedup.purgeable(views.raw_inputs(spark, sf_dir).select("id", "source", "created_at"), refs, _day("2024-02-15"), ["source"]), "oldest")


@register("run_counters", "SELECT count(*) AS collected, count(*) FILTER (doc_id % 5 <> 0) AS fresh, count(*) FILTER (doc_id % 5 <> 0 AND n_chars < 100) AS skipped FROM documents")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a run's own write fills in; the written rows are read by nothing else."""
    rows, watched = metrics.run_counters(views.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), fresh=F.col("doc_id") % 5 != 0, skipped=(F.col("doc_id") % 5 != 0) & (F.col("n_chars") < 100))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([watched.get], "collected bigint, fresh bigint, skipped bigint")


@register("field_hit_rates", "SELECT source, count(*) AS n, round(avg(CASE WHEN n_chars % 50 > 0 THEN 2 ELSE 1 END), 9) AS mean_hits, round(avg(CASE WHEN n_chars % 50 > 0 THEN 2 ELSE 1 END) / 6, 9) AS hit_rate FROM documents GROUP BY source")
def field_hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"org_name":"'), F.col("source"), F.lit('","crew_size":'), (F.col("n_chars") % 50).cast("string"), F.lit(',"location":7}'))
    out = metrics.field_hit_rate(model_steps.parse_signals(views.table(spark, sf_dir, "documents").select("source", body.alias("response"))))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_hits", "hit_rate")})


@register("bad_records", "SELECT doc_id, doc_id % 4 <> 3 AS good FROM documents")
def bad_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which one in four has no valid id; the others go on."""
    good, bad = feeds.split_valid(views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 != 3, F.col("doc_id")).alias("key")), F.col("key") >= 0)
    return good.select("doc_id", F.lit(True).alias("good")).union(bad.select("doc_id", F.lit(False)))


# Sources ------------------------------------------------------------------------------------------------

_ALERT_FREE = "WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_name), 'small') OR contains(lower(p_type), 'small'))"


@register("dropped_then_kept", f"SELECT p_partkey, p_name, p_type FROM part {_ALERT_FREE}")
def dropped_then_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.drop_then_keep(views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), ["red", "small"], ["p_name", "p_type"])


@register("latest_links", "SELECT l_orderkey AS page_id, arg_min(l_partkey, l_linenumber * 10000000 + l_partkey) AS link FROM lineitem GROUP BY l_orderkey")
def latest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First link of every page, order lines standing for the links of a page."""
    return normalize.latest_link(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("link")))


@register("source_union", f"WITH {views.PROJECTS_FROM_ORDERS}, o AS (SELECT * FROM projects), {views.PROJECTS_FROM_PARTS.replace('projects AS', 'p AS')} SELECT source, external_id, title, value FROM o UNION ALL SELECT source, external_id, title, value FROM p")
def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two enabled sources in one table; a third is switched off."""
    orders, parts = views.projects_from_orders(spark, sf_dir), views.projects_from_parts(spark, sf_dir)
    sources = registry.Sources(spark).add("orders", orders).add("parts", parts).add("off", parts)
    return sources.union({"off": False}).select("source", "external_id", "title", "value")


def _order_pages(spark: SparkSession, sf_dir: str) -> registry.PageFiles:
    """Orders as published: JSON lines in one folder a month of issue, one in a hundred of them broken."""
    month = F.trunc("issued_at", "month").alias("day")
    rows = views.projects_from_orders(spark, sf_dir).select(month, F.to_json(F.struct("source", "external_id", "title", "location", "value")).alias("line"), "external_id")
    broken = F.when(F.col("external_id").cast("long") % 100 == 0, F.concat(F.lit("{"), "line")).otherwise(F.col("line"))
    folder = f"{_folder(spark)}/pages"
    rows.select("day", broken.alias("value")).write.partitionBy("day").text(folder)
    return registry.PageFiles("orders", folder)


@register(
    "collected_projects",
    f"""WITH {views.PROJECTS_FROM_ORDERS}, m AS (SELECT *, CAST(date_trunc('month', issued_at) AS DATE) AS day, CAST(external_id AS BIGINT) % 100 = 0 AS bad FROM projects)
SELECT CASE WHEN bad THEN 'orders' ELSE source END AS source, CASE WHEN bad THEN NULL ELSE external_id END AS external_id, CASE WHEN bad THEN NULL ELSE title END AS title, CASE WHEN bad THEN 0 ELSE value END AS value, day AS issued_at, CASE WHEN bad THEN 'bad' END AS raw_type
FROM m WHERE day >= DATE '1996-03-01' AND day < DATE '1997-01-01'""",
)
def collected_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten months of a collector's pages; the condition on the day reaches the collector, which lists those folders only."""
    rows = registry.collect(spark, _order_pages(spark, sf_dir)).where("issued_at >= DATE '1996-03-01' AND issued_at < DATE '1997-01-01'")
    return rows.select("source", "external_id", "title", F.coalesce("value", F.lit(0)).alias("value"), "issued_at", "raw_type")


@register("page_links", "WITH h AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), t AS (SELECT page_id, unnest(regexp_extract_all(h, '(?is)<a\\b[^>]*>[^<]*', 0)) AS x, generate_subscripts(regexp_extract_all(h, '(?is)<a\\b[^>]*>[^<]*', 0), 1) - 1 AS pos FROM h), c AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?is)^<a\\b[^>]*>', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, regexp_extract(x, '(?i)\\bhref\\s*=\\s*[\"'']?([^\"''\\s>]*)', 1) AS href FROM t) SELECT page_id, pos, title, CASE WHEN href LIKE 'http%' THEN href ELSE 'https://example.com' || href END AS link FROM c WHERE href <> '' AND strlen(title) BETWEEN 3 AND 150 AND lower(title) <> 'events'")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of all pages: every link element with its title."""
    return pages.cards(views.table(spark, sf_dir, "pages"), "a", ["b"], "https://example.com", need_link=True, least=3).select("page_id", "pos", "title", "link")


@register("page_headings", "SELECT page_id, 'page:' || t AS external_id, t AS title FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?is)<h1\\b[^>]*>([^<]*)', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS t FROM pages) WHERE t <> ''")
def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.headings(views.table(spark, sf_dir, "pages"), "h1", "page").select("page_id", "external_id", "title")


@register("event_cards", "SELECT c_custkey AS page_id, n - 1 AS pos, CASE n WHEN 1 THEN c_name || ' Summit' WHEN 2 THEN c_mktsegment || ' Forum' END AS title, CASE n WHEN 1 THEN 'Trade' ELSE '' END AS category, CASE n WHEN 1 THEN 'May 1' ELSE '' END AS date, CASE n WHEN 1 THEN 'https://v.example/e/' || CAST(c_custkey AS VARCHAR) ELSE 'http://other/x' END AS link FROM customer, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS n)")
def event_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as venue pages of five cards: relative link, outside link, dropped kind, navigation, title too short."""
    key = F.col("c_custkey").cast("string")
    html = F.concat(
        F.lit('<a href="/e/'), key, F.lit('"><h3>'), F.col("c_name"), F.lit(' Summit</h3><span class="event-category">Trade</span><em class="event-date">May 1</em></a><a href="http://other/x"><h4>'), F.col("c_mktsegment"), F.lit(" Forum</h4></a>"),
        F.lit('<a href="/w"><h3>A wedding fair</h3></a><a href="/n"><h3>Contact us today</h3></a><a href="/s"><h2>Hi</h2></a>'),
    )
    return pages.venue_cards(views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")), "https://v.example")


@register("card_projects", "SELECT kind, source, external_id, title, hash FROM (SELECT 'venue' AS kind, 'venue' AS source, lower(replace(c_name, ' ', '-')) || '-may' AS external_id, c_name AS title, sha256('venue|' || lower(replace(c_name, ' ', '-')) || '-may|' || c_name || '|0001-01-01') AS hash FROM customer UNION ALL SELECT 'event', 'events', 'http://e/' || CAST(c_custkey AS VARCHAR), c_name || ' conference', sha256('events:http://e/' || CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'heading', 'announcements', 'page:' || c_name, c_name, sha256('announcements:page:' || c_name) FROM customer UNION ALL SELECT 'news', 'news', 'g' || CAST(c_custkey AS VARCHAR), c_name || ' expansion', 'h' FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'award', 'awards', CAST(c_custkey AS VARCHAR), c_name, 'h' FROM customer)")
def card_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venue cards, event cards, headings, news items and awards in the one project shape."""
    rows, key = views.table(spark, sf_dir, "customer"), F.col("c_custkey").cast("string")
    name = F.col("c_name")
    card = rows.select(name.alias("title"), F.lit("may").alias("date"), F.lit("c").alias("category"), F.lit("l").alias("link"))
    event = rows.select(F.concat(name, F.when(F.col("c_custkey") % 2 == 0, " conference").otherwise(" conference party")).alias("title"), F.lit("").alias("date"), F.concat(F.lit("http://e/"), key).alias("link"))
    heading = rows.select(F.concat(F.lit("page:"), name).alias("external_id"), name.alias("title"), F.lit("").alias("description"))
    item = rows.select(F.lit("news").alias("source"), F.concat(F.lit("g"), key).alias("external_id"), F.concat(name, F.when(F.col("c_custkey") % 3 == 0, " expansion election").otherwise(" expansion")).alias("title"), *[F.lit("").alias(c) for c in ("description", "source_url")], F.lit(None).cast("date").alias("issued_at"), F.lit("h").alias("hash"))
    award = rows.select(F.lit("awards").alias("source"), key.alias("external_id"), name.alias("title"), F.lit("").alias("location"), F.lit(1).cast("bigint").alias("value"), *[F.lit("").alias(c) for c in ("description", "source_url")], F.lit(None).cast("date").alias("issued_at"), F.lit("h").alias("hash"))
    made = {"venue": normalize.venue_projects(card), "event": normalize.event_projects(event, _day()), "heading": normalize.heading_projects(heading, "u", _day()), "news": normalize.news_projects(item), "award": normalize.award_projects(award)}
    out = None
    for kind, frame in made.items():
        part = frame.select(F.lit(kind).alias("kind"), "source", "external_id", "title", "hash")
        out = part if out is None else out.union(part)
    return out


@register("hotel_airports", "SELECT CAST(s_suppkey AS VARCHAR) AS hotel_id, s_acctbal AS alert_threshold_sps, CASE n WHEN 0 THEN 'A0' ELSE 'A' || CAST(s_suppkey % 2 + 1 AS VARCHAR) END AS airport, CAST(10 + n AS INTEGER) AS distance_min FROM supplier, (SELECT unnest([0, 1]) AS n)")
def hotel_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.hotel_airports(_hotels(spark, sf_dir))


def _hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as hotels that watch two airports each."""
    place = lambda code, minutes: F.struct(code.alias("code"), F.lit(minutes).alias("distance_min"))
    other = F.concat(F.lit("A"), (F.col("s_suppkey") % 2 + 1).cast("string"))
    return views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_acctbal").alias("alert_threshold_sps"), F.array(place(F.lit("A0"), 10), place(other, 11)).alias("airports"))


# Disruption ------------------------------------------------------------------------------------------------

_WEATHER = "weather AS (SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, ts AS at, arg_min(CASE event_type WHEN 'click' THEN 'Fog' WHEN 'view' THEN 'Snow' ELSE 'AtmosphericRiver' END, event_id) AS weather FROM events WHERE event_id % 10 = 0 GROUP BY 1, 2)"
_STOPS = "stops AS (SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, ts AS at, bool_or(event_type = 'signup') AS ground_stop FROM events WHERE event_id % 25 = 0 GROUP BY 1, 2)"


def _weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "Fog").when(F.col("event_type") == "view", "Snow").otherwise("AtmosphericRiver")
    rows = views.table(spark, sf_dir, "events").where("event_id % 10 = 0")
    return rows.select(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.col("ts").cast("timestamp").alias("as_of"), kind.alias("type"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("zone"), F.lit(0).alias("pos"))


def _stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").where("event_id % 25 = 0").groupBy(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.col("ts").cast("timestamp").alias("as_of")).agg(F.bool_or(F.col("event_type") == "signup").alias("ground_stop"))


@register(
    "assembled_polls",
    f"""WITH {views.POLLS}, {_WEATHER}, {_STOPS}, pw AS (SELECT p.*, w.weather FROM polls p ASOF LEFT JOIN weather w ON p.airport = w.airport AND p.as_of >= w.at),
ps AS (SELECT pw.*, coalesce(s.ground_stop, false) AS ground_stop FROM pw ASOF LEFT JOIN stops s ON pw.airport = s.airport AND pw.as_of >= s.at),
hotels AS (SELECT CAST(s_suppkey AS VARCHAR) AS hotel_id, 'A' || CAST(n AS VARCHAR) AS airport FROM supplier, (SELECT unnest([0, 1, 2]) AS n) WHERE n = 0 OR n = s_suppkey % 2 + 1)
SELECT hotel_id, airport, as_of, total, cancelled, weather, ground_stop FROM ps JOIN hotels USING (airport)""",
)
def assembled_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls with the weather alert and ground stop of their time, for the hotels that watch the airport."""
    stops = _stops(spark, sf_dir)
    polls = views.polls(spark, sf_dir).withColumn("ground_stop", F.lit(False))
    out = disruption.assemble_polls(polls, _weather(spark, sf_dir), stops, feeds.hotel_airports(_hotels(spark, sf_dir)))
    return _naive(out.select("hotel_id", "airport", "as_of", "total", "cancelled", "weather", "ground_stop"), "as_of")


@register(
    "tuned_states",
    f"""WITH {_SCORED}, {_WEATHER}, w AS (SELECT s.*, w.weather FROM scored s ASOF LEFT JOIN weather w ON s.airport = w.airport AND s.as_of >= w.at),
c AS (SELECT *, CASE WHEN airport = 'A1' AND state = 'HardAlert' THEN 'SoftAlert' ELSE state END AS capped FROM w)
SELECT airport, as_of, weather, CASE WHEN weather = 'Fog' AND minutes_active < {rules.FOG_MINUTES} THEN 'Ignore' WHEN weather = 'Snow' AND capped = 'Ignore' THEN 'PreAlert' WHEN weather = 'AtmosphericRiver' AND score >= {rules.RIVER_SCORE} AND capped = 'Watch' THEN 'SoftAlert' ELSE capped END AS state FROM c""",
)
def tuned_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States under the weather alert of their time; one airport has a single runway."""
    first = _weather(spark, sf_dir).groupBy("airport", "as_of").agg(F.min_by("type", "zone").alias("weather"))
    polls = disruption.as_of(disruption.with_minutes_active(views.polls(spark, sf_dir), 0.2, close_minutes=60), first, "airport", "as_of", ["weather"])
    out = disruption.with_score(polls, weather=F.col("weather"), single_runway=F.col("airport") == "A1")
    return _naive(out.select("airport", "as_of", "weather", "state"), "as_of")


_EVENTS = f"""{_SCORED}, ev AS (SELECT airport, as_of, minutes_active AS minutes, state, score, cancelled, total, CASE WHEN total % 2 = 0 THEN total ELSE 0 END AS rooms, CASE WHEN total % 3 = 0 THEN 'Call the airlines' ELSE '' END AS copy FROM scored)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polls_scored(spark, sf_dir).select(
        "airport", "as_of", F.col("minutes_active").alias("minutes"), "state", "score", "cancelled", "total", F.when(F.col("total") % 2 == 0, F.col("total")).otherwise(0).alias("rooms"), F.when(F.col("total") % 3 == 0, "Call the airlines").otherwise("").alias("copy"), F.lit("Snow").alias("cause")
    )


@register(
    "alert_payloads",
    f"""WITH {_EVENTS} SELECT airport, as_of, '{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":"🚨 Disruption Alert: ' || airport || '"}}}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Status:*\\n' || CASE state WHEN 'HardAlert' THEN '🔴' WHEN 'SoftAlert' THEN '⚠️' ELSE '👀' END || ' Active (' || CAST(minutes AS VARCHAR)
 || ' min)"}},{{"type":"mrkdwn","text":"*Cause:*\\nSnow"}}]}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Impact:*\\n' || CAST(cancelled AS VARCHAR) || ' cancellations (' || CAST(total AS VARCHAR) || ' total flights)"}},{{"type":"mrkdwn","text":"*Est. Stranded Pax:*\\n' || CAST(CAST(trunc(score) AS BIGINT) AS VARCHAR)
 || '"}}]}},{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Earliest Recovery:*\\n{rules.EARLIEST_CLEAR}"}},{{"type":"mrkdwn","text":"*Rooms Available:*\\n' || CASE WHEN rooms = 0 THEN 'room count not set — use /inventory N' ELSE CAST(rooms AS VARCHAR) END || '"}}]}},{{"type":"section","text":{{"type":"mrkdwn","text":"*Suggested Actions:*\\n'
 || CASE WHEN copy <> '' THEN copy ELSE '• {"\\n• ".join(rules.ALERT_ACTIONS)}' END || '"}}}}]}}' AS payload FROM ev""",
)
def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(leads.alert_payloads(_events(spark, sf_dir)).select("airport", "as_of", "payload"), "as_of")


@register("resolve_texts", f"WITH {_EVENTS} SELECT airport, as_of, '✅ *Disruption Resolved: ' || airport || '*' || chr(10) || 'Total Duration: ' || CAST(minutes AS VARCHAR) || ' min' || chr(10) || 'Final SPS Score: ' || printf('%.1f', trunc(score)) AS text FROM ev")
def resolve_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return _naive(rows.select("airport", "as_of", leads.resolve_text(F.col("airport"), F.col("minutes"), F.floor("score").cast("double")).alias("text")), "as_of")


@register(
    "alert_prompts",
    f"""WITH {_EVENTS}, p AS (SELECT *, hour(as_of) AS h, CAST(floor((minutes + 7.5) / 15) * 15 AS INTEGER) AS q FROM ev)
SELECT airport, as_of, 'Cause: Snow' || chr(10) || 'State: ' || state || chr(10) || 'Score: ' || printf('%.1f', trunc(score)) || chr(10) || 'Duration: ' || CAST(q AS VARCHAR) || ' min' || chr(10) || 'Cancelled: ' || printf('%.1f', trunc(100.0 * cancelled / total)) || '%' || chr(10) || 'Stranded: ' || CAST(CAST(trunc(score) AS BIGINT) AS VARCHAR) || chr(10)
  || 'Time of day: ' || CASE WHEN h >= 21 OR h < 5 THEN 'overnight' WHEN h >= 17 THEN 'evening' WHEN h >= 12 THEN 'afternoon' ELSE 'morning' END || chr(10) || 'Recovery: ' || CASE WHEN total % 2 = 0 THEN '4 hours from now' ELSE 'unknown' END AS prompt FROM p""",
)
def alert_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of the alert copy, the rate cut to whole percents so that both engines write the same digits."""
    rows = _events(spark, sf_dir).withColumns({"started_at": F.col("as_of") - F.make_dt_interval(mins=F.col("minutes")), "alert_state": F.col("state"), "sps": F.floor("score").cast("double"), "est_stranded": F.floor("score"), "flights_scheduled": F.lit(100).cast("bigint"), "flights_cancelled": F.floor(100 * F.col("cancelled") / F.col("total"))})
    rows = rows.withColumn("recovery_eta", F.when(F.col("total") % 2 == 0, F.col("as_of") + F.expr("INTERVAL 4 HOURS")))
    out = model_steps.alert_prompt(rows, F.col("as_of"))
    return _naive(out.select("airport", "as_of", F.regexp_replace("prompt", r" \(\d+/\d+\)", "").alias("prompt")), "as_of")


@register("alert_copies", f"WITH {_EVENTS} SELECT airport, as_of, CASE WHEN total % 3 = 0 THEN 'copy ' || airport ELSE '• {(chr(10) + '• ').join(rules.ALERT_ACTIONS)}' END AS copy FROM ev")
def alert_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated copy where the call went well, the fixed actions elsewhere."""
    rows = _events(spark, sf_dir).drop("copy").withColumn("id", row_id("airport", F.col("as_of").cast("string")))
    answers = rows.where(F.col("total") % 2 == 0).select("id", F.when(F.col("total") % 3 == 0, "ok").otherwise("error").alias("status"), F.concat(F.lit("copy "), "airport").alias("response"))
    late = rows.where(F.col("total") % 2 == 1).select("id", F.lit("ok").alias("status"), F.when(F.col("total") % 3 == 0, F.concat(F.lit("copy "), "airport")).otherwise("").alias("response"))
    return _naive(model_steps.alert_copy(rows, answers.union(late)).select("airport", "as_of", "copy"), "as_of")


# Model steps ---------------------------------------------------------------------------------------------


@register("rationales", f"WITH {views.LEADS}, t AS (SELECT id, 'Project: Lead ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' <A&B>' ELSE '' END || '. Type: hotel. Location: ' || location || '. Crew Size: ' || CAST(id % 50 AS VARCHAR) || '. Duration Months: 6. Priority Score: ' || CAST(priority_score AS VARCHAR) || '. Value: ' || CAST(id * 1000 AS VARCHAR) || '.' AS p FROM leads) SELECT id, p AS prompt, CASE WHEN id % 3 <> 0 THEN 'Because of ' || CAST(id AS VARCHAR) ELSE '' END AS rationale FROM t")
def rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all leads and the rationales that came back; one call in three failed."""
    rows = model_steps.rationale_prompt(_full_leads(spark, sf_dir))
    number = F.col("id").cast("bigint")
    answers = rows.select("id", F.when(number % 3 != 0, "ok").otherwise("error").alias("status"), F.concat(F.lit("  Because of "), "id").alias("response"))
    return model_steps.with_rationale(rows, answers).select(number.alias("id"), "prompt", "rationale")


@register("outreach_prompts", f"WITH {views.LEADS} SELECT id, 'Draft a short first message to the contact of this lead.' || chr(10) || 'Title: Lead ' || CAST(id AS VARCHAR) || CASE WHEN id % 5 = 0 THEN ' <A&B>' ELSE '' END || chr(10) || 'Location: ' || location || chr(10) || 'Type: hotel' || chr(10) || 'Timing: soon' AS prompt FROM leads")
def outreach_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_steps.outreach_prompt(_full_leads(spark, sf_dir)).select(F.col("id").cast("bigint").alias("id"), "prompt")


@register("template_prompts", f"WITH {views.PROJECTS_FROM_ORDERS} SELECT external_id, 'A building permit was issued. Which crews will come from out of town, how many people and for how long?' || chr(10) || 'Permit: ' || title || chr(10) || 'Address: ' || location || chr(10) || 'Declared value (CAD): ' || CAST(value AS VARCHAR) || chr(10) || 'Issued: ' || strftime(issued_at, '%Y-%m-%d') || chr(10) || 'd' AS prompt FROM projects")
def template_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts from the library's own template table."""
    rows = views.projects_from_orders(spark, sf_dir).withColumns({"source": F.lit("permits"), "description": F.lit("d"), "source_url": F.lit("")})
    return model_steps.with_prompt(rows, model_steps.template_table(spark)).select("external_id", "prompt")


# Vectors -----------------------------------------------------------------------------------------------------


@register("embedding_upsert", "SELECT vec_id % 50 AS lead_id, arg_max(embedding[1], vec_id) AS first_value, max(vec_id) AS version, CAST(len(arg_max(embedding, vec_id)) AS INTEGER) AS dims FROM embeddings GROUP BY 1")
def embedding_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of fifty leads, each written many times; the last one holds."""
    rows = views.table(spark, sf_dir, "embeddings").select(F.pmod("vec_id", F.lit(50)).alias("lead_id"), F.col("vec_id").alias("version"), "embedding")
    out = dedup.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "lead_id", F.col("version"))
    return out.select("lead_id", F.col("embedding")[0].alias("first_value"), "version", F.size("embedding").alias("dims"))


@register("clustered_all_lists", ORACLES["nearest_each"])
def clustered_all_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over all lists of the cluster index, which has to equal the exact search."""
    rows = views.table(spark, sf_dir, "embeddings")
    index = vectors.ClusterIndex(rows, lists=6)
    return index.search(rows.where("vec_id % 100 = 0"), 10, probe=6).withColumn("similarity", F.round("similarity", 6))


@register("quantised_recall", "SELECT true AS recall_reached, true AS under_a_tenth, 10 * count(*) AS neighbours FROM embeddings WHERE vec_id % 100 = 0")
def quantised_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether search by codes finds nine in ten exact neighbours and scores under a tenth of the rows exactly for a query."""
    rows = views.table(spark, sf_dir, "embeddings")
    asked, total = rows.where("vec_id % 100 = 0"), rows.count()
    index = ProductIndex(spark, _folder(spark)).build(rows)
    many = min(200, max(10, total // 11))
    found = vectors.recall(index.search(rows, asked, 10, many), vectors.nearest_each(rows, asked, 10))
    return found.select((F.col("recall") >= 0.9).alias("recall_reached"), F.lit(many < total / 10).alias("under_a_tenth"), "neighbours")


@register("index_upkeep", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 7 <> 0")
def index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an index after a tenth of its vectors was replaced, the rest came in later, a seventh was deleted and the changes were merged."""
    rows = views.table(spark, sf_dir, "embeddings")
    index = ProductIndex(spark, _folder(spark)).build(rows.where("vec_id % 5 <> 0"))
    reversed_rows = rows.withColumn("embedding", F.reverse("embedding"))
    index.update(reversed_rows.where("vec_id % 10 = 1"))
    index.update(rows.where("vec_id % 5 = 0 OR vec_id % 10 = 1"), rows.where("vec_id % 7 = 0"))
    index.update(deleted=rows.where("vec_id % 7 = 0"))
    index.merge()
    return index.rows().select("id")


@register("cross_source_pairs", f"WITH n AS ({ORACLES['nearest_each']}), s AS (SELECT vec_id, 's' || CAST(vec_id % 3 AS VARCHAR) AS source FROM embeddings) SELECT n.query_id, n.neighbor_id, a.source AS query_source, b.source AS neighbor_source FROM n JOIN s a ON a.vec_id = query_id JOIN s b ON b.vec_id = neighbor_id WHERE similarity > 0.2 AND a.source <> b.source")
def cross_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    near = vectors.nearest_each(rows, rows.where("vec_id % 100 = 0"), 10).withColumn("similarity", F.round("similarity", 6))
    sources = rows.select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.pmod("vec_id", F.lit(3)).cast("string")).alias("source"))
    return vectors.cross_source_pairs(near, sources, 0.2).select("query_id", "neighbor_id", "query_source", "neighbor_source")


# Streams, each run over all that its source holds ------------------------------------------------------------

_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
#: Windows are out once the newest event is the allowed lateness past their end.
_PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(_EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@register("stream_polls", f"WITH {views.POLLS} SELECT airport, as_of, total, cancelled FROM polls WHERE as_of + INTERVAL 1 HOUR <= {_PASSED}")
def stream_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).withColumn("airport", F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")))
    return _naive(alerts.run_once(alerts.stream_polls(events), _folder(spark)).select("airport", "as_of", "total", "cancelled"), "as_of")


@register("stream_sessions", f"WITH e AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 1 ELSE 0 END AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS started_at, max(ts) + INTERVAL 30 MINUTES AS ended_at, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTES <= {_PASSED}")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _naive(alerts.run_once(alerts.stream_sessions(_event_stream(spark, sf_dir)), _folder(spark)), "started_at", "ended_at")


@register("stream_unseen", "SELECT DISTINCT event_type || ':' || CAST(user_id AS VARCHAR) AS hash FROM events")
def stream_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _event_stream(spark, sf_dir).withColumn("hash", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    return alerts.run_once(alerts.stream_unseen(keyed), _folder(spark)).select("hash")


@register("stream_batches", "SELECT event_type, count(*) AS n, 1 AS batches FROM events GROUP BY event_type")
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder a micro-batch and a second start that finds nothing new, so every row is there once."""
    folder, seen = _folder(spark), set()
    for _ in range(2):
        rows = alerts.run_once(_event_stream(spark, sf_dir).select("event_type"), folder, lambda _, batch_id: seen.add(batch_id))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("batches", F.lit(len(seen)))


@register(
    "stream_assembled",
    f"""WITH a AS ({ORACLES["assembled_polls"]}), {views.POLLS}, {_WEATHER}, {_STOPS}
SELECT * FROM a WHERE as_of < least((SELECT max(as_of) FROM polls), (SELECT date_trunc('millisecond', max(weather.at)) FROM weather), (SELECT date_trunc('millisecond', max(stops.at)) FROM stops)) - INTERVAL 1 HOUR""",
)
def stream_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls, weather and notices as three streams joined as of the polls' times; later polls still wait. What they wrote, a row a poll, is joined with the hotels, a table."""
    folder = _folder(spark)
    weather = _weather(spark, sf_dir).groupBy("airport", "as_of").agg(F.min_by("type", F.struct("zone", "pos")).alias("weather"))
    frames = {"polls": views.polls(spark, sf_dir).select("airport", "as_of", "total", "cancelled"), "weather": weather, "stops": _stops(spark, sf_dir).withColumnRenamed("ground_stop", "notice_stop")}
    streams = []
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}")
        streams.append(spark.readStream.schema(frame.schema).parquet(f"{folder}/{name}"))
    joined = alerts.stream_as_of(streams[0], streams[1:], "airport", "as_of").withColumn("ground_stop", F.coalesce("notice_stop", F.lit(False)))
    told = disruption.for_hotels(alerts.run_once(joined, f"{folder}/run"), feeds.hotel_airports(_hotels(spark, sf_dir)))
    return _naive(told.select("hotel_id", "airport", "as_of", "total", "cancelled", "weather", "ground_stop"), "as_of")


@register("notified_once", f"WITH {views.LEADS} SELECT id, 1 AS received FROM leads WHERE status = 'new'")
def notified_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New leads as a stream whose notifier dies twice, before it sends and before the ledger is written; a receiver that goes by payload ids gets each lead once."""
    folder, deaths = _folder(spark), ["before", "after"]
    views.leads(spark, sf_dir).where("status = 'new'").select("id", "source", "title").write.parquet(f"{folder}/leads")
    stream = spark.readStream.schema("id bigint, source string, title string").parquet(f"{folder}/leads")

    def send(batch: DataFrame, batch_id: int) -> None:
        if deaths and deaths[0] == "before":
            raise RuntimeError(deaths.pop(0))
        batch.write.mode("append").parquet(f"{folder}/inbox")
        if deaths:
            raise RuntimeError(deaths.pop(0))

    for _ in range(4):
        try:
            alerts.run_once(stream, f"{folder}/run", alerts.told_once(f"{folder}/ledger", send, ["id"]))
        except StreamingQueryException:
            continue
    inbox = spark.read.parquet(f"{folder}/inbox")
    return inbox.dropDuplicates(["payload_id"]).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("received"))


@register("stream_alerts", f"WITH acts AS ({ORACLES['alert_episodes']}) SELECT * FROM acts WHERE as_of < (SELECT max(date_trunc('hour', ts)) - INTERVAL 1 HOUR FROM events)")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert state machine as a stream over written polls; polls within the lateness still wait."""
    folder = _folder(spark)
    scored = _polls_scored(spark, sf_dir).select("airport", "as_of", "state", "score")
    scored.write.parquet(f"{folder}/polls")
    out = alerts.run_once(alerts.stream_alerts(spark.readStream.schema(scored.schema).parquet(f"{folder}/polls")), f"{folder}/run")
    return _naive(out.withColumn("score", F.round("score", 6)), "as_of", "started_at")

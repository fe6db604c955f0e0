"""Registered queries of the library and their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions.columns import cosine, payload_key, record_key, row_id, shorten, slug, title_case, weather_type, without_contact_data
from leadspark.operators import dedup, disruption, leads, metrics, model_steps, normalize, prescore, vectors
from leadspark.plans import views
from leadspark.sources import feeds, pages, reports

Query = Callable[[SparkSession, str], DataFrame]
#: Share of the cluster index's lists that a search looks into; the given vectors have no clusters, so recall needs most lists.
PROBED = 0.7
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


def _sql_prescore(high: list[str], low: list[str], geo: str) -> str:
    text = "lower(title || ' ' || location)"
    hits = lambda words: f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({text}, w))"
    near = f"(regexp_matches(location, '{geo}') OR regexp_matches(title, '{geo}'))"
    return f"""scored AS (
  SELECT *, CAST((CASE WHEN {near} THEN 2 ELSE 0 END) + (CASE WHEN value >= 10000000 THEN 2 WHEN value >= 1000000 THEN 1 ELSE 0 END)
              + len({hits(high)}) - 5 * len({hits(low)}) AS INTEGER) AS prescore,
         array_to_string(list_concat(list_filter([CASE WHEN {near} THEN 'Richmond/YVR location' END,
                     CASE WHEN value >= 10000000 THEN 'Value > $10M' WHEN value >= 1000000 THEN 'Value > $1M' END], lambda x: x IS NOT NULL),
              list_concat(list_transform({hits(high)}, lambda w: 'Keyword: ' || w), list_transform({hits(low)}, lambda w: 'Deprioritized: ' || w))), ', ') AS prescore_reason
  FROM projects)"""


_PRESCORE = _sql_prescore(views.KEYWORDS_HIGH, views.KEYWORDS_LOW, views.GEO)
_KEY = "sha256(source || '|' || external_id || '|' || title || '|' || coalesce(strftime(issued_at, '%Y-%m-%d'), '0001-01-01'))"


def _scored(projects: DataFrame) -> DataFrame:
    return prescore.with_prescore(projects, views.KEYWORDS_HIGH, views.KEYWORDS_LOW, views.GEO)


@register("ranked_projects", f"WITH {views.PROJECTS_FROM_ORDERS}, {_PRESCORE} SELECT {_KEY} AS hash, source, external_id, title, location, value, prescore, prescore_reason FROM scored WHERE prescore >= 2 ORDER BY prescore DESC, value DESC, external_id LIMIT 50")
def ranked_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hash, dedup within the batch, pre-score, threshold, top 50."""
    projects = views.projects_from_orders(spark, sf_dir).withColumn("hash", record_key())
    enough, _ = prescore.split_by_score(_scored(dedup.first_of_each(projects, "hash", [F.col("external_id")])), 2)
    top = enough.orderBy(F.desc("prescore"), F.desc("value"), "external_id").limit(50)
    return top.select("hash", "source", "external_id", "title", "location", "value", "prescore", "prescore_reason")


@register("record_hash_dedup", f"WITH {views.PROJECTS_FROM_ORDERS} SELECT source, count(*) AS n, count(DISTINCT {_KEY}) AS n_hashes, min({_KEY}) AS first_hash FROM projects GROUP BY source")
def record_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.with_hash(views.projects_from_orders(spark, sf_dir))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("n_hashes"), F.min("hash").alias("first_hash"))


@register("prescore_parts", f"WITH {views.PROJECTS_FROM_PARTS}, {_PRESCORE} SELECT external_id, prescore, prescore_reason, CASE WHEN prescore >= 1 THEN 'enrich' ELSE 'skipped' END AS fate FROM scored")
def prescore_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(views.projects_from_parts(spark, sf_dir)).select("external_id", "prescore", "prescore_reason", F.when(F.col("prescore") >= 1, "enrich").otherwise("skipped").alias("fate"))


@register("filter_funnel", "SELECT p_brand, count(*) FILTER (p_retailprice > 920 AND lower(trim(p_type)) IN ('large','small','promo') ) AS passed, count(*) FILTER (NOT p_retailprice > 920) AS skipped_low_value, count(*) FILTER (p_retailprice > 920 AND lower(trim(p_type)) NOT IN ('large','small','promo')) AS skipped_type FROM part GROUP BY p_brand")
def filter_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prescore.filter_funnel(views.table(spark, sf_dir, "part"), ["large", "small", "promo"], 920, "p_type", "p_retailprice", ["p_brand"])


@register("relevant_parts", "SELECT p_partkey, p_type, p_retailprice FROM part WHERE p_retailprice > 920 AND (contains(lower(p_name || ' ' || p_type), 'anvil') OR contains(lower(p_name || ' ' || p_type), 'gear')) AND NOT contains(lower(p_name || ' ' || p_type), 'old')")
def relevant_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = views.table(spark, sf_dir, "part")
    return part.where((F.col("p_retailprice") > 920) & pages.relevant(F.col("p_name"), F.col("p_type"), ["anvil", "gear"], ["old"])).select("p_partkey", "p_type", "p_retailprice")


@register("payload_hash_groups", f"WITH {views.RAW_INPUTS} SELECT hash, count(*) AS n, min(id) AS winning_id FROM raw_inputs GROUP BY hash HAVING count(*) > 1")
def payload_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.raw_inputs(spark, sf_dir).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("winning_id")).where("n > 1")


@register("unseen_documents", f"WITH {views.RAW_INPUTS} SELECT id, hash FROM raw_inputs r WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM raw_inputs s WHERE s.id % 5 = 0 AND s.hash = r.hash)")
def unseen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti-join of a batch with the seen table: a fifth of the documents counts as seen."""
    raw = views.raw_inputs(spark, sf_dir).select("id", "hash")
    return dedup.unseen(raw.where("id % 5 <> 0"), raw.where("id % 5 = 0")).select("id", "hash")


@register("seen_documents", f"WITH {views.RAW_INPUTS} SELECT id, hash FROM raw_inputs r WHERE id % 5 <> 0 AND EXISTS (SELECT 1 FROM raw_inputs s WHERE s.id % 5 = 0 AND s.hash = r.hash)")
def seen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_inputs(spark, sf_dir).select("id", "hash")
    return dedup.already_seen(raw.where("id % 5 <> 0"), raw.where("id % 5 = 0")).select("id", "hash")


@register("insert_returning", f"WITH {views.RAW_INPUTS}, s AS (SELECT hash, min(id) AS k FROM raw_inputs WHERE id % 5 = 0 GROUP BY hash), b AS (SELECT id, hash, min(id) OVER (PARTITION BY hash) AS f FROM raw_inputs WHERE id % 5 <> 0) SELECT b.id, b.hash, coalesce(s.k, b.f) AS winning_id FROM b LEFT JOIN s ON b.hash = s.hash")
def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_inputs(spark, sf_dir).select("id", "hash")
    return dedup.insert_returning(raw.where("id % 5 = 0"), raw.where("id % 5 <> 0"), F.col("id"))[1].select("id", "hash", "winning_id")


@register("insert_ignore", f"WITH {views.RAW_INPUTS} SELECT min(id) AS id, hash FROM raw_inputs r WHERE id % 5 <> 0 AND NOT EXISTS (SELECT 1 FROM raw_inputs s WHERE s.id % 5 = 0 AND s.hash = r.hash) GROUP BY hash")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_inputs(spark, sf_dir).select("id", "hash")
    return dedup.insert_ignore(raw.where("id % 5 = 0"), raw.where("id % 5 <> 0"), [F.col("id")]).select("id", "hash")


@register("upsert_documents", f"WITH {views.RAW_INPUTS}, v AS (SELECT id % 100 AS k, id AS version, source FROM raw_inputs) SELECT k, max(version) AS version, arg_max(source, version) AS source FROM v GROUP BY k")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.raw_inputs(spark, sf_dir).select(F.pmod("id", F.lit(100)).alias("k"), F.col("id").alias("version"), "source")
    return dedup.upsert(rows.where("version % 2 = 0"), rows.where("version % 2 = 1"), "k", F.col("version"))


_PII = r"regexp_replace(regexp_replace(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[REDACTED EMAIL]', 'g'), '(\+?\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}', '[REDACTED PHONE]', 'g')"


@register("redact_contact_data", f"SELECT doc_id, {_PII} <> text AS changed, sha256({_PII}) AS redacted_hash FROM documents")
def redact_contact_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = without_contact_data("text")
    return views.table(spark, sf_dir, "documents").select("doc_id", (clean != F.col("text")).alias("changed"), payload_key(clean).alias("redacted_hash"))


@register("safe_purge", f"WITH {views.RAW_INPUTS} SELECT source, count(*) AS purged FROM raw_inputs r WHERE created_at < TIMESTAMP '2024-02-15' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.id) GROUP BY source")
def safe_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_inputs(spark, sf_dir).select("id", "source", "created_at")
    refs = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("raw_input_id"))
    return dedup.purge(raw, refs, F.lit("2024-02-15").cast("timestamp"))[1].groupBy("source").agg(F.count(F.lit(1)).alias("purged"))


@register("purge_keeps", f"WITH {views.RAW_INPUTS} SELECT id FROM raw_inputs r WHERE NOT (created_at < TIMESTAMP '2024-02-15' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = r.id))")
def purge_keeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.raw_inputs(spark, sf_dir).select("id", "created_at")
    refs = views.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("raw_input_id"))
    return dedup.purge(raw, refs, F.lit("2024-02-15").cast("timestamp"))[0].select("id")


@register("reconcile_counts", "SELECT (SELECT count(*) FROM documents) AS source_rows, (SELECT count(*) FROM labels) AS target_rows, (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS matches")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.reconcile(views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels"))


@register("set_status", f"WITH {views.LEADS} SELECT id, CASE WHEN status = 'new' THEN 'notified' ELSE status END AS status FROM leads")
def set_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.leads(spark, sf_dir).select("id", "status")
    return dedup.set_status(rows, rows.where("status = 'new'").select("id", F.lit("notified").alias("status")))[0]


@register("retry_set", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def retry_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen records without a lead, to be tried again."""
    return dedup.unseen(views.table(spark, sf_dir, "documents").select("doc_id"), views.table(spark, sf_dir, "labels"), "doc_id")


@register("leads_by_source_status", f"WITH {views.LEADS} SELECT source, status, count(*) AS n FROM leads GROUP BY source, status")
def leads_by_source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.counts_by(views.leads(spark, sf_dir), "source", "status")


@register("ranked_leads", f"WITH {views.LEADS} SELECT id, priority_score, created_at FROM leads ORDER BY priority_score DESC, created_at DESC, id LIMIT 100")
def ranked_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.ranked(views.leads(spark, sf_dir).select("id", "priority_score", "created_at"), 100)


@register("weekly_digest", f"WITH {views.LEADS} SELECT id, status, created_at FROM leads WHERE status IN ('new','notified') AND created_at >= TIMESTAMP '2024-03-20' - INTERVAL 7 DAYS")
def weekly_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.digest(views.leads(spark, sf_dir), F.lit("2024-03-20").cast("timestamp")).select("id", "status", "created_at")


@register("priority_alerts", f"WITH {views.LEADS} SELECT id, priority_score FROM leads WHERE priority_score >= 9")
def priority_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.priority_alerts(views.leads(spark, sf_dir), 9).select("id", "priority_score")


@register("search_leads", f"WITH {views.LEADS} SELECT id FROM leads WHERE priority_score >= 7 AND status = 'new' AND title ILIKE '%the%' AND rationale IS NOT NULL")
def search_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.search(views.leads(spark, sf_dir), 7, "new", text="the", with_rationale=True).select("id")


@register("lineage", "SELECT d.doc_id AS id, CASE WHEN l.doc_id IS NULL THEN 'no lead' WHEN d.doc_id % 11 = 0 THEN 'no link' WHEN d.doc_id % 7 = 0 THEN 'no payload' ELSE 'ok' END AS lookup_status, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 11 <> 0 AND d.doc_id % 7 <> 0 THEN sha256(text) END AS hash FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asked for by id; some leads have no link and some payloads are gone."""
    docs, labels = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    held = labels.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 11 != 0, F.col("doc_id").cast("string")).alias("raw_input_id"))
    raw = docs.where("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("id"), payload_key("text").alias("hash"), F.lit("text/plain").alias("payload_type"), F.col("source").alias("source_url"))
    asked = docs.select(F.col("doc_id").cast("string").alias("id"))
    return leads.lineage(held, raw, asked).select(F.col("id").cast("bigint").alias("id"), "lookup_status", "hash")


@register("outreach_log", "SELECT l_orderkey, l_linenumber, l_shipdate AS logged_at, o_orderpriority AS title FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def outreach_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("lead_id"), F.col("l_linenumber").alias("id"), F.col("l_shipdate").alias("logged_at"))
    held = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    return leads.outreach(log, held).select(F.col("lead_id").alias("l_orderkey"), F.col("id").alias("l_linenumber"), "logged_at", "title")


@register("newest_per_source", f"WITH {views.LEADS} SELECT source, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, id) AS r FROM leads) WHERE r <= 3")
def newest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leads.newest_per(views.leads(spark, sf_dir), ["source"], [F.desc("created_at"), F.col("id")], 3).select("source", "id", "created_at")


@register("source_report", f"WITH {views.LEADS} SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS won, count(*) FILTER (toxic = 1) AS flagged, count(*) FILTER (quality = 1) / count(*) AS hit_rate, count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality = 1) + count(*) FILTER (toxic = 1), 0) AS accuracy, count(*) FILTER (quality = 1) / count(*) < 0.05 AS weak FROM leads GROUP BY source")
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_report(views.leads(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 1)


@register("attributed_wins", f"WITH {views.LEADS}, f AS (SELECT l.id, min(e.ts) AS won_at FROM leads l JOIN events e ON e.user_id = l.id AND e.event_type = 'purchase' AND e.ts >= l.created_at AND e.ts < l.created_at + INTERVAL 14 DAY GROUP BY l.id) SELECT source, count(*) AS n, count(won_at) AS won, round(avg((epoch_us(won_at) - epoch_us(created_at)) / 86400000000), 6) AS mean_days, count(won_at) / count(*) AS hit_rate FROM leads LEFT JOIN f USING (id) GROUP BY source")
def attributed_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins of each source within two weeks of a lead's arrival, purchases standing for wins."""
    events = views.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("lead_id"), F.col("ts").cast("timestamp").alias("at"))
    return metrics.attributed(views.leads(spark, sf_dir), events, 14).withColumn("mean_days", F.round("mean_days", 6))


@register("shared_inputs", "SELECT sha256(text) AS raw_input_id, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) > 1")
def shared_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that several leads go back to."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", payload_key("text").alias("raw_input_id"))
    return metrics.shared_inputs(views.table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id"))


@register("snapshot_changes", "WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[0-9?#].*$', '') AS page, page_id, sha256(html) AS digest FROM pages), s AS (SELECT *, lag(digest) OVER (PARTITION BY page ORDER BY page_id) AS previous FROM p) SELECT page, page_id, digest, previous FROM s WHERE previous IS NOT NULL AND previous <> digest")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of one address, query and number left out, whose content differs from the capture before."""
    address = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[0-9?#].*$", "")
    rows = views.table(spark, sf_dir, "pages").select(address.alias("page"), "page_id", payload_key("html").alias("digest"))
    return metrics.snapshot_changes(rows, "page", "page_id", "digest").select("page", "page_id", "digest", "previous")


@register("snapshot_line_changes", "WITH p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[0-9?#].*$', '') AS page, page_id, html FROM pages), s AS (SELECT page, page_id, lag(page_id) OVER w AS previous, list_distinct(string_split(html, chr(10))) AS a, list_distinct(string_split(lag(html) OVER w, chr(10))) AS b, html <> lag(html) OVER w AS changed FROM p WINDOW w AS (PARTITION BY page ORDER BY page_id)) SELECT page, page_id, previous, CAST(len(list_filter(a, lambda x: NOT list_contains(b, x))) AS INTEGER) AS added, CAST(len(list_filter(b, lambda x: NOT list_contains(a, x))) AS INTEGER) AS removed FROM s WHERE changed")
def snapshot_line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines came and went between captures of one address."""
    address = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[0-9?#].*$", "")
    rows = views.table(spark, sf_dir, "pages").select(address.alias("page"), "page_id", "html")
    return metrics.line_changes(rows, "page", "page_id", "html").withColumns({"added": F.size("added"), "removed": F.size("removed")})


@register("weekly_demand", "SELECT date_trunc('week', o_orderdate) AS week, c_mktsegment AS source, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def weekly_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = views.table(spark, sf_dir, "orders").join(views.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = metrics.weekly_demand(joined.withColumn("source", F.col("c_mktsegment")), "o_orderdate", ["source"])
    return out.withColumn("week", F.col("week").cast("timestamp_ntz"))


@register("call_metrics", "SELECT event_type AS use_case, CASE WHEN value >= 5 THEN 'ok' ELSE 'error' END AS status, count(*) AS calls, CAST(sum(event_id % 50) AS BIGINT) AS tokens, " + ", ".join(f"count(*) FILTER (floor(value * 1000) <= {b}) AS le_{b}" for b in (100, 500, 1000, 2500, 5000, 10000, 20000, 30000)) + " FROM events GROUP BY 1, 2")
def call_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("use_case"), F.when(F.col("value") >= 5, "ok").otherwise("error").alias("status"), F.floor(F.col("value") * 1000).alias("latency_ms"), (F.col("event_id") % 50).alias("tokens"))
    return metrics.call_metrics(rows)


# Disruption ---------------------------------------------------------------------------------------

_TOD = "CASE WHEN hour(as_of) >= 21 THEN 1.5::DOUBLE WHEN hour(as_of) >= 18 THEN 1.2::DOUBLE WHEN hour(as_of) >= 6 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END"
_SCORED = f"""{views.POLLS}, p1 AS (SELECT *, rate > 0.2 AS on_, lag(rate > 0.2) OVER (PARTITION BY airport ORDER BY as_of) AS was FROM polls),
p2 AS (SELECT *, sum(CASE WHEN on_ AND NOT coalesce(was, false) THEN 1 ELSE 0 END) OVER (PARTITION BY airport ORDER BY as_of) AS run FROM p1),
p3 AS (SELECT *, CASE WHEN on_ THEN CAST(floor((epoch(as_of) - epoch(min(CASE WHEN on_ THEN as_of END) OVER (PARTITION BY airport, run))) / 60) AS INTEGER) + 60 ELSE 0 END AS minutes_active FROM p2),
p4 AS (SELECT *, rate * 160::DOUBLE * 0.58::DOUBLE * ({_TOD}) * least(minutes_active / 60.0::DOUBLE, 3.0::DOUBLE) AS score FROM p3),
scored AS (SELECT *, CASE WHEN score < 20 THEN 'Ignore' WHEN score < 60 THEN 'Watch' WHEN score < 120 THEN 'SoftAlert' ELSE 'HardAlert' END AS state FROM p4)"""


def _polls_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disruption.with_score(disruption.with_minutes_active(views.polls(spark, sf_dir), 0.2, close_minutes=60))


@register("hourly_polls", f"WITH {views.POLLS} SELECT airport, as_of, total, cancelled, round(rate, 9) AS rate FROM polls")
def hourly_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.polls(spark, sf_dir).select("airport", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "total", "cancelled", F.round("rate", 9).alias("rate"))


@register("disruption_scores", f"WITH {_SCORED} SELECT airport, as_of, minutes_active, round(score, 6) AS score, state FROM scored")
def disruption_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _polls_scored(spark, sf_dir).select("airport", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "minutes_active", F.round("score", 6).alias("score"), "state")


@register(
    "alert_episodes",
    f"""WITH {_SCORED},
e1 AS (SELECT *, state <> 'Ignore' AS act, coalesce(lag(state <> 'Ignore') OVER (PARTITION BY airport ORDER BY as_of), false) AS wasact FROM scored),
e2 AS (SELECT *, sum(CASE WHEN act AND NOT wasact THEN 1 ELSE 0 END) OVER (PARTITION BY airport ORDER BY as_of) AS ep FROM e1),
e3 AS (SELECT *, min(as_of) OVER (PARTITION BY airport, ep) AS started_at FROM e2 WHERE act OR wasact),
e4 AS (SELECT *, CAST(floor((epoch(as_of) - epoch(started_at)) / 60) AS INTEGER) AS minutes, lag(score) OVER (PARTITION BY airport, ep ORDER BY as_of) AS last FROM e3),
e5 AS (SELECT *, min(CASE WHEN minutes >= 30 AND state IN ('SoftAlert','HardAlert') THEN as_of END) OVER (PARTITION BY airport, ep) AS alert FROM e4),
e6 AS (SELECT *, CASE WHEN NOT act AND alert IS NOT NULL THEN 'RESOLVE' WHEN NOT act THEN NULL WHEN as_of = alert THEN 'POST' WHEN as_of > alert AND score <> last THEN 'UPDATE' END AS action FROM e5)
SELECT airport, as_of, started_at, minutes, state, round(score, 6) AS score, action FROM e6 WHERE action IS NOT NULL""",
)
def alert_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = disruption.alert_episodes(_polls_scored(spark, sf_dir))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("as_of", "started_at")}).withColumn("score", F.round("score", 6))


@register("any_active", f"WITH {_SCORED} SELECT as_of, bool_or(state IN ('SoftAlert','HardAlert')) AS any_active FROM scored GROUP BY as_of")
def any_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disruption.any_active(_polls_scored(spark, sf_dir), ["as_of"]).withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@register("as_of_inventory", f"WITH {views.POLLS}, inv AS (SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, ts AS as_of, max(event_id % 40) AS rooms FROM events WHERE event_type = 'signup' GROUP BY 1, 2) SELECT p.airport, p.as_of, coalesce(i.rooms, -1) AS rooms FROM polls p ASOF LEFT JOIN inv i ON p.airport = i.airport AND p.as_of >= i.as_of")
def as_of_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room inventory at the time of every poll; the last value set holds."""
    events = views.table(spark, sf_dir, "events").where("event_type = 'signup'")
    rooms = events.groupBy(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.col("ts").cast("timestamp").alias("as_of")).agg(F.max(F.col("event_id") % 40).alias("rooms"))
    return disruption.as_of(views.polls(spark, sf_dir).select("airport", "as_of"), rooms, "airport", "as_of", ["rooms"]).withColumns({"as_of": F.col("as_of").cast("timestamp_ntz"), "rooms": F.coalesce("rooms", F.lit(-1))})


# Vectors -------------------------------------------------------------------------------------------


@register("nearest_one", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) DESC, vec_id LIMIT 10")
def nearest_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows, query, 10).withColumn("similarity", F.round("similarity", 6))


@register("nearest_each", "WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbor_id) AS rank FROM p) SELECT query_id, neighbor_id, round(s, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def nearest_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    return vectors.nearest_each(rows, rows.where("vec_id % 100 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@register("clustered_recall", "SELECT true AS recall_reached, true AS pruned, 10 * count(*) AS neighbours FROM embeddings WHERE vec_id % 100 = 0")
def clustered_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether cluster-pruned search finds nine in ten exact neighbours and leaves a fifth of the rows unscanned."""
    rows = views.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0")
    index = vectors.ClusterIndex(rows)
    probe = max(1, round(PROBED * index.lists))
    found = vectors.recall(index.search(asked, 10, probe), vectors.nearest_each(rows, asked, 10))
    both = found.crossJoin(index.share_scanned(asked, probe))
    return both.select((F.col("recall") >= 0.9).alias("recall_reached"), (F.col("share_scanned") < 0.8).alias("pruned"), "neighbours")


@register("centroid_similarity", "WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT label AS l, arg_min(e, vec_id) AS e FROM c GROUP BY label) SELECT c.label, count(*) AS n, round(avg(list_cosine_similarity(c.e, q.e)), 6) AS mean_similarity FROM c JOIN q ON c.label = q.l GROUP BY c.label")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"))
    return rows.join(first, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(cosine("embedding", "q")), 6).alias("mean_similarity"))


# Text, pages, models ------------------------------------------------------------------------------


@register("conversation_requests", "SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ':' || text, '|' ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id")
def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model_steps.conversation_requests(views.table(spark, sf_dir, "conversations"))
    turns = F.from_json("request", "array<struct<role:string,content:string>>")
    return out.select("conv_id", "n_turns", F.md5(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")).alias("digest"))


@register("text_forms", "SELECT c_custkey, trim(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, c_mktsegment[1] || lower(c_mktsegment[2:]) AS segment FROM customer")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "customer").select("c_custkey", slug("c_name").alias("slug"), title_case("c_mktsegment").alias("segment"))


@register("shortened_texts", r"SELECT doc_id, CASE WHEN strlen(t) > 280 THEN trim(CASE WHEN contains(substr(t, 1, 281), ' ') THEN regexp_extract(substr(t, 1, 281), '(?s)^(.*) ', 1) ELSE substr(t, 1, 280) END) ELSE t END AS short FROM (SELECT doc_id, trim(text) AS t FROM documents)")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select("doc_id", shorten("text").alias("short"))


@register("model_call_stub", "SELECT doc_id AS id, 'ok' AS status, 1 AS attempts, CAST(length(text) AS BIGINT) AS n FROM documents")
def model_call_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all documents through the call step with a stand-in model that returns their length."""
    docs = views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("request"))
    out = model_steps.call_model(docs, lambda body: str(len(body)))
    return out.select(F.col("id").cast("bigint").alias("id"), "status", "attempts", F.col("response").cast("bigint").alias("n"))


@register("event_props", "SELECT event_id, TRY_CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))


@register("document_lines", "SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, chr(32) || chr(9) || chr(13) || chr(12) || chr(10)) <> '' GROUP BY doc_id")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports.document_lines(views.table(spark, sf_dir, "documents"), "text")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))


@register("flow_report_records", "SELECT p_partkey AS doc_id, p_type AS sub_type, printf('%02d %06d 000 00 B7', p_size % 100, p_partkey % 1000000) AS folder_number, p_name AS work_proposed, 'Issued' AS status, p_brand AS address, CAST('2024-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issue_date, CAST(floor(p_retailprice) AS BIGINT) AS value, p_brand AS applicant FROM part")
def flow_report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written out as flow-layout reports and parsed back."""
    day = F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0")
    number = F.format_string("%02d %06d 000 00 B7", F.col("p_size") % 100, F.col("p_partkey") % 1000000)
    lines = [F.concat(F.lit("SUB TYPE: "), F.col("p_type")), number, F.col("p_name"), F.lit("Issued"), F.concat(F.lit("2024/03/"), day, F.lit(" 1")), F.concat(F.lit("$"), F.floor("p_retailprice").cast("string"), F.lit(".00")), F.lit("FOLDER NAME"), F.col("p_brand"), F.concat(F.lit("APPLICANT "), F.col("p_brand"))]
    docs = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(F.array(*lines), "\n").alias("value"))
    return reports.flow_records(reports.document_lines(docs)).select("doc_id", "sub_type", "folder_number", "work_proposed", "status", "address", "issue_date", "value", "applicant")


_REPORT_ROWS = """rows AS (
  SELECT p_partkey // 3 AS doc_id, p_partkey, 0 AS k, p_type AS sub_type, printf('%02d %06d 000 00 B7', p_size % 100, p_partkey % 1000000) AS folder_number, p_name AS work_proposed, 'Issued' AS status, p_brand AS address,
         CAST('2024-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issue_date, CAST(floor(p_retailprice) AS BIGINT) AS value, p_brand AS applicant, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS contractor FROM part
  UNION ALL SELECT p_partkey // 3, p_partkey, 1, p_type, printf('%02d %06d 001 00 C1', p_size % 100, p_partkey % 1000000), 'Extra', 'Held', 'Annex', DATE '2024-04-02', 7500, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END FROM part WHERE p_partkey % 4 = 0)"""


@register("flow_report_sections", f"WITH {_REPORT_ROWS} SELECT doc_id, sub_type, folder_number, work_proposed, status, address, issue_date, value, applicant, contractor FROM rows")
def flow_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three sections each: one or two records a section, page lines in between, a number's suffix on a line of its own, contact blocks at the end."""
    part, key = views.table(spark, sf_dir, "part"), F.col("p_partkey")
    number = lambda text: F.format_string(f"%02d %06d {text}", F.col("p_size") % 100, key % 1000000)
    day = F.concat(F.lit("2024/03/"), F.lpad((key % 28 + 1).cast("string"), 2, "0"))
    head = F.when(key % 2 == 0, number("000 00 B7")).otherwise(F.concat(number("000 00"), F.lit("\nB7")))
    first = F.concat_ws("\n", F.concat(F.lit("SUB TYPE: "), F.col("p_type")), F.lit("Folder Number   Work Proposed"), head, F.col("p_name"), F.lit("Issued"), day, F.concat(F.lit("$"), F.floor("p_retailprice").cast("string"), F.lit(".00")), F.lit("FOLDER NAME"), F.col("p_brand"))
    second = F.when(key % 4 == 0, F.concat(F.lit("\n"), number("001 00 C1"), F.lit("\nExtra\nHeld\n2024/04/02 2\n$0.00\n$7,500.00\nFOLDER NAME Annex"))).otherwise("")
    contact = F.when(key % 2 == 0, F.concat(F.lit("APPLICANT "), F.col("p_brand"), F.lit("\nCONTRACTOR "), F.col("p_name"))).otherwise(F.concat(F.lit("APPLICANT\n"), F.col("p_brand")))
    rows = part.select(F.floor(key / 3).alias("doc_id"), F.struct(key.alias("k"), F.concat(first, second, F.lit("\nSub total 3")).alias("t"), contact.alias("c")).alias("r"))
    folded = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    text = F.concat_ws("\n", F.array_join(F.transform("r", lambda x: x["t"]), "\n"), F.array_join(F.transform("r", lambda x: x["c"]), "\n"))
    return reports.flow_records(reports.document_lines(folded.select("doc_id", text.alias("value")))).select("doc_id", "sub_type", "folder_number", "work_proposed", "status", "address", "issue_date", "value", "applicant", "contractor")


@register("column_report_pages", "SELECT p_partkey // 3 AS doc_id, 'BP' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS permit_number, CAST('2024-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issue_date, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS value, p_type || ' - NORTH' AS type_raw, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS purpose, p_brand AS civic_address FROM part")
def column_report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of three records each with page lines that belong to none, an empty address and a missing purpose."""
    key = F.col("p_partkey")
    head = F.concat(F.lit("Mar "), (key % 28 + 1).cast("string"), F.lit(", 2024  BP"), F.lpad(key.cast("string"), 6, "0"), F.lit(" "), F.upper("p_name"), F.lit("   120.00   "), F.floor("p_retailprice").cast("string"), F.lit(",000.00"))
    purpose = F.when(key % 2 == 0, F.concat(F.lit("\n  Purpose "), F.col("p_name"))).otherwise("")
    one = F.concat(head, F.lit("\n  Type "), F.col("p_type"), F.lit(" - NORTH"), purpose, F.lit("\n  Civic Address: \nPage 1 of 9\nType NOT INDENTED\n  Civic Address: "), F.col("p_brand"))
    rows = views.table(spark, sf_dir, "part").select(F.floor(key / 3).alias("doc_id"), F.struct(key.alias("k"), one.alias("t")).alias("r"))
    docs = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["t"]), "\n").alias("value"))
    return reports.column_records(reports.document_lines(docs, trim=False)).select("doc_id", "permit_number", "issue_date", "value", "type_raw", "purpose", "civic_address")


@register("weather_types", "SELECT event_id, CASE WHEN contains(upper(event_type || ' ' || props), 'SNOW') THEN 'Snow' WHEN contains(upper(event_type || ' ' || props), 'FOG') THEN 'Fog' WHEN contains(lower(event_type), 'atmospheric') THEN 'AtmosphericRiver' WHEN contains(upper(event_type || ' ' || props), 'WIND') THEN 'Wind' ELSE 'Unknown' END AS type FROM events")
def weather_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select("event_id", weather_type(F.concat_ws(" ", "event_type", "props"), F.col("event_type")).alias("type"))


@register("pushed_leads", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'webhook' ELSE source END AS source, 'new' AS status FROM documents")
def pushed_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("source")).alias("source"), F.lit(None).cast("string").alias("status"), row_id(F.col("doc_id").cast("string")).alias("id"), F.lit("").alias("title"), F.lit("").alias("location"))
    return feeds.pushed_leads(rows).select("doc_id", "source", "status")


# Records written in a source's form and parsed back ---------------------------------------------------


@register("column_report_records", "SELECT p_partkey AS doc_id, 'BP' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS permit_number, upper(p_name) AS builder, CAST('2024-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issue_date, CAST(floor(p_retailprice) AS BIGINT) * 1000 AS value, p_type || ' - NORTH' AS type_raw, lower(p_type) AS type_prefix, p_brand AS civic_address FROM part")
def column_report_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = (F.col("p_partkey") % 28 + 1).cast("string")
    head = F.concat(F.lit("Mar "), day, F.lit(", 2024  BP"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(" "), F.upper("p_name"), F.lit("   120.00   "), F.floor("p_retailprice").cast("string"), F.lit(",000.00"))
    lines = [head, F.concat(F.lit("  Type "), F.col("p_type"), F.lit(" - NORTH")), F.lit("  Civic Address: "), F.concat(F.lit("  Civic Address: "), F.col("p_brand"))]
    docs = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array_join(F.array(*lines), "\n").alias("value"))
    return reports.column_records(reports.document_lines(docs, trim=False)).select("doc_id", "permit_number", "builder", "issue_date", "value", "type_raw", "type_prefix", "civic_address")


@register("permit_projects", "SELECT 'column_permits' AS source, 'BP' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS external_id, p_type || ' - NORTH — ' || p_brand AS title, p_brand || ', Delta BC' AS location, sha256('column_permits|BP' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '|' || p_brand || '|2024-03-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0')) AS hash FROM part WHERE CAST(floor(p_retailprice) AS BIGINT) * 1000 > 920000 AND lower(p_type) IN ('large', 'small')")
def permit_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = prescore.relevant_permits(column_report_records(spark, sf_dir).withColumn("purpose", F.lit("")), ["large", "small"], 920_000, "type_prefix")
    return normalize.column_permit_projects(records).select("source", "external_id", "title", "location", "hash")


@register("award_notices", "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, o_orderpriority AS title, CAST(floor(o_totalprice) AS BIGINT) AS value, CAST(o_orderdate AS DATE) AS issued_at, sha256('awards|' || CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority || '|') AS hash FROM orders")
def award_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON award notices; every other value is a dollar text."""
    value = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('"$'), F.format_number(F.floor("o_totalprice"), 0), F.lit('.00"'))).otherwise(F.floor("o_totalprice").cast("string"))
    text = F.concat(F.lit('[{"opportunity_id":"'), F.col("o_orderkey").cast("string"), F.lit('","title":"'), F.col("o_orderpriority"), F.lit('","value":'), value, F.lit(',"award_date":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"},{"title":"no id"}]'))
    records, _ = feeds.award_notices(views.table(spark, sf_dir, "orders").select(text.alias("value")))
    return records.select("external_id", "title", "value", "issued_at", "hash")


@register("feed_items", "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'g' || CAST(c_custkey AS VARCHAR) ELSE 'http://news/' || CAST(c_custkey AS VARCHAR) END AS external_id, c_name AS title, sha256('news:' || CASE WHEN c_custkey % 2 = 0 THEN 'g' || CAST(c_custkey AS VARCHAR) ELSE 'http://news/' || CAST(c_custkey AS VARCHAR) END) AS hash, CAST('2024-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issued_at FROM customer")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as feed documents of one item; every other one has no guid."""
    key = F.col("c_custkey").cast("string")
    guid = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<guid>g"), key, F.lit("</guid>"))).otherwise("")
    text = F.concat(F.lit("<rss><channel><item><title>"), F.col("c_name"), F.lit("</title><link>http://news/"), key, F.lit("</link><pubDate>Tue, "), F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"), F.lit(" Mar 2024 10:00:00 GMT</pubDate>"), guid, F.lit("</item></channel></rss>"))
    return feeds.feed_items(views.table(spark, sf_dir, "customer").select(text.alias("value"))).select("external_id", "title", "hash", "issued_at")


@register("production_projects", "SELECT trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS external_id, n_name || ', BC' AS location, CAST('2026-03-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS DATE) AS issued_at, CASE WHEN c_custkey % 3 = 0 THEN 'Feature Film' ELSE 'TV Series' END || ' — ' || c_mktsegment || ' | Schedule: 3/' || CAST(c_custkey % 28 + 1 AS VARCHAR) || '/2026 - 4/10/2026 | Address: 1 Road, ' || n_name || ', Canada' AS description FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 < 2")
def production_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages of a labelled production list; one in three is of a type that is not kept."""
    rows = views.table(spark, sf_dir, "customer").join(views.table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.element_at(F.array(F.lit("Feature"), F.lit("TV Series"), F.lit("Commercial")), (F.col("c_custkey") % 3 + 1).cast("int"))
    html = F.concat(F.lit('<div id="list"><h5>'), kind, F.lit('</h5><h3 class="production">'), F.upper("c_name"), F.lit("</h3><p><b>Studio:</b> "), F.col("c_mktsegment"), F.lit("</p><p><b>Schedule:</b> 3/"), (F.col("c_custkey") % 28 + 1).cast("string"), F.lit("/2026 - 4/10/2026</p><p><b>Address:</b> 1 Road, "), F.col("n_name"), F.lit(", Canada</p></div>"))
    records, _ = pages.labelled_list(rows.select(F.col("c_custkey").alias("page_id"), html.alias("html")), "h5", "h3", container='id="list"')
    return normalize.production_projects(records).select("external_id", "location", "issued_at", "description")


@register("weather_alert_rows", "SELECT event_id, unnest(['z1', 'z2']) AS zone, unnest([CASE WHEN event_type = 'error' THEN 'Snow' WHEN event_type = 'click' THEN 'Wind' ELSE 'Unknown' END, 'Fog']) AS type FROM events")
def weather_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as GeoJSON documents of two alerts."""
    event = F.when(F.col("event_type") == "error", "SNOWFALL WARNING").when(F.col("event_type") == "click", "Wind warning").otherwise("heat")
    text = F.concat(F.lit('{"features":[{"properties":{"event":"'), event, F.lit('","headline":"x","severity":"s","zone":"z1"}},{"properties":{"event":"Fog","zone":"z2"}}]}'))
    return feeds.weather_alerts(views.table(spark, sf_dir, "events").select("event_id", text.alias("value"))).select("event_id", "zone", "type")


@register("weather_tuning", "SELECT event_type, count(*) AS n, CASE event_type WHEN 'error' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS duration_weight, CASE event_type WHEN 'click' THEN 40.0::DOUBLE ELSE 60.0::DOUBLE END AS watch_threshold FROM events GROUP BY event_type")
def weather_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    kinds = rows.withColumn("type", F.when(F.col("event_type") == "error", "Fog").when(F.col("event_type") == "click", "AtmosphericRiver").otherwise("Wind"))
    return normalize.with_weather_tuning(kinds).select("event_type", "n", "duration_weight", "watch_threshold")


@register("flight_board", "SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, CAST(ts AS DATE) AS as_of, count(*) AS total, count(*) FILTER (event_type = 'error') AS cancelled, round(count(*) FILTER (event_type = 'error') / count(*), 9) AS rate, bool_or(event_type = 'signup') AS ground_stop FROM events GROUP BY 1, 2")
def flight_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "error", "AC 1 CANCELLED").when(F.col("event_type") == "signup", "Ground stop in effect").otherwise("AC 2 on time")
    rows = views.table(spark, sf_dir, "events").select(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.col("ts").cast("date").alias("as_of"), text.alias("row_text"))
    return feeds.flight_board(rows).withColumn("rate", F.round("rate", 9))


@register("ground_stops", "SELECT 'A' || CAST(user_id % 3 AS VARCHAR) AS airport, CAST(ts AS DATE) AS as_of, bool_or(event_type = 'signup') AS ground_stop FROM events GROUP BY 1, 2")
def ground_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("event_type") == "signup", "yvr gnd stop").otherwise("routine")
    rows = views.table(spark, sf_dir, "events").select(F.concat(F.lit("A"), F.pmod("user_id", F.lit(3)).cast("string")).alias("airport"), F.col("ts").cast("date").alias("as_of"), text.alias("value"))
    return feeds.ground_stops(rows)


@register("parsed_answers", "SELECT doc_id, CAST(n_chars % 10 AS INTEGER) AS priority_score, 'note ' || source AS notes FROM documents WHERE doc_id % 3 = 0")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model responses made of the documents; two in three are malformed or of a wrong type."""
    score = F.when(F.col("doc_id") % 3 == 1, F.lit('\\"high\\"')).otherwise((F.col("n_chars") % 10).cast("string"))
    body = F.concat(F.lit('{"content":[{"type":"text","text":"```json\\n{\\"priority_score\\": '), score, F.lit(', \\"notes\\": \\"note '), F.col("source"), F.lit('\\"}\\n```"}]}'))
    answers = views.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 2, "oops").otherwise(body).alias("response"))
    return model_steps.parse_answers(answers)[0].select("doc_id", "priority_score", "notes")


@register("parsed_signals", "SELECT doc_id, source AS org_name, CAST(n_chars % 50 AS INTEGER) AS crew_size, CASE WHEN n_chars % 50 > 0 THEN 2 ELSE 1 END AS field_hits FROM documents")
def parsed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"org_name":"'), F.col("source"), F.lit('","crew_size":'), (F.col("n_chars") % 50).cast("string"), F.lit('.5,"duration_days":"x","location":7}'))
    answers = views.table(spark, sf_dir, "documents").select("doc_id", body.alias("response"))
    return model_steps.parse_signals(answers).select("doc_id", "org_name", "crew_size", "field_hits")


@register("prompts", "SELECT CAST(o_orderkey AS VARCHAR) AS external_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Site ' || o_orderpriority || ' ' || c_name || ' in ' || n_name ELSE 'Assess this record for group lodging demand.' || chr(10) || 'Source: ' || c_mktsegment || chr(10) || 'Title: ' || o_orderpriority || ' ' || c_name || chr(10) || 'Location: ' || n_name || chr(10) || 'Value (CAD): ' || CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR) || chr(10) || 'Issued: ' || strftime(o_orderdate, '%Y-%m-%d') || chr(10) || 'Details: ' || chr(10) || 'Link: ' END AS prompt FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame([("BUILDING", "Site {title} in {location}")], "source string, template string")
    rows = views.projects_from_orders(spark, sf_dir).withColumns({"description": F.lit(""), "source_url": F.lit("")})
    return model_steps.with_prompt(rows, templates).select("external_id", "prompt")


@register("repeat_organisations", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 0 END AS bonus FROM supplier")
def repeat_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers against past organisations, which are the even ones written another way."""
    word = F.concat(F.lit("org"), F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 16))
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(word, F.lit(" Ltd")).alias("org_name"))
    past = views.table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.upper(word), F.lit(", Inc.")).alias("org_name"))
    return metrics.repeat_organisations(rows, past).select("s_suppkey", "bonus")


@register(
    "repeat_organisations_edited",
    """WITH past AS (SELECT DISTINCT substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 14 + s_suppkey % 4) AS p FROM supplier WHERE s_suppkey % 2 = 0),
asked AS (SELECT s_suppkey, substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 14 + s_suppkey % 4) AS w FROM supplier),
edited AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN w WHEN 1 THEN 'z' || w WHEN 2 THEN 'yz' || substr(w, 3) WHEN 3 THEN substr(w, 2, 6) || 'z' || substr(w, 8) ELSE substr(w, 1, 7) || 'zyx' || substr(w, 8) END AS n FROM asked)
SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM past WHERE levenshtein(n, p) <= 2) THEN 2 ELSE 0 END AS bonus FROM edited""",
)
def repeat_organisations_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under names with none to three edits against past organisations of 14 to 17 letters."""
    word = F.substring(F.md5(F.col("s_suppkey").cast("string")), F.lit(1), (14 + F.col("s_suppkey") % 4).cast("int"))
    rest = lambda at: F.substring("w", at, 40)
    ways = [F.col("w"), F.concat(F.lit("z"), "w"), F.concat(F.lit("yz"), rest(3)), F.concat(F.substring("w", 2, 6), F.lit("z"), rest(8))]
    edited = F.concat(F.substring("w", 1, 7), F.lit("zyx"), rest(8))
    for k, way in enumerate(ways):
        edited = F.when(F.col("s_suppkey") % 5 == k, way).otherwise(edited)
    named = views.table(spark, sf_dir, "supplier").select("s_suppkey", word.alias("w"))
    past = named.where("s_suppkey % 2 = 0").select(F.col("w").alias("org_name"))
    return metrics.repeat_organisations(named.select("s_suppkey", edited.alias("org_name")), past).select("s_suppkey", "bonus")

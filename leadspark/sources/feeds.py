"""Feeds, award notices, flight boards, weather alerts, notices to airmen and pushed leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark import schemas
from leadspark.functions.columns import award_key, blank_to_null, feed_date, item_key, leading_dollars, or_blank, row_id, weather_type

FEED = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string,guid:string>>>"


def feed_items(feeds: DataFrame, text: str = "value", source: str = "news", default_date: Column | None = None) -> DataFrame:
    """One row per feed item; the id is the guid, else the link."""
    items = feeds.select(F.explode(F.from_xml(F.col(text), FEED)["channel"]["item"]).alias("i"))
    ident = F.coalesce(blank_to_null("i.guid"), F.col("i.link"))
    day = feed_date("i.pubDate", default_date if default_date is not None else F.lit(None).cast("timestamp"))
    return items.select(F.lit(source).alias("source"), ident.alias("external_id"), or_blank("i.title").alias("title"), or_blank("i.description").alias("description"), F.col("i.link").alias("source_url"), day.cast("date").alias("issued_at"), item_key(source, ident).alias("hash"))


def award_notices(raw: DataFrame, text: str = "value", source: str = "awards", collected_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rows that are neither JSON nor HTML). JSON arrays or single objects; an HTML page is one record."""
    collected_at = collected_at if collected_at is not None else F.lit(None).cast("timestamp")
    rows = raw.withColumn("_t", F.ltrim(or_blank(text))).withColumn("_v", F.try_parse_json("_t"))
    is_page = F.col("_t").startswith("<")
    listed = F.when(F.col("_t").startswith("["), F.try_variant_get("_v", "$", "array<variant>")).otherwise(F.array("_v"))
    each = rows.where(~is_page & F.col("_v").isNotNull()).select(F.explode(listed).alias("a"))
    field = lambda k: F.when(F.schema_of_variant(F.try_variant_get("a", f"$.{k}", "variant")) == "STRING", F.try_variant_get("a", f"$.{k}", "string"))
    number = F.schema_of_variant(F.try_variant_get("a", "$.value", "variant"))
    value = F.when(number == "STRING", leading_dollars(field("value"))).otherwise(F.coalesce(F.try_variant_get("a", "$.value", "double").cast("bigint"), F.lit(0).cast("bigint")))
    ident, title = F.coalesce(blank_to_null(field("opportunity_id")), field("id")), F.coalesce(blank_to_null(field("title")), or_blank(field("description")))
    records = each.select(
        F.lit(source).alias("source"), ident.alias("external_id"), title.alias("title"), or_blank(field("location")).alias("location"), value.alias("value"),
        or_blank(field("description")).alias("description"), feed_date(field("award_date"), collected_at).cast("date").alias("issued_at"), or_blank(field("url")).alias("source_url"),
    ).where("external_id <> ''")
    records = records.withColumn("hash", award_key(source, "external_id", "title", "source_url"))
    pages = rows.where(is_page).select(
        F.lit(source).alias("source"), F.concat(F.lit("html-"), F.substring(F.sha2(text, 256), 1, 16)).alias("external_id"), F.lit("Award notice (HTML)").alias("title"), F.lit("").alias("location"), F.lit(0).cast("bigint").alias("value"),
        F.lit("Raw HTML award notice.").alias("description"), collected_at.cast("date").alias("issued_at"), F.lit("").alias("source_url"), award_key(source, text).alias("hash"),
    )
    return records.unionByName(pages), rows.where(~is_page & F.col("_v").isNull()).drop("_t", "_v")


def flight_board(rows: DataFrame, by: tuple[str, ...] = ("airport", "as_of"), text: str = "row_text") -> DataFrame:
    """Polls from board rows: total, cancelled, rate (0 of none) and whether a ground stop is named."""
    low = F.lower(or_blank(text))
    total, cancelled = F.count(F.lit(1)), F.count_if(F.contains(low, F.lit("cancelled")))
    return rows.groupBy(*by).agg(total.alias("total"), cancelled.alias("cancelled"), F.when(total > 0, cancelled / total).otherwise(F.lit(0.0)).alias("rate"), F.bool_or(F.contains(low, F.lit("ground stop"))).alias("ground_stop"))


def ground_stops(notices: DataFrame, by: tuple[str, ...] = ("airport", "as_of"), text: str = "value") -> DataFrame:
    return notices.groupBy(*by).agg(F.bool_or(F.upper(or_blank(text)).rlike("GND STOP|GROUND STOP")).alias("ground_stop"))


def weather_alerts(raw: DataFrame, text: str = "value") -> DataFrame:
    """Flat alerts of GeoJSON documents, in order (pos), with their type."""
    schema = "features array<struct<properties:struct<event:string,headline:string,severity:string,zone:string>>>"
    keep = [c for c in raw.columns if c != text]
    rows = raw.select(*keep, F.posexplode(F.from_json(F.col(text), schema)["features"]).alias("pos", "f"))
    return rows.select(*keep, "pos", "f.properties.zone", "f.properties.event", "f.properties.headline", "f.properties.severity", weather_type("f.properties.event", "f.properties.headline").alias("type"))


def pushed_leads(rows: DataFrame, default_source: str = "webhook") -> DataFrame:
    """Defaults of leads that arrive as JSON: source, id, status."""
    return rows.withColumns({"source": F.coalesce(blank_to_null("source"), F.lit(default_source)), "status": F.coalesce(blank_to_null("status"), F.lit("new")), "id": F.coalesce(blank_to_null("id"), row_id("source", "title", "location"))})


def hotels(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The hotel dimension, a few rows of configuration."""
    return spark.createDataFrame(rows, schemas.HOTEL)


def hotel_airports(dimension: DataFrame) -> DataFrame:
    return dimension.select(F.col("id").alias("hotel_id"), "alert_threshold_sps", F.explode("airports").alias("a")).select("hotel_id", "alert_threshold_sps", F.col("a.code").alias("airport"), F.col("a.distance_min").alias("distance_min"))


def split_valid(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): a bad record never stops the others."""
    ok = F.coalesce(valid, F.lit(False))
    return rows.where(ok), rows.where(~ok)

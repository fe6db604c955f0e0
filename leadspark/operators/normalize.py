"""Source records to the one project shape, and the relevance rules of each source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark import rules, schemas
from leadspark.functions.columns import award_key, blank_to_null, city, contains_any, dashed, item_key, or_blank, permit_key, production_key, production_name, schedule_start, slug, title_case
from leadspark.sources.pages import relevant

COLUMNS = [tuple(c.split(" ", 1)) for c in schemas.PROJECT.split(", ")]


def _project(rows: DataFrame, **given: Column) -> DataFrame:
    return rows.select(*[(given[n] if n in given else F.lit(None)).cast(t).alias(n) for n, t in COLUMNS])


def _titled(kind: str, place: str) -> Column:
    return F.when(or_blank(place) != "", F.concat(or_blank(kind), F.lit(" — "), F.col(place))).otherwise(or_blank(kind))


def flow_permit_projects(records: DataFrame, source: str = "flow_permits") -> DataFrame:
    text = F.concat(F.lit("Work: "), or_blank("work_proposed"), F.lit(" | Status: "), or_blank("status"), F.lit(" | Applicant: "), or_blank("applicant"), F.lit(" | Contractor: "), or_blank("contractor"))
    return _project(
        records, source=F.lit(source), external_id=F.col("folder_number"), title=F.concat(or_blank("sub_type"), F.lit(" — "), or_blank("address")), location=F.col("address"), value=F.col("value"), description=text,
        issued_at=F.col("issue_date"), raw_type=F.lit("application/pdf"), metadata=F.create_map(F.lit("applicant"), or_blank("applicant"), F.lit("contractor"), or_blank("contractor")), hash=permit_key(source, "folder_number", "address", "issue_date"),
    )


def column_permit_projects(records: DataFrame, source: str = "column_permits", town: str = "Delta") -> DataFrame:
    place = F.coalesce(blank_to_null("civic_address"), F.lit(f"{town}, BC"))
    return _project(
        records, source=F.lit(source), external_id=F.col("permit_number"), title=_titled("type_raw", "civic_address"), location=F.concat(place, F.lit(f", {town} BC")), value=F.col("value"),
        description=F.concat(F.lit("Work: "), or_blank("purpose"), F.lit(" | Builder: "), or_blank("builder")), issued_at=F.col("issue_date"), raw_type=F.lit("application/pdf"), hash=permit_key(source, "permit_number", "civic_address", "issue_date"),
    )


def production_projects(records: DataFrame, source: str = "productions") -> DataFrame:
    """Labelled-list records (group, title, fields) of kept production types."""
    field = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    rows = records.select(production_name("group").alias("kind"), title_case("title").alias("title"), *[field(k).alias(k) for k in ("studio", "schedule", "address", "manager")])
    rows = rows.where(F.lower(F.trim("kind")).isin(*rules.PRODUCTION_TYPES))
    extra = lambda label, c: F.when(F.col(c) != "", F.concat(F.lit(f" | {label}: "), F.col(c))).otherwise("")
    text = F.concat(F.col("kind"), F.lit(" — "), F.col("studio"), extra("Schedule", "schedule"), extra("Address", "address"))
    meta = F.create_map(*[x for k in ("schedule", "address", "manager") for x in (F.lit(k), F.col(k))])
    return _project(
        rows, source=F.lit(source), external_id=slug("title"), title=F.col("title"), location=city("address"), value=F.lit(0), description=text, issued_at=schedule_start("schedule"),
        raw_type=F.lit("text/html"), metadata=meta, hash=production_key(source, "title", "kind"),
    )


def venue_projects(cards: DataFrame, source: str = "venue") -> DataFrame:
    """Venue cards have no key of their own, so they take the generic one."""
    ident = dashed(F.concat_ws(" ", "title", or_blank("date")))
    text = F.concat(F.lit("Category: "), or_blank("category"), F.lit(" | Date: "), or_blank("date"))
    return _project(cards, source=F.lit(source), external_id=ident, title=F.col("title"), description=text, source_url=F.col("link"), raw_type=F.lit("text/html"), hash=award_key(source, ident, "title", F.lit("0001-01-01")))


def event_projects(cards: DataFrame, collected_at: Column, source: str = "events", detail: str = "date", whole_words: bool = False) -> DataFrame:
    rows = cards.where(relevant(F.col("title"), F.col(detail), rules.EVENT_POSITIVE, rules.EVENT_NEGATIVE, whole_words))
    return _project(rows, source=F.lit(source), external_id=F.col("link"), title=F.col("title"), description=F.col(detail), source_url=F.col("link"), issued_at=collected_at, raw_type=F.lit("text/html"), hash=item_key(source, "link"))


def heading_projects(headings: DataFrame, url: str, collected_at: Column, source: str = "announcements") -> DataFrame:
    return _project(headings, source=F.lit(source), external_id=F.col("external_id"), title=F.col("title"), description=F.col("description"), source_url=F.lit(url), issued_at=collected_at, raw_type=F.lit("text/html"), hash=item_key(source, "external_id"))


def news_projects(items: DataFrame, whole_words: bool = False) -> DataFrame:
    """Feed items (already keyed) that construction words name and no others."""
    rows = items.where(relevant(F.col("title"), F.col("description"), rules.NEWS_POSITIVE, rules.NEWS_NEGATIVE, whole_words))
    return _project(rows, raw_type=F.lit("application/rss+xml"), **{c: F.col(c) for c in ("source", "external_id", "title", "description", "source_url", "issued_at", "hash")})


def award_projects(records: DataFrame) -> DataFrame:
    return _project(records, raw_type=F.lit("application/json"), **{c: F.col(c) for c in ("source", "external_id", "title", "location", "value", "description", "issued_at", "source_url", "hash")})


def drop_then_keep(rows: DataFrame, drop: Sequence[str] = tuple(rules.VENUE_DROP), columns: Sequence[str] = ("title", "category")) -> DataFrame:
    """Rows with a word of the drop list leave; all others stay, listed or not."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | contains_any(c, drop)
    return rows.where(~bad)


def latest_link(links: DataFrame, page: str = "page_id") -> DataFrame:
    """First link of every page: reports are listed newest first."""
    return links.groupBy(page).agg(F.min_by("link", "pos").alias("link"))


def with_weather_tuning(rows: DataFrame, column: str = "type") -> DataFrame:
    """Add the tuning parameters of a weather alert type, the defaults for types without any."""
    out = rows
    for name in rules.WEATHER_DEFAULT:
        value = F.lit(rules.WEATHER_DEFAULT[name])
        for kind, params in rules.WEATHER_TUNING.items():
            value = F.when(F.col(column) == kind, F.lit(params[name])).otherwise(value)
        out = out.withColumn(name, value)
    return out

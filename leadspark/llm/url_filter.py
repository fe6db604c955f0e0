"""URL filtering against lists that change over time.

Dated list entries (pattern, day, action) become validity intervals: an entry is active from
its day until the next entry of the same pattern. An as-of join evaluates every capture against the entries of its
host and of each parent domain: entries and fetch days of a pattern are ordered together by day, and the last
entry before a fetch day is the active one. The most specific active entry decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days over which the query's captures and list entries are spread.
DAYS, START = 400, "2023-01-01"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, valid_from, valid_to (null: still active) of entries (pattern, listed_on, action).

    Of two entries of a pattern on one day the action that sorts last holds; entries without a
    pattern or day are ignored. Entries of a pattern are ordered by themselves, captures never are.
    """
    dated = entries.where("pattern is not null and listed_on is not null").groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    return dated.select("pattern", "action", F.col("listed_on").alias("valid_from"), F.lead("listed_on").over(Window.partitionBy("pattern").orderBy("listed_on")).alias("valid_to"))


def hosts(url):
    """Lower-cased host of a URL, without user, port and trailing dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def active_entries(asked: DataFrame, entries: DataFrame, parts: int = 64) -> DataFrame:
    """As-of join: host, fetched_on, pattern, action of every entry that is active for ``asked`` (host, fetched_on).

    The days of a suffix are dealt to parts, each of which gets the pattern's entries, so a suffix of many hosts, listed or
    not, is not one task's work; the entries are few, the fetch days are not. One shuffle carries both; a suffix that the
    list does not hold meets no entry and goes.
    """
    days = validity_intervals(entries).select("pattern", F.col("valid_from").alias("day"), "action")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wanted = asked.withColumn("pattern", F.explode(suffixes))
    wanted = wanted.withColumn("_part", F.pmod(F.xxhash64("host", "fetched_on"), F.lit(parts)).cast("int"))
    copies = days.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    events = wanted.select("pattern", "_part", F.col("fetched_on").alias("day"), "host", F.lit(None).cast("struct<action:string>").alias("entry")).unionByName(
        copies.select("pattern", "_part", "day", F.lit(None).cast("string").alias("host"), F.struct("action").alias("entry"))
    )
    # On one day the entry comes before the captures.
    order = Window.partitionBy("pattern", "_part").orderBy("day", F.col("host").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("entry", ignorenulls=True).over(order)
    return events.withColumn("entry", last).where("host is not null and entry is not null").select("host", F.col("day").alias("fetched_on"), "pattern", "entry.action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, pattern, action, kept of captures (page_id, url, fetched_on).

    Unlisted captures, those without a host or day, and those whose entry allows them are kept.
    Repeated rows stay; other columns are left out, so a clash of names does no harm. An entry whose
    action is null, or any other than ``block``, lets its captures pass.
    """
    rows = captures.select("page_id", hosts(F.col("url")).alias("host"), "fetched_on")
    asked = rows.select("host", "fetched_on").where("host is not null and fetched_on is not null").distinct()
    chosen = active_entries(asked, entries).groupBy("host", "fetched_on").agg(F.max_by(F.struct("pattern", "action"), F.length("pattern")).alias("e"))
    out = rows.join(chosen, ["host", "fetched_on"], "left")
    return out.select("page_id", "host", "fetched_on", F.col("e.pattern").alias("pattern"), F.col("e.action").alias("action"), (F.coalesce(F.col("e.action"), F.lit("allow")) != "block").alias("kept"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """The query's captures: a page's fetch day follows from its id."""
    return pages.select("page_id", "url", F.date_add(F.lit(START).cast("date"), F.pmod(F.col("page_id") * 7, F.lit(DAYS)).cast("int")).alias("fetched_on"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """The query's list: dated entries for hosts and their parent domains, derived from the pages."""
    host = pages.select(hosts(F.col("url")).alias("host")).where("host is not null").distinct()
    pattern = host.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""))).alias("pattern")).distinct()
    number = lambda a: F.conv(F.substring(F.md5("pattern"), a, 4), 16, 10).cast("long")
    listed = pattern.select("pattern", number(1).alias("a"), number(5).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    listed = listed.where("k <= a % 5 - 1")
    day = F.date_add(F.lit(START).cast("date"), F.pmod(F.col("b") + F.col("k") * (37 + F.col("a") % 60), F.lit(DAYS)).cast("int"))
    return listed.select("pattern", day.alias("listed_on"), F.when((F.col("a") + F.col("k")) % 2 == 0, "block").otherwise("allow").alias("action"))


SQL = f"""
WITH captures AS (
  SELECT page_id, DATE '{START}' + CAST((page_id * 7) % {DAYS} AS INTEGER) AS fetched_on,
         nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.+$', ''), '') AS host
  FROM pages),
patterns AS (
  SELECT DISTINCT pattern FROM (
    SELECT host AS pattern FROM captures WHERE host IS NOT NULL
    UNION ALL SELECT regexp_replace(host, '^[^.]*\\.', '') FROM captures WHERE host IS NOT NULL)),
listed AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 4) AS BIGINT) AS a, CAST('0x' || substr(md5(pattern), 5, 4) AS BIGINT) AS b, k
  FROM patterns, (SELECT unnest([0, 1, 2, 3]) AS k)),
entries AS (
  SELECT pattern, DATE '{START}' + CAST((b + k * (37 + a % 60)) % {DAYS} AS INTEGER) AS listed_on,
         max(CASE WHEN (a + k) % 2 = 0 THEN 'block' ELSE 'allow' END) AS action
  FROM listed WHERE k <= a % 5 - 1 GROUP BY ALL),
intervals AS (
  SELECT pattern, action, listed_on AS valid_from, lead(listed_on) OVER (PARTITION BY pattern ORDER BY listed_on) AS valid_to FROM entries),
active AS (
  SELECT c.page_id, i.pattern, i.action, row_number() OVER (PARTITION BY c.page_id ORDER BY length(i.pattern) DESC) AS r
  FROM captures c JOIN intervals i ON (c.host = i.pattern OR ends_with(c.host, '.' || i.pattern))
   AND i.valid_from <= c.fetched_on AND (i.valid_to IS NULL OR c.fetched_on < i.valid_to))
SELECT c.page_id, c.host, c.fetched_on, a.pattern, a.action, coalesce(a.action, 'allow') <> 'block' AS kept
FROM captures c LEFT JOIN active a ON c.page_id = a.page_id AND a.r = 1
"""

from datetime import date, datetime

from pyspark.sql import functions as F

from leadspark import schemas
from leadspark.operators import leads, normalize
from leadspark.sources import feeds
from leadspark.sources.registry import Sources

COLUMNS = [c.split()[0] for c in schemas.PROJECT.split(", ")]


def test_permits(spark):
    rows = spark.createDataFrame([("25 1", "Hotel", "1 A St", "New", "Issued", date(2026, 3, 16), 700000, "Ann", "")], "folder_number string, sub_type string, address string, work_proposed string, status string, issue_date date, value bigint, applicant string, contractor string")
    got = normalize.flow_permit_projects(rows).first()
    assert got.__fields__ == COLUMNS and got["title"] == "Hotel — 1 A St" and got["metadata"] == {"applicant": "Ann", "contractor": ""}
    assert got["description"] == "Work: New | Status: Issued | Applicant: Ann | Contractor: "
    rows = spark.createDataFrame([("BP1", "INDUSTRIAL", "", "", "B", None, 1)], "permit_number string, type_raw string, civic_address string, purpose string, builder string, issue_date date, value bigint")
    got = normalize.column_permit_projects(rows).first()
    assert (got["title"], got["location"]) == ("INDUSTRIAL", "Delta, BC, Delta BC")


def test_cards_and_headings(spark):
    cards = spark.createDataFrame([("World Congress", "May 1", "expo", "http://x/1"), ("Home Show", "", "", "http://x/2"), ("Business Party", "", "", "http://x/3")], "title string, date string, category string, link string")
    kept = normalize.drop_then_keep(cards)
    venue = normalize.venue_projects(kept).orderBy("title").collect()
    assert [r["title"] for r in venue] == ["Business Party", "World Congress"] and len({r["hash"] for r in venue}) == 2 and venue[1]["external_id"] == "world-congress-may-1"
    at = F.lit("2024-01-01").cast("timestamp")
    more = spark.createDataFrame([("Tech Summit", "downtown", "", "http://x/4"), ("Travel business", "", "", "http://x/5")], "title string, date string, category string, link string")
    assert [r["title"] for r in normalize.event_projects(cards.union(more), at).collect()] == ["Tech Summit"]
    assert sorted(r["title"] for r in normalize.event_projects(more, at, whole_words=True).collect()) == ["Tech Summit", "Travel business"]
    heads = spark.createDataFrame([("air:Pier", "Pier", "text")], "external_id string, title string, description string")
    assert normalize.heading_projects(heads, "http://a", at).first()["issued_at"] == date(2024, 1, 1)
    links = spark.createDataFrame([(1, 5, "old"), (1, 2, "new")], "page_id int, pos int, link string")
    assert normalize.latest_link(links).first()["link"] == "new"


def test_news_and_union(spark):
    items = spark.createDataFrame([("news", "1", "New warehouse", "", "u", date(2024, 1, 1), "h1"), ("news", "2", "Building wins match", "", "u", None, "h2"), ("news", "3", "Weather", None, "u", None, "h3")], "source string, external_id string, title string, description string, source_url string, issued_at date, hash string")
    assert [r["external_id"] for r in normalize.news_projects(items).collect()] == ["1"]
    both = Sources(spark).add("a", normalize.news_projects(items)).add("b", items)
    assert both.union({"b": False}).count() == 1 and both.union().count() == 4 and both.union().columns == COLUMNS
    assert Sources(spark).union().count() == 0 and both.names == ["a", "b"]
    good, bad = feeds.split_valid(items, F.col("issued_at").isNotNull())
    assert (good.count(), bad.count()) == (1, 2)


def test_lead_assembly(spark):
    project = spark.createDataFrame([{"source": "s", "title": "", "location": "L", "value": 5, "hash": "h", "metadata": {"applicant": "Ann"}}], schemas.PROJECT)
    signal = spark.createDataFrame([("h", "Acme", "X", "hotel")], "hash string, org_name string, location string, project_type string")
    full = leads.augment(project, signal)
    assert (full.first()["title"], full.first()["location"], full.first()["metadata"]) == ("Acme", "L", {"applicant": "Ann", "org_name": "Acme", "project_type": "hotel"})
    answer = spark.createDataFrame([{"hash": "h", "priority_score": 8}], "hash string, " + schemas.ENRICHMENT)
    got = leads.assemble(full.withColumn("raw_input_id", F.lit("")), answer, F.lit("2024-01-02 03:04:05").cast("timestamp"))
    row = got.first()
    assert got.columns == [c.split()[0] for c in schemas.LEAD.split(", ")]
    assert (row["status"], row["raw_input_id"], row["priority_score"], row["applicant"], row["contractor"], row["estimated_crew_size"]) == ("new", None, 8, "Ann", "", 0)
    assert row["created_at"] == datetime(2024, 1, 2, 3, 4, 5) and got.first()["id"] == row["id"]
    assert leads.context_text(got, spark.createDataFrame([("r", "pdf")], "id string, payload_type string")).first()["context"].startswith("Title: Acme | Location: L")

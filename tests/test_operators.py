import random
import tracemalloc
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadspark import rules, schemas
from leadspark.operators import dedup, disruption, leads, metrics, model_steps, prescore, vectors
from leadspark.operators.store import TableStore
from leadspark.sources import feeds, pages, reports
from leadspark.streaming.alerts import _step


def test_prescore(spark):
    rows = [("", "Richmond, V6V 1A1", 100_000), ("", "", 12_000_000), ("Pipeline upgrade project", "", 0), ("Single family home renovation", "", 0), ("Civil infrastructure upgrade", "Richmond V7C 1X1", 15_000_000), (None, None, None)]
    got = prescore.with_prescore(spark.createDataFrame(rows, "title string, location string, value bigint")).collect()
    assert [r["prescore"] for r in got] == [2, 2, 1, -5, 6, 0]
    assert got[4]["prescore_reason"] == "Richmond/YVR location, Value > $10M, Keyword: civil, Keyword: infrastructure"
    enough, skipped = prescore.split_by_score(prescore.with_prescore(spark.createDataFrame(rows, "title string, location string, value bigint")), 1)
    assert (enough.count(), skipped.count()) == (4, 2)


def test_flow_report(spark):
    text = """City of Nowhere
SUB TYPE: Hotel
FOLDER NUMBER
25 036523 000 00
B7
Alteration
Issued
2026/03/16
$300,000.00
FOLDER NAME
8640 Alexandra Road
1
SUB TYPE: Warehouse
ISSUE DATE 2026/03/18
24 008734 000 01 B7
New
Issued
FOLDER NAME 12500 Vulcan Way
$0.00
$1,200,000.00
$5.00
SUB TYPE: One Family Dwelling
25 011111 000 00 B7
New
Issued
9800 Maple Street
2026/03/18
2026/03/19 2
$850,000.00
APPLICANT
First Builder
CONTRACTOR First Contractor
APPLICANT Second Builder
CONTRACTOR
Second Contractor
APPLICANT Third Builder"""
    docs = spark.createDataFrame([("d", text), ("e", None)], "doc_id string, value string")
    got = reports.flow_records(reports.document_lines(docs)).orderBy("rec").collect()
    rows = [(r["sub_type"], r["folder_number"], r["work_proposed"], r["status"], r["address"], r["issue_date"], r["value"], r["applicant"], r["contractor"]) for r in got]
    assert rows == [
        ("Hotel", "25 036523 000 00 B7", "Alteration", "Issued", "8640 Alexandra Road", date(2026, 3, 16), 300000, "First Builder", "First Contractor"),
        ("Warehouse", "24 008734 000 01 B7", "New", "Issued", "12500 Vulcan Way", None, 1200000, "Second Builder", "Second Contractor"),
        ("One Family Dwelling", "25 011111 000 00 B7", "New", "Issued", "9800 Maple Street", date(2026, 3, 19), 850000, "Third Builder", ""),
    ]
    kept = prescore.relevant_permits(spark.createDataFrame(got), rules.COMMERCIAL_SUB_TYPES).collect()
    assert [r["sub_type"] for r in kept] == ["Warehouse"]


def test_column_report(spark):
    text = """Mar 3, 2026    BP022784 ACME BUILDERS LTD    1,200.00   515,000.00
  Type INDUSTRIAL - TILBURY
  Purpose Interior Tenant Improvement
  Civic Address:
  Civic Address: 6705 DENNETT PL
not indented
Mar 10, 2026  BP022801 OTHER   0.00 1,200,000.00
  Type COMMERCIAL - LADNER
  Civic Address: 1 OLD ST
  Civic Address: 4500 CLARENCE TAYLOR CRES"""
    docs = spark.createDataFrame([("d", text)], "doc_id string, value string")
    got = reports.column_records(reports.document_lines(docs, trim=False)).orderBy("rec").collect()
    assert [(r["permit_number"], r["builder"], r["issue_date"], r["value"], r["type_raw"], r["type_prefix"], r["purpose"], r["civic_address"]) for r in got] == [
        ("BP022784", "ACME BUILDERS LTD", date(2026, 3, 3), 515000, "INDUSTRIAL - TILBURY", "industrial", "Interior Tenant Improvement", "6705 DENNETT PL"),
        ("BP022801", "OTHER", date(2026, 3, 10), 1200000, "COMMERCIAL - LADNER", "commercial", "", "4500 CLARENCE TAYLOR CRES"),
    ]


def test_pages(spark):
    html = """<script>var x="<h3>no</h3>";</script><div id="list"><h5>Feature</h5><h3 class="production">FARADAY</h3><p><b>Schedule:</b> 3/9/2026 - 4/10/2026</p>
    <p><b>Address:</b> 1 A St, Burnaby</p><h5>TV Series</h5><h3>OTHER &amp; SON</h3><p><b>Studio</b>: Big</p></div>"""
    docs = spark.createDataFrame([(1, html), (2, "<p>nothing</p>"), (3, None)], "page_id long, html string")
    records, missing = pages.labelled_list(docs, "h5", "h3", container='id="list"')
    got = records.orderBy("rec").collect()
    assert [(r["group"], r["title"], r["fields"]) for r in got] == [("Feature", "FARADAY", {"schedule": "3/9/2026 - 4/10/2026", "address": "1 A St, Burnaby"}), ("TV Series", "OTHER & SON", {"studio": "Big"})]
    assert sorted(r[0] for r in missing.collect()) == [2, 3]
    cards = '<a href="/e/1"><h3>World Congress 2026</h3><span class="event-date">May 1</span></a><a href="http://x/2"><h3>Home Show Deluxe</h3></a><a href="/about"><h3>About us here</h3></a><a href="http://x/4"><h3>Tech Summit</h3></a>'
    found = pages.venue_cards(spark.createDataFrame([(1, cards)], "page_id long, html string"), "https://v").orderBy("pos").collect()
    assert [(r["title"], r["date"], r["link"]) for r in found] == [("World Congress 2026", "May 1", "https://v/e/1"), ("Tech Summit", "", "http://x/4")]
    news = pages.headings(spark.createDataFrame([(1, "<h3>Major Projects</h3><h3>Pier D</h3><p>A new pier</p><h3>Last</h3>")], "page_id long, html string"), "h3", "air", skip=["Major Projects"]).orderBy("pos").collect()
    assert [(r["external_id"], r["description"]) for r in news] == [("air:Pier D", "A new pier"), ("air:Last", "")]


def test_feeds(spark):
    xml = "<rss><channel><item><title>A</title><link>http://l/1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><guid>g1</guid></item><item><title>B</title><link>http://l/2</link></item></channel></rss>"
    got = feeds.feed_items(spark.createDataFrame([(xml,)], "value string")).collect()
    assert [(r["external_id"], r["title"], r["issued_at"]) for r in got] == [("g1", "A", date(2024, 3, 5)), ("http://l/2", "B", None)]
    raw = [('[{"opportunity_id":"OR-1","title":"X","value":"$1,500,000","award_date":"2024-01-02"},{"id":"OR-2","description":"Y","value":500000.9},{"title":"no id"}]',), ('{"id":"OR-3","title":"Z","value":null}',), ("<html>award</html>",), ("junk",)]
    good, bad = feeds.award_notices(spark.createDataFrame(raw, "value string"))
    rows = {r["external_id"][:5]: (r["title"], r["value"]) for r in good.collect()}
    assert rows == {"OR-1": ("X", 1500000), "OR-2": ("Y", 500000), "OR-3": ("Z", 0), "html-": ("Award notice (HTML)", 0)}
    assert bad.count() == 1
    geo = '{"features":[{"properties":{"event":"Rainfall","headline":"Atmospheric river","severity":"x","zone":"z1"}},{"properties":{"event":"Fog advisory","zone":"z2"}}]}'
    assert [r["type"] for r in feeds.weather_alerts(spark.createDataFrame([(geo,)], "value string")).orderBy("pos").collect()] == ["AtmosphericRiver", "Fog"]
    board = [("Y", 1, f"AC{i} {'CANCELLED' if i < 3 else 'on time'}") for i in range(10)]
    assert [tuple(r) for r in feeds.flight_board(spark.createDataFrame(board, "airport string, as_of int, row_text string")).collect()] == [("Y", 1, 10, 3, 0.3, False)]
    notes = spark.createDataFrame([("Y", 1, "gnd stop in effect"), ("Z", 1, "all fine"), ("Z", 1, None)], "airport string, as_of int, value string")
    assert dict(map(lambda r: (r[0], r[2]), feeds.ground_stops(notes).collect())) == {"Y": True, "Z": False}


def test_dedup_and_purge(spark, tmp_path):
    store = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, id long")
    batch = spark.createDataFrame([("h2", 10), ("h3", 11), ("h3", 12), ("h1", 13)], "hash string, id long")
    rows, told = dedup.insert_returning(store, batch, F.col("id"))
    assert [tuple(r) for r in rows.collect()] == [("h3", 11)]
    assert sorted((r["id"], r["winning_id"]) for r in told.collect()) == [(10, 2), (11, 11), (12, 11), (13, 1)]
    assert dedup.insert_ignore(store.unionByName(rows), batch, [F.col("id")]).count() == 0
    raw = spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 2, 1))], "id string, created_at timestamp")
    keep, gone = dedup.purge(raw, spark.createDataFrame([("b",), (None,)], "raw_input_id string"), F.lit("2024-01-15").cast("timestamp"))
    assert sorted(r["id"] for r in keep.collect()) == ["b", "c"] and [r["id"] for r in gone.collect()] == ["a"]
    changed, missing = dedup.set_status(spark.createDataFrame([("a", "new")], "id string, status string"), spark.createDataFrame([("a", "x"), ("z", "x")], "id string, status string"))
    assert [tuple(r) for r in changed.collect()] == [("a", "x")] and [r["id"] for r in missing.collect()] == ["z"]
    tables = TableStore(spark, str(tmp_path))
    assert tables.read("t", "hash string, id long").count() == 0
    tables.append("t", store)
    tables.swap("t", dedup.upsert(tables.read("t", "hash string, id long"), batch, "hash", F.col("id")))
    assert sorted(tuple(r) for r in tables.read("t", "hash string, id long").collect()) == [("h1", 13), ("h2", 10), ("h3", 12)]
    fresh, counts = dedup.copy_missing(spark.createDataFrame([("h1", "5"), ("h9", "bad")], "hash string, id string"), store, "hash", {"id": "bigint"})
    assert [tuple(r) for r in fresh.collect()] == [("h9", None)] and counts.count() == 1


def sequential(polls):
    return _step("A", [(int(t.timestamp() * 1e6), s, v) for t, s, v in polls], (None, False, None), rules.DWELL_MINUTES)[0]


def test_window_form_equals_the_state_machine(spark):
    rnd = random.Random(9)
    for _ in range(6):
        polls, at = [], datetime(2024, 1, 1)
        for _ in range(120):
            at += timedelta(minutes=rnd.choice([5, 10, 20, 40]))
            state = rnd.choice(["Ignore", "Watch", "SoftAlert", "HardAlert", "HardAlert", "PreAlert"])
            polls.append((at, state, float(rnd.choice([10, 20, 30]))))
        rows = spark.createDataFrame([("A", *p) for p in polls], "airport string, as_of timestamp, state string, score double")
        got = disruption.alert_episodes(rows).orderBy("as_of").collect()
        utc = lambda d: int(d.timestamp() * 1e6)
        assert [("A", utc(r["as_of"]), utc(r["started_at"]), r["minutes"], r["state"], r["score"], r["action"]) for r in got] == sequential(polls)


def test_as_of_and_hotels(spark):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    polls = spark.createDataFrame([("A", t(5), 0.5), ("A", t(20), 0.1), ("B", t(5), 0.2)], "airport string, as_of timestamp, rate double").withColumn("ground_stop", F.lit(False))
    weather = spark.createDataFrame([("A", t(5), "z2", 0, "Fog"), ("A", t(5), "z1", 1, "Snow"), ("A", t(30), "z1", 0, "Wind")], "airport string, as_of timestamp, zone string, pos int, type string")
    stops = spark.createDataFrame([("A", t(10), True)], "airport string, as_of timestamp, ground_stop boolean")
    hotels = feeds.hotels(spark, [{"id": "h1", "name": "H", "slack_channel": "#a", "airports": [{"code": "A", "distance_min": 5}], "alert_threshold_sps": 10.0, "distressed_rate": 1, "rack_rate": 2, "airline_contacts": []}])
    got = disruption.assemble_polls(polls, weather, stops, feeds.hotel_airports(hotels)).orderBy("as_of").collect()
    assert [(r["hotel_id"], r["weather"], r["ground_stop"]) for r in got] == [("h1", "Snow", False), ("h1", "Snow", True)]


def test_hotels_of_one_airport_are_many_cells(spark):
    """Polls of one busy airport for many hotels come from several tasks, each pair once, with or without the sides' own cells."""
    start = datetime(2024, 1, 1)
    polls = spark.createDataFrame([(a, start + timedelta(hours=i), 0.5) for a, n in (("A", 40), ("B", 3), ("C", 2), (None, 2)) for i in range(n)], "airport string, as_of timestamp, rate double").withColumn("ground_stop", F.lit(False))
    hotels = spark.range(6000).selectExpr("CAST(id AS STRING) AS hotel_id", "0D AS alert_threshold_sps", "explode(if(id % 1000 = 0, array('A', 'B', 'D'), array('A'))) AS airport", "5 AS distance_min")
    weather = spark.createDataFrame([], "airport string, as_of timestamp, zone string, pos int, type string")
    stops = spark.createDataFrame([], "airport string, as_of timestamp, ground_stop boolean")
    out = disruption.assemble_polls(polls, weather, stops, hotels)
    shares = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 40 * 6000 + 3 * 6 and max(shares) < 0.8 * sum(shares)
    few = hotels.where("CAST(hotel_id AS INT) % 100 = 0")
    key = ["airport", "as_of", "hotel_id"]
    want = sorted(map(str, polls.join(few, "airport").select(key).collect()))
    for cell_rows in (1, 7, 10_000):
        assert sorted(map(str, disruption.for_hotels(polls, few, cell_rows=cell_rows).select(key).collect())) == want


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in vectors.nearest(rows, [1.0, 0.0, 0.0], 2).collect()] == [1, 2]
    assert [r["neighbor_id"] for r in vectors.nearest_each(rows, rows.where("vec_id = 1"), 2).orderBy("rank").collect()] == [2, 3]
    data = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    asked = data.where("vec_id % 100 = 0")
    exact = vectors.nearest_each(data, asked, 10)
    assert vectors.recall(vectors.ClusterIndex(data, 10).search(asked, 10, probe=8), exact).first()["recall"] >= 0.9
    assert vectors.recall(vectors.ClusterIndex(data, 4).search(asked, 10, probe=4), exact).first()["recall"] == 1.0


def test_lists_of_few_vectors_at_a_time(spark):
    """Memory of a task follows the scores it makes at once, however many lists there are; queries in blocks find the same."""
    data = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked, index = data.where("vec_id % 20 = 0"), vectors.ClusterIndex(data, lists=6)
    key = lambda found: sorted((r["query_id"], r["neighbor_id"], r["rank"]) for r in found.collect())
    assert key(index.search(asked, 5, probe=6, block=7)) == key(index.search(asked, 5, probe=6)) == key(vectors.nearest_each(data, asked, 5))

    class Rows:
        schema = spark.createDataFrame([], "id long, v array<double>").schema

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

        mapInPandas = mapInArrow  # noqa: N815
        withColumn = drop = lambda self, *_: self  # noqa: N815

    rnd, rows = np.random.default_rng(5), Rows()
    index.centres, x = rnd.standard_normal((2000, 4)), rnd.standard_normal((6000, 4))
    index._listed(rows, "v", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(list(x), pa.list_(pa.float64()))], ["id", "v"])
    tracemalloc.start()
    got = [r for piece in rows.run(iter([batch])) for r in piece.select(["id", "near"]).to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6000 * 2000 * 8 and [r["id"] for r in got] == list(range(6000))
    assert all(r["near"] == np.argsort(((x[r["id"]] - index.centres) ** 2).sum(axis=1))[:3].tolist() for r in got[::100])


def lead(spark, n=3):
    rows = [{"id": str(i), "source": "s", "title": f"T{i} <x>", "location": "L", "project_value": 1234567, "priority_score": 5 + 2 * i, "status": "new", "created_at": datetime(2024, 1, 1 + i), "estimated_crew_size": 3, "estimated_duration_months": 2, "contractor": "C", "applicant": "A"} for i in range(n)]
    return spark.createDataFrame(rows, schemas.LEAD)


def test_payloads(spark):
    import json

    got = leads.digest_message(lead(spark), F.lit("2024-01-05").cast("date")).first()
    message = json.loads(got["payload"])
    assert got["n"] == 3 and len(message["blocks"]) == 2 + 2 * 3 == got["n_blocks"]
    assert "3 new leads" in message["blocks"][0]["text"]["text"] and "🔥" in message["blocks"][2]["text"]["text"] and "$1,234,567 CAD" in message["blocks"][2]["text"]["text"]
    page = leads.digest_page(lead(spark)).first()["html"]
    assert page.count("lead-card") == 3 and page.count("high-priority") == 1 and "&lt;x&gt;" in page
    events = spark.createDataFrame([("YVR", 45, "HardAlert", 150.5, "snow", 5, 20, 0, None)], "airport string, minutes int, state string, score double, cause string, cancelled int, total int, rooms int, copy string")
    block = json.loads(leads.alert_payloads(events).first()["payload"])["blocks"]
    assert len(block) == 5 and "room count not set" in block[3]["fields"][1]["text"] and "150" in block[2]["fields"][1]["text"]


def test_notify_and_find(spark):
    message, marked = leads.notify_new(lead(spark), F.lit("2024-01-05").cast("date"), limit=2)
    assert message.first()["n"] == 2
    assert {r["id"]: r["status"] for r in marked.collect()} == {"0": "new", "1": "notified", "2": "notified"}
    assert {r["id"]: r["title"] for r in leads.find(lead(spark), spark.createDataFrame([("1",), ("9",)], "id string")).collect()} == {"1": "T1 <x>", "9": None}


def test_lineage(spark):
    held = spark.createDataFrame([("1", "r1"), ("2", None), ("3", "gone")], "id string, raw_input_id string")
    raw = spark.createDataFrame([("r1", "h", "pdf", "u")], "id string, hash string, payload_type string, source_url string")
    got = leads.lineage(held, raw, spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")).collect()
    assert {r["id"]: r["lookup_status"] for r in got} == {"1": "ok", "2": "no link", "3": "no payload", "4": "no lead"}


def test_model_steps(spark):
    requests = spark.createDataFrame([("a", "ok"), ("b", "retry"), ("c", "fail")], "id string, request string")

    def call(body):
        if body == "retry":
            raise model_steps.RetryableError
        if body == "fail":
            raise ValueError
        return '{"content":[{"type":"text","text":"```json\\n{\\"priority_score\\": 7}\\n```"}]}'

    answers = model_steps.call_model(requests, call, pause_s=0)
    assert {r["id"]: (r["status"], r["attempts"]) for r in answers.collect()} == {"a": ("ok", 1), "b": ("error", 2), "c": ("error", 1)}
    good, bad = model_steps.parse_answers(answers)
    assert [(r["id"], r["priority_score"], r["notes"]) for r in good.collect()] == [("a", 7, "")] and bad.count() == 2
    wrong = spark.createDataFrame([("x", '{"content":[{"type":"text","text":"{\\"priority_score\\": \\"high\\"}"}]}')], "id string, response string")
    assert model_steps.parse_answers(wrong)[1].count() == 1
    signals = spark.createDataFrame([('```json\n{"org_name":"Acme","crew_size":12.9,"duration_days":"x","start_date":"2024-02-03","location":5}\n```',), ("junk",)], "response string")
    got = model_steps.parse_signals(signals).collect()
    assert (got[0]["org_name"], got[0]["crew_size"], got[0]["duration_days"], got[0]["location"], got[0]["field_hits"]) == ("Acme", 12, None, None, 3)
    assert got[1]["field_hits"] == 0


def test_metrics(spark):
    rows = spark.createDataFrame([("Acme Builders Ltd",), ("ACME Bilders",), ("Other",), (None,)], "org_name string")
    got = metrics.repeat_organisations(rows, spark.createDataFrame([("acme builders",)], "org_name string"))
    assert {r["org_name"]: r["bonus"] for r in got.collect()} == {"Acme Builders Ltd": 2, "ACME Bilders": 2, "Other": 0, None: 0}


def test_repeat_organisations_equal_all_pairs(spark):
    rnd = random.Random(8)
    name = lambda: "".join(rnd.choice("ab1 ") for _ in range(rnd.randrange(1, 18))).strip()
    past = sorted({name() for _ in range(60)} - {""}) + ["xacmebuilders", "fifteen letters"]
    asked = sorted({name() for _ in range(60)} - {""}) + ["acmebuilders", "xzcmebuildors", "fifteen lettersx", "far away from all"]
    rows, known = (spark.createDataFrame([(n,) for n in names], "org_name string") for names in (asked, past))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    plain = lambda n: " ".join(n.split())
    for edits in (0, 1, 2, 3):
        got = {r["org_name"]: r["matched"] for r in metrics.repeat_organisations(rows, known, most_edits=edits).collect()}
        want = {n: min(((d, p) for p in map(plain, past) if (d := distance(plain(n), p)) <= edits), default=(0, None))[1] for n in asked}
        assert got == want


def test_rows_without_key_are_all_kept(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, None), (4, "a"), (5, "a"), (6, "b")], "id long, hash string")
    store = spark.createDataFrame([(9, "b"), (8, None)], "id long, hash string")
    assert sorted(r["id"] for r in dedup.insert_ignore(store, rows, [F.col("id")]).collect()) == [1, 2, 3, 4]
    new, told = dedup.insert_returning(store, rows, F.lit(0))
    assert sorted(r["id"] for r in new.collect()) == [1, 2, 3, 4]
    assert {r["id"]: r["winning_id"] for r in told.collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 9}


def _as_of_plain(left, right):
    """One sorted pass a key: the greatest value of the latest time at or before; None sorts first."""
    rank = lambda t: (t is not None, t or datetime.min)
    out = []
    for key, at, n in left:
        known = [(rank(t), v) for k, t, v in right if k == key and rank(t) <= rank(at)]
        last = max((r for r, _ in known), default=None)
        values = [v for r, v in known if r == last]
        out.append((key, at, n, max(values, key=lambda v: (v is not None, v)) if values else None))
    return out


@pytest.mark.parametrize("cell", [60, 3600, 86_400])
def test_as_of_over_cells_equals_one_pass(spark, cell):
    rnd = random.Random(cell)
    day = datetime(2024, 1, 1)
    at = lambda: None if rnd.random() < 0.05 else day + timedelta(minutes=rnd.randrange(4000))
    left = [(rnd.choice(["A", "A", "A", "B", None]), at(), n) for n in range(300)]
    right = [(rnd.choice(["A", "A", "B", None]), at(), rnd.choice([None, 1, 2, 3])) for _ in range(150)]
    right += right[:40]
    frames = spark.createDataFrame(left, "key string, at timestamp, n int"), spark.createDataFrame(right, "key string, at timestamp, v int")
    got = disruption.as_of(*frames, "key", "at", ["v"], cell)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(_as_of_plain(left, right), key=str)


def test_one_key_is_many_tasks(spark):
    """A hot key is ordered in as many places as it has cells, and none of them holds a large share."""
    rows = spark.range(20_000).select(F.lit("A").alias("key"), F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").alias("v"))
    got = disruption.as_of(rows.select("key", "at"), rows.where("v % 7 = 0"), "key", "at", ["v"], 3600)
    assert got.where("v = floor(unix_timestamp(at) / 60 / 7) * 7").count() == 20_000
    sizes = rows.groupBy(disruption._cell("at", 3600)).count().agg(F.count("*"), F.max("count")).first()
    assert tuple(sizes) == (334, 60)




def _machine(rows):
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted(((int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1)), s, v) for k, t, s, v in rows if k == key))
        out += [(k, datetime(1970, 1, 1) + timedelta(microseconds=a), datetime(1970, 1, 1) + timedelta(microseconds=b), m, s, v, w) for k, a, b, m, s, v, w in _step(key, mine, (None, False, None), 30)[0]]
    return out


@pytest.mark.parametrize("cell", [600, 3600, 7200, 86_400])
@pytest.mark.parametrize("quiet", [1, 8])
def test_episodes_over_cells_equal_the_state_machine(spark, cell, quiet):
    """Whatever the cells, the composed functions give what one pass over each airport gives."""
    rnd = random.Random(cell + quiet)
    states = ["Ignore"] * quiet + ["Watch", "PreAlert", "SoftAlert", "HardAlert"] * 2
    rows = []
    for airport in ("A", "B"):
        at = datetime(2024, 1, 1)
        for _ in range(400):
            at += timedelta(minutes=rnd.choice([5, 10, 15, 25, 200 if rnd.random() < 0.05 else 5]))
            rows.append((airport, at, rnd.choice(states), float(rnd.choice([10, 20]))))
    got = disruption.alert_episodes(spark.createDataFrame(rows, "airport string, as_of timestamp, state string, score double"), cell_seconds=cell)
    want = _machine(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({w[-1] for w in want}) == 3


@pytest.mark.parametrize("cell", [600, 7200, 86_400])
def test_minutes_active_over_cells(spark, cell):
    rnd = random.Random(cell)
    rows, want = [], []
    for airport in ("A", None):
        at, since = datetime(2024, 1, 1), None
        for _ in range(300):
            at += timedelta(minutes=rnd.choice([5, 10, 90]))
            rate = None if rnd.random() < 0.02 else rnd.choice([0.1, 0.3, 0.3, 0.3, 0.5])
            since = (since or at) if rate is not None and rate > 0.2 else None
            rows.append((airport, at, rate))
            want.append((airport, at, rate, int((at - since).total_seconds() // 60) if since else 0))
    got = disruption.with_minutes_active(spark.createDataFrame(rows, "airport string, as_of timestamp, rate double"), 0.2, cell_seconds=cell)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_lines_that_changed_and_wins_in_a_window(spark):
    pages_of = spark.createDataFrame([("p", 1, "a\nb\nb"), ("p", 2, "a\nb\nb"), ("p", 3, "b\nc\na\nd"), ("p", 4, None), ("q", 1, "z")], "page string, n int, text string")
    got = metrics.line_changes(pages_of, "page", "n", "text").orderBy("n").collect()
    assert [tuple(r) for r in got] == [("p", 3, 2, ["c", "d"], []), ("p", 4, 3, [""], ["b", "c", "a", "d"])]
    day = datetime(2024, 1, 1)
    arrived = spark.createDataFrame([(1, "s", day), (2, "s", day), (3, "t", day), (4, "t", None)], "id int, source string, created_at timestamp")
    wins = spark.createDataFrame([(1, day + timedelta(days=3)), (1, day + timedelta(days=1)), (2, day - timedelta(days=1)), (2, day + timedelta(days=7)), (3, day), (4, day), (9, day)], "lead_id int, at timestamp")
    got = metrics.attributed(arrived, wins, 7).orderBy("source").collect()
    assert [tuple(r) for r in got] == [("s", 2, 1, 1.0, 0.5), ("t", 2, 1, 0.0, 0.5)]

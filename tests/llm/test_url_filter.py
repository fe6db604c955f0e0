import random
from datetime import date, timedelta

from leadspark.llm.url_filter import filter_captures, hosts


def test_entries_hold_from_their_day_until_the_next(spark):
    day = lambda m: date(2024, m, 1)
    captures = spark.createDataFrame(
        [(1, "https://Bad.example.com/x", day(1)), (2, "http://bad.example.com", day(3)), (3, "http://bad.example.com", day(6)), (4, "http://good.bad.example.com:80/", day(4)), (5, None, day(4)), (6, "nonsense", day(4)), (7, "http://example.org/", None), (2, "http://bad.example.com", day(3)), (8, "http://notbad.example.com", day(4))],
        "page_id long, url string, fetched_on date",
    )
    entries = spark.createDataFrame([("bad.example.com", day(2), "block"), ("bad.example.com", day(5), "allow"), ("good.bad.example.com", day(1), "allow"), ("example.com", day(12), "block"), (None, day(1), "block"), ("example.org", None, "block")], "pattern string, listed_on date, action string")
    got = sorted((r["page_id"], r["pattern"], r["kept"]) for r in filter_captures(captures, entries).fillna("-").collect())
    assert got == [(1, "-", True), (2, "bad.example.com", False), (2, "bad.example.com", False), (3, "bad.example.com", True), (4, "good.bad.example.com", True), (5, "-", True), (6, "-", True), (7, "-", True), (8, "-", True)]
    clash = captures.selectExpr("*", "'h' AS host", "'p' AS pattern", "1 AS _part", "'x' AS action")
    assert sorted((r["page_id"], r["pattern"], r["kept"]) for r in filter_captures(clash, entries).fillna("-").collect()) == got
    assert filter_captures(captures.limit(0), entries).collect() == []
    assert all(r["kept"] for r in filter_captures(captures, entries.limit(0)).collect())


def test_hosts(spark):
    urls = ["HTTPS://u:p@A.b.Example.com.:8080/p?q#r", "ftp://x/", "//x/", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(hosts(df["url"])).collect()] == ["a.b.example.com", "x", None, None, None]


def test_random_lists_against_a_plain_walk(spark):
    """Every capture against every entry: the longest listed suffix with an active entry decides, null actions allow."""
    rnd = random.Random(6)
    names = ["a.com", "b.a.com", "c.b.a.com", "d.com", "com"]
    day = lambda n: date(2024, 1, 1) + timedelta(days=n)
    entries = [(rnd.choice(names), day(rnd.randrange(30)), rnd.choice(["block", "allow", None])) for _ in range(40)]
    captures = [(i, rnd.choice([None, "http://x/", *[f"http://{p}{n}/q" for n in names for p in ("", "w.", "not")]]), rnd.choice([None, *map(day, range(31))])) for i in range(300)]
    want = []
    for page, url, fetched in captures:
        host, chosen = (url.split("/")[2] if url else None), None
        for pattern in sorted(names, key=len):
            if fetched and host and (host == pattern or host.endswith("." + pattern)):
                live = [(d, a is not None, a) for p, d, a in entries if p == pattern and d <= fetched]
                chosen = (max(live)[2], pattern) if live else chosen
        want.append((page, chosen[1] if chosen else None, chosen is None or chosen[0] != "block"))
    got = filter_captures(spark.createDataFrame(captures, "page_id long, url string, fetched_on date"), spark.createDataFrame(entries, "pattern string, listed_on date, action string"))
    assert sorted((r["page_id"], r["pattern"], r["kept"]) for r in got.collect()) == sorted(want)

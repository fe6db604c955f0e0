import hashlib
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadspark.functions import columns as C


def values(spark, rows, schema, **made):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in made.items()]).collect()]


def one(spark, column, **row):
    literals = {k: F.lit(v) for k, v in row.items()}
    return spark.range(1).select(*[v.alias(k) for k, v in literals.items()]).select(column.alias("x")).first()["x"] if row else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [("$300,000.00", 300000), ("$1,200,000", 1200000), ("515,000.00", 515000), ("0.00", 0), ("", 0), ("abc", 0), (None, 0)])
def test_whole_dollars(spark, text, want):
    assert values(spark, [(text,)], "t string", x=C.whole_dollars("t")) == [(want,)]


@pytest.mark.parametrize(("text", "want"), [("$1,500,000.75", 1500000), ("250 per day", 250), ("-5", -5), ("about 3", 0), (None, 0)])
def test_leading_dollars(spark, text, want):
    assert values(spark, [(text,)], "t string", x=C.leading_dollars("t")) == [(want,)]


def test_dates(spark):
    rows = [("2024-03-05",), ("Mar 05, 2024",), ("03/05/2024",), ("Tue, 05 Mar 2024 10:00:00 GMT",), ("Tue, 05 Mar 2024 10:00:00 +0000",), ("soon",), (None,)]
    got = values(spark, rows, "t string", x=C.feed_date("t", F.lit("2000-01-01").cast("timestamp")).cast("date"))
    assert [g[0] for g in got] == [date(2024, 3, 5)] * 5 + [date(2000, 1, 1)] * 2
    assert values(spark, [("3/9/2026 - 4/10/2026",), ("",), ("x",)], "t string", x=C.schedule_start("t")) == [(date(2026, 3, 9),), (None,), (None,)]


def test_record_key(spark):
    row = [("s", "e", "t", date(2024, 1, 2)), ("s", None, "t", None)]
    got = values(spark, row, "source string, external_id string, title string, issued_at date", x=C.record_key())
    assert [g[0] for g in got] == [hashlib.sha256(b"s|e|t|2024-01-02").hexdigest(), hashlib.sha256(b"s||t|0001-01-01").hexdigest()]
    a, b = values(spark, [("A Film ", "TV"), ("a film", "tv ")], "t string, k string", x=C.production_key("s", "t", "k"))
    assert a == b


def test_text_forms(spark):
    assert values(spark, [(" The Lost Highway! ",)], "t string", a=C.slug("t"), b=C.dashed("t")) == [("the-lost-highway", "-the-lost-highway!-")]
    assert values(spark, [("QUEENS  FOR A DAY",)], "t string", x=C.title_case("t")) == [("Queens For A Day",)]
    rows = [("3920 Norland Avenue, Burnaby, Canada",), ("x, Canada",), ("",), (None,)]
    assert [r[0] for r in values(spark, rows, "t string", x=C.city("t"))] == ["Burnaby, BC"] + ["Metro Vancouver, BC"] * 3
    assert [r[0] for r in values(spark, [("feature",), ("TV SERIES",), ("Other",)], "t string", x=C.production_name("t"))] == ["Feature Film", "TV Series", "Other"]
    assert [r[0] for r in values(spark, [("/a",), ("http://b",), ("",)], "t string", x=C.absolute_url("t", "https://h"))] == ["https://h/a", "http://b", ""]


def test_contact_data(spark):
    text = "Call 604-555-0199 or (604) 555 0123, mail A.b@ex-ample.co.uk now"
    assert values(spark, [(text,)], "t string", x=C.without_contact_data("t")) == [("Call [REDACTED PHONE] or [REDACTED PHONE], mail [REDACTED EMAIL] now",)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 400))
def test_shorten(spark, n):
    text = ("word " * 100)[:n].strip()
    got = values(spark, [(text,)], "t string", x=C.shorten("t"))[0][0]
    assert len(got) <= 280 and text.startswith(got) and (len(text) > 280 or got == text)


def test_fences(spark):
    rows = [("```json\n{}\n```",), ("```\n{}```",), ("{}",), (" ``` x",)]
    assert [r[0] for r in values(spark, rows[:3], "t string", x=C.without_fences("t"))] == ["{}"] * 3
    assert [r[0] for r in values(spark, rows[:3], "t string", x=C.without_fence_line("t"))] == ["{}"] * 3


def test_answer_text(spark):
    rows = [('{"content":[{"type":"x","text":"a"},{"type":"text","text":"b"}]}',), ('{"error":{"message":"bad"}}',), ('{"content":[]}',), ("junk",)]
    got = [tuple(r[0]) for r in values(spark, rows, "t string", x=C.answer_text("t"))]
    assert got == [("b", None), (None, "bad"), (None, "no text block"), (None, "no text block")]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), (None, [1.0]), ([], [])]
    assert [r[0] for r in values(spark, rows, "a array<double>, b array<double>", x=C.cosine("a", "b"))] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize(
    ("rate", "hour", "minutes", "weather", "single", "want"),
    [
        (0.0, 12, 60, None, False, "Ignore"), (0.15, 12, 120, None, False, "Watch"), (0.6, 20, 60, None, False, "SoftAlert"), (0.71, 22, 90, None, False, "HardAlert"),
        (0.0, 12, 10, "Snow", False, "PreAlert"), (0.8, 12, 15, "Fog", False, "Ignore"), (0.25, 12, 120, "AtmosphericRiver", False, "SoftAlert"), (0.8, 22, 90, None, True, "SoftAlert"),
    ],
)
def test_states(spark, rate, hour, minutes, weather, single, want):
    rows = [(rate, hour, minutes, weather, single)]
    score = C.disruption_score(F.col("r"), F.col("h"), F.col("m"))
    assert values(spark, rows, "r double, h int, m int, w string, s boolean", x=C.tuned_state(C.state_of(score), score, F.col("m"), F.col("w"), F.col("s"))) == [(want,)]


def test_weather_type(spark):
    rows = [("Snowfall warning", ""), ("FOG", ""), ("Rainfall", "an Atmospheric river"), ("wind", ""), ("heat", None), (None, None)]
    assert [r[0] for r in values(spark, rows, "e string, h string", x=C.weather_type("e", "h"))] == ["Snow", "Fog", "AtmosphericRiver", "Wind", "Unknown", "Unknown"]

import glob
import math
import os

import duckdb
import pytest

from leadspark.plans.lead_queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(frame):
    cell = lambda v: "~" if v is None or str(v) in ("NaT", "nan", "<NA>") or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else str(v).replace(" 00:00:00", "")
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(map(cell, row))) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        connection.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        assert plain(got) == plain(duck.sql(ORACLES[name]).df())
    else:
        assert len(got)


def test_clustered_search_finds_nine_in_ten(spark):
    got = QUERIES["clustered_recall"](spark, "/root/testdata/sf0.01").first()
    assert got["recall_reached"] and got["pruned"]


def test_stream_writes_a_row_a_poll(spark):
    """The copies for the hotels are made after the stream, so what it writes does not grow with polls times hotels."""
    out = QUERIES["stream_assembled"](spark, SF)
    written = spark.read.parquet(*[f for f in out.inputFiles() if "/run/out/" in f])
    assert 0 < written.count() == written.select("airport", "as_of").distinct().count() == out.select("airport", "as_of").distinct().count()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

import datetime as dt
import json

import pytest

from leadspark import schemas
from leadspark.sources.registry import COLUMNS, Bounds, Collector, PageFiles, Sources, collect


class Numbers(Collector):
    """A part is a hundred; day 1 + n // 100 of January."""

    def __init__(self, name, hundreds, log=None):
        self.name, self.hundreds, self.log = name, hundreds, log

    def partitions(self, bounds):
        days = [dt.date(2024, 1, 1 + h) for h in range(self.hundreds)]
        asked = [h for h, d in enumerate(days) if not (bounds.since and d < bounds.since) and not (bounds.until and d > bounds.until)]
        if self.log:
            with open(self.log, "a") as f:
                f.write(json.dumps([asked, sorted(bounds.external_ids or [])]) + "\n")
        return asked

    def read(self, part, bounds):
        for n in range(100 * part, 100 * part + 100):
            yield {"source": self.name, "external_id": str(n), "value": n, "issued_at": dt.date(2024, 1, 1 + part)}


def test_parts_become_tasks_and_conditions_reach_the_collector(spark, tmp_path):
    log = f"{tmp_path}/log"
    rows = collect(spark, Numbers("numbers", 6, log))
    assert rows.columns == COLUMNS and rows.count() == 600 and rows.rdd.getNumPartitions() == 6
    some = rows.where("issued_at >= DATE '2024-01-03' AND issued_at < DATE '2024-01-05' AND external_id IN ('250', '399', '7')")
    assert sorted(r["external_id"] for r in some.collect()) == ["250", "399"]
    with open(log) as f:
        assert [[2, 3, 4], ["250", "399", "7"]] in [json.loads(line) for line in f]


def test_sources_of_one_object_are_not_those_of_another(spark):
    frame = spark.createDataFrame([("x", "1", 5, "extra")], "source string, external_id string, value long, other string")
    a = Sources(spark).add("numbers", Numbers("n", 2)).add("frame", frame)
    b = Sources(spark).add("numbers", Numbers("n", 3))
    assert (a.union().count(), b.union().count(), a.union({"numbers": False}).count()) == (201, 300, 1)
    assert a.union().columns == COLUMNS and a.names == ["numbers", "frame"] and Sources(spark).union().count() == 0
    with pytest.raises(ValueError):
        a.add("frame", frame)


def test_page_files(spark, tmp_path):
    for day, lines in {"2024-01-01": ['{"source": "s", "external_id": "1", "value": 3}', "{broken", '{"external_id": 4}', "[1]"], "2024-02-01": ['{"source": "s", "external_id": "2", "title": "é"}'], "__HIVE_DEFAULT_PARTITION__": ['{"external_id": "3"}']}.items():
        folder = tmp_path / f"day={day}"
        folder.mkdir()
        (folder / "part.json").write_text("\n".join(lines) + "\n")
        (folder / "_SUCCESS").write_text("")
    rows = collect(spark, PageFiles("pages", f"file:{tmp_path}"))
    got = sorted(((r["external_id"], r["issued_at"], r["raw_type"], bytes(r["raw_data"] or b"")) for r in rows.collect()), key=str)
    january = dt.date(2024, 1, 1)
    assert got == sorted([("1", january, None, b""), (None, january, "bad", b"{broken"), (None, january, "bad", b'{"external_id": 4}'), (None, january, "bad", b"[1]"), ("2", dt.date(2024, 2, 1), None, b""), ("3", None, None, b"")], key=str)
    late = rows.where("issued_at > DATE '2024-01-15'")
    assert [r["title"] for r in late.collect()] == ["é"] and late.rdd.getNumPartitions() == 1
    assert collect(spark, PageFiles("none", f"{tmp_path}/absent")).count() == 0


def test_bounds_are_never_narrower_than_the_conditions():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull, LessThan

    bounds, day = Bounds(), dt.date(2024, 1, 5)
    assert bounds.takes(GreaterThan(("issued_at",), day)) and bounds.takes(LessThan(("issued_at",), day)) and bounds.takes(EqualTo(("external_id",), "x"))
    assert not bounds.takes(IsNull(("issued_at",))) and not bounds.takes(EqualTo(("title",), "x")) and not bounds.takes(EqualTo(("a", "issued_at"), day))
    assert (bounds.since, bounds.until, bounds.external_ids) == (day, day, frozenset("x"))
    assert "issued_at" in schemas.PROJECT

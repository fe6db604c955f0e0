import pytest
from pyspark.sql import functions as F

from leadspark.operators import dedup
from leadspark.operators.store import TableStore, VersionTaken, bucket_of, write_bucketed

SCHEMA = "id bigint, v string"


def rows(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def held(store, name="t"):
    return sorted(map(tuple, store.read(name, SCHEMA).collect()))


def files(tmp_path):
    return {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}


class Crash(Exception):
    pass


@pytest.fixture
def store(spark, tmp_path):
    made = TableStore(spark, str(tmp_path))
    made.swap("t", rows(spark, [(i, "old") for i in range(40)]), "id", 8)
    return made


def test_states_follow_each_other(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert held(store) == [] and store.manifest("t")["version"] == 0
    store.append("t", rows(spark, [(1, "a")]))
    store.append("t", rows(spark, [(1, "b")]))
    assert held(store) == [(1, "a"), (1, "b")]
    before = store.read("t", SCHEMA)
    store.swap("t", rows(spark, [(2, "c")]), "id")
    store.append("t", rows(spark, [(3, "d")]))
    assert held(store) == [(2, "c"), (3, "d")] and before.count() == 2
    store.vacuum("t")
    assert held(store) == [(2, "c"), (3, "d")] and len(list(tmp_path.rglob("v*"))) == 1
    store.clear("t", "absent")
    assert held(store) == []
    store.vacuum("t")
    assert not list(tmp_path.rglob("*.parquet"))


def test_a_change_writes_its_buckets_alone(spark, tmp_path, store):
    before = files(tmp_path)
    bucket = spark.range(1).select(bucket_of("id", 8)).first()[0]
    touched = store.change("t", SCHEMA, rows(spark, [(0, "new"), (0, "newer")]), lambda old, batch: dedup.upsert(old, batch, "id", F.length("v")))
    assert touched == [bucket]
    assert held(store) == [(0, "newer")] + [(i, "old") for i in range(1, 40)]
    now = {f for _, f in store.manifest("t")["folders"]}
    kept = {n for n in before if any(n.startswith(f"t/{f}/") for f in now)}
    assert {n: before[n] for n in kept} == {n: t for n, t in files(tmp_path).items() if n in kept}
    assert len(kept) == len(before) - 1
    store.vacuum("t")
    assert held(store)[0] == (0, "newer") and len(files(tmp_path)) == len(before)


def test_purge_status_and_empty_batches(spark, store):
    store.change("t", SCHEMA, rows(spark, [(3, ""), (99, "")]), lambda old, batch: old.join(batch.select("id"), "id", "left_anti"))
    assert 3 not in dict(held(store)) and len(held(store)) == 39
    assert store.change("t", SCHEMA, rows(spark, []), lambda old, batch: old) == []
    store.change("t", SCHEMA, rows(spark, [(4, "done")]), lambda old, batch: dedup.set_status(old, batch, "id", "v")[0])
    assert dict(held(store))[4] == "done"
    with pytest.raises(ValueError, match="keys that the batch"):
        store.change("t", SCHEMA, rows(spark, [(4, "x")]), lambda old, batch: rows(batch.sparkSession, [(i, "y") for i in range(50)]))
    store.append("loose", rows(spark, [(1, "a")]))
    with pytest.raises(ValueError, match="no key"):
        store.change("loose", SCHEMA, rows(spark, [(1, "x")]), lambda old, batch: batch)


@pytest.mark.parametrize("step", ["_write", "_stage", "_commit"])
@pytest.mark.parametrize("action", ["swap", "change", "append", "clear"])
def test_a_crash_leaves_the_old_state(spark, store, monkeypatch, step, action):
    """Whatever step dies, the old version is whole; after it, the same action works and nothing of the crash is left."""
    before, batch = held(store), rows(spark, [(5, "new"), (77, "new")])
    acts = {
        "swap": lambda: store.swap("t", batch, "id", 8),
        "change": lambda: store.change("t", SCHEMA, batch, lambda old, b: dedup.upsert(old, b, "id", F.lit(1))),
        "append": lambda: store.append("t", batch),
        "clear": lambda: store.clear("t"),
    }
    if (step, action) == ("_write", "clear"):
        pytest.skip("nothing is written")
    with monkeypatch.context() as m:

        def dies(*args, **kwargs):
            raise Crash

        m.setattr(store, step, dies)
        with pytest.raises(Crash):
            acts[action]()
    assert held(store) == before
    acts[action]()
    want = {"swap": [(5, "new"), (77, "new")], "change": sorted([r for r in before if r[0] != 5] + [(5, "new"), (77, "new")]), "append": sorted([*before, (5, "new"), (77, "new")]), "clear": []}[action]
    assert held(store) == want
    store.vacuum("t")
    assert held(store) == want


def test_the_second_of_two_writers_is_told(spark, store):
    stale = store.manifest("t")
    store.append("t", rows(spark, [(100, "first")]))
    with pytest.raises(VersionTaken):
        store._publish("t", stale, folders=[])
    assert (100, "first") in held(store)


def test_few_keys_are_pushed_and_many_are_joined(spark, store):
    asked = spark.createDataFrame([(7,), (7,), (1000,), (None,)], "id bigint")
    found = store.find("t", SCHEMA, asked, "id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [Or" in plan or "In(id, [" in plan
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(7, "old"), (7, "old"), (1000, None), (None, None)], key=str)
    read = {b for b, _ in store.manifest("t")["folders"]}
    some = store._scan("t", SCHEMA, [f for f in store.manifest("t")["folders"] if f[0] in {r[0] for r in asked.na.drop().select(bucket_of("id", 8)).collect()}])
    assert len(some.inputFiles()) <= 2 < len(read) and sorted(found.inputFiles()) == sorted(some.inputFiles())
    assert store.find("t", SCHEMA, spark.range(40), "id", most=5).where("v = 'old'").count() == 40


def test_bucketed_store_is_not_moved(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = write_bucketed(spark.range(0, 900, 3).select(F.sha2(F.col("id").cast("string"), 256).alias("hash")), "seen_hashes", "hash", f"{tmp_path}/seen", 8)
        batch = spark.range(100).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
        for how, n in ((dedup.unseen, 66), (dedup.already_seen, 34)):
            got = how(batch, seen)
            assert got.count() == n
            plan = got._jdf.queryExecution().executedPlan().toString()
            store_side = plan[plan.index("seen_hashes") - 600 : plan.index("seen_hashes")] if "seen_hashes" in plan else ""
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan and "Exchange" not in store_side.rsplit("Join", 1)[-1].rsplit("Range", 1)[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS seen_hashes")


def test_first_of_each_reads_once_and_keeps_rows_without_a_key(spark):
    table = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 5), (None, 6)], "k string, n int")
    got = dedup.first_of_each(table, "k", [F.col("n")])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1), (None, 5), (None, 5), (None, 6)], key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1

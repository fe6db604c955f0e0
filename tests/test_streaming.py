import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadspark.operators import disruption
from leadspark.streaming import alerts

SCORED = "airport string, as_of timestamp, state string, score double"


def run(stream, name, tmp_path, spark):
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").start()
    query.processAllAvailable()
    query.stop()
    return spark.sql(f"select * from {name}")


@pytest.mark.parametrize("zone", ["UTC", "America/Vancouver"])
def test_stream_equals_batch_with_late_rows(spark, tmp_path, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        _stream_equals_batch(spark, tmp_path, zone)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def _stream_equals_batch(spark, tmp_path, zone):
    rnd = random.Random(3)
    rows, at = [], datetime(2024, 1, 1)
    for _ in range(60):
        at += timedelta(minutes=rnd.choice([5, 10, 15]))
        for airport in ("A", "B"):
            rows.append((airport, at, rnd.choice(["Ignore", "Watch", "SoftAlert", "HardAlert"]), float(rnd.choice([10, 20]))))
    # Neighbouring rows arrive in another order; two rows far ahead let the watermark pass all others.
    shuffled = sorted(rows, key=lambda r: (r[1].timestamp() // 1800, rnd.random()))
    last = [("A", at + timedelta(days=1), "Ignore", 0.0), ("B", at + timedelta(days=1), "Ignore", 0.0)]
    for i, part in enumerate([shuffled[:50], shuffled[50:], last, [("Z", at + timedelta(days=2), "Ignore", 0.0)]]):
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = run(alerts.stream_alerts(stream), f"alert_actions_{zone[:2]}", tmp_path, spark)
    want = disruption.alert_episodes(spark.createDataFrame(rows + last, SCORED))
    columns = ["airport", "as_of", "started_at", "minutes", "state", "score", "action"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []


def test_windows_sessions_and_dedup(spark, tmp_path):
    events = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    polls = run(alerts.stream_polls(events.withColumn("airport", F.lit("A"))), "polls", tmp_path, spark)
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("as_of")).agg(F.count(F.lit(1)).alias("total"))
    closed = polls.select("as_of", "total")
    assert closed.count() > 0 and closed.join(batch, ["as_of", "total"], "left_anti").count() == 0
    assert run(alerts.stream_sessions(events), "sessions", tmp_path, spark).where("ended_at > started_at").count() > 0
    seen = run(alerts.stream_unseen(events.withColumn("hash", F.col("event_type"))), "unseen", tmp_path, spark)
    assert 0 < seen.count() <= 5


def test_repeated_batch_replaces_its_folder(spark, tmp_path):
    seen = []
    sink = alerts.batch_folders(str(tmp_path), lambda rows, batch_id: seen.append((batch_id, rows.count())))
    for rows in ([(1,), (2,)], [(1,), (2,)], [(3,)]):
        sink(spark.createDataFrame(rows, "x int"), 0 if rows[0][0] < 3 else 1)
    assert sorted(r["x"] for r in spark.read.schema("x int").option("recursiveFileLookup", "true").parquet(str(tmp_path)).collect()) == [1, 2, 3]
    assert seen == [(0, 2), (0, 2), (1, 1)]


def test_stream_at_an_interval(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    query = alerts.started(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), alerts.batch_folders(f"{tmp_path}/out"), f"{tmp_path}/state", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert spark.read.schema("id bigint").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out").count() == 5


def test_alerts_go_on_after_a_restart(spark, tmp_path):
    """A stream that is stopped between two batches and started again from its checkpoint misses and repeats nothing."""
    rnd = random.Random(8)
    rows, at = [], datetime(2024, 1, 1)
    for _ in range(120):
        at += timedelta(minutes=10)
        rows += [(a, at, rnd.choice(["Ignore", "Watch", "SoftAlert", "HardAlert", "HardAlert"]), float(rnd.choice([10, 20]))) for a in ("A", "B")]
    last = [(a, at + timedelta(days=d), "Ignore", 0.0) for a in ("A", "B") for d in (1, 2)]
    for i, part in enumerate([rows[:90], rows[90:150], rows[150:] + last]):
        spark.createDataFrame(part, SCORED).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCORED).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        got = alerts.run_once(alerts.stream_alerts(stream), f"{tmp_path}/run")
        told = got.count()
        assert told > 0 if i else told >= 0
    want = disruption.alert_episodes(spark.createDataFrame(rows + last, SCORED)).where(F.col("as_of") < F.lit(last[-1][1]))
    columns = ["airport", "as_of", "started_at", "minutes", "state", "score", "action"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []


def test_joined_streams_equal_the_batch_join_with_late_rows(spark, tmp_path):
    """Polls and two kinds of notices, each out of order within the lateness, over several batches and a restart."""
    rnd = random.Random(21)
    start = datetime(2024, 1, 1)
    schemas = {"polls": "airport string, as_of timestamp, n int", "weather": "airport string, as_of timestamp, kind string", "rooms": "airport string, as_of timestamp, rooms int, note string"}
    rows = {name: [] for name in schemas}
    for i in range(150):
        at = lambda: start + timedelta(minutes=10 * i + rnd.randrange(10), microseconds=rnd.randrange(10**6))  # noqa: B023, E731
        for airport in ("A", "B"):
            rows["polls"].append((airport, at(), i))
            if rnd.random() < 0.2:
                rows["weather"].append((airport, at(), rnd.choice(["Fog", "Snow"])))
            if rnd.random() < 0.3:
                rows["rooms"].append((airport, at(), rnd.choice([None, 1, 2]), rnd.choice([None, "x"])))
    end = start + timedelta(days=9)
    for name, tail in {"polls": (7,), "weather": ("end",), "rooms": (0, "end")}.items():
        rows[name].append(("C", end, *tail))
    rows["polls"].append((None, start, 1))
    for i in range(3):
        for name, all_rows in rows.items():
            n = len(all_rows) - 1
            part = all_rows[i * n // 3 : (i + 1) * n // 3] + (all_rows[n:] if i == 2 else [])
            part.sort(key=lambda r: (r[1].timestamp() // 1500, rnd.random()))
            spark.createDataFrame(part, schemas[name]).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i}")
        streams = [spark.readStream.schema(schemas[name]).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}") for name in schemas]
        got = alerts.run_once(alerts.stream_as_of(streams[0], streams[1:], "airport", "as_of"), f"{tmp_path}/run")
    frames = {name: spark.createDataFrame(r, schemas[name]) for name, r in rows.items()}
    want = disruption.as_of(disruption.as_of(frames["polls"], frames["weather"], "airport", "as_of", ["kind"]), frames["rooms"], "airport", "as_of", ["rooms", "note"])
    want = want.where("airport IS NOT NULL AND n <> 7 OR airport <> 'C'").where("airport IS NOT NULL")
    assert sorted(map(tuple, got.where("airport <> 'C'").collect()), key=str) == sorted(map(tuple, want.where("airport <> 'C'").collect()), key=str)


def test_a_batch_is_told_once(spark, tmp_path):
    """Killed between write and notification, and between notification and ledger: the ids let a receiver drop the repeat."""
    sent, die = [], ["write", "ledger"]
    spark.createDataFrame([(1,), (2,)], "id int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int").parquet(f"{tmp_path}/in")

    def send(batch, batch_id):
        if die[:1] == ["write"]:
            raise RuntimeError(die.pop(0))
        sent.extend(r["payload_id"] for r in batch.collect())
        if die:
            raise RuntimeError(die.pop(0))

    ends = []
    for _ in range(4):
        try:
            alerts.run_once(stream, f"{tmp_path}/run", alerts.told_once(f"{tmp_path}/ledger", send, ["id"]))
            ends.append("whole")
        except Exception:  # noqa: BLE001
            ends.append("dead")
    assert ends == ["dead", "dead", "whole", "whole"] and len(sent) == 4 and len(set(sent)) == 2
    rows = spark.createDataFrame([(3,)], "id int")
    alerts.told_once(f"{tmp_path}/ledger", send, ["id"])(rows, 0)
    assert len(sent) == 4 and 0 in alerts.Ledger(spark, f"{tmp_path}/ledger") and 5 not in alerts.Ledger(spark, f"{tmp_path}/ledger")

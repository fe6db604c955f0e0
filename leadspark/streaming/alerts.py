"""Structured Streaming forms: windowed polls, sessions, dedup and the alert state machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from leadspark import rules

ACTION_SCHEMA = "airport string, as_of bigint, started_at bigint, minutes int, state string, score double, action string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_polls(events: DataFrame, late: str = "1 hour", width: str = "1 hour", cancelled: str = "error") -> DataFrame:
    """Tumbling polls of an event stream: airport, as_of, total, cancelled, rate; later events are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    total, bad = F.count(F.lit(1)), F.count_if(F.col("event_type") == cancelled)
    polls = rows.groupBy(F.window("ts", width).alias("w"), "airport").agg(total.alias("total"), bad.alias("cancelled"))
    return polls.select("airport", F.col("w.start").alias("as_of"), "total", "cancelled", (F.col("cancelled") / F.col("total")).alias("rate"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "n")


def stream_unseen(records: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    return records.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["hash"])


def _step(key: str, rows: list[tuple], state: tuple, dwell: int) -> tuple[list[tuple], tuple]:
    """Advance one airport over scored polls (time in microseconds, state, score) in time order."""
    started, posted, last = state
    out = []
    for at, name, score in rows:
        if name == "Ignore":
            if started is not None and posted:
                out.append((key, at, started, (at - started) // 60_000_000, name, score, "RESOLVE"))
            started, posted, last = None, False, None
            continue
        if started is None:
            started, posted, last = at, False, None
        minutes = (at - started) // 60_000_000
        if not posted and minutes >= dwell and name in rules.ALERT_STATES:
            out.append((key, at, started, minutes, name, score, "POST"))
            posted = True
        elif posted and score != last:
            out.append((key, at, started, minutes, name, score, "UPDATE"))
        last = score
    return out, (started, posted, last)


class AlertMachine(StatefulProcessor):
    """State of one airport: its open episode, the polls that the watermark has not passed, and a timer for the earliest of them."""

    def __init__(self, dwell: int) -> None:
        self.dwell = dwell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", "started bigint, posted boolean, last_score double")
        self.waiting = handle.getListState("waiting", "at bigint, state string, score double")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = self.due.get()[0] if self.due.exists() else None
        for f in rows:
            polls = [(int(t), s, float(v)) for t, s, v in zip(f["micros"], f["state"], f["score"], strict=True)]
            self.waiting.appendList(polls)
            low = min(p[0] for p in polls)
            if earliest is None or low < earliest:
                if earliest is not None:
                    self.handle.deleteTimer(earliest // 1000 + 1)
                earliest = low
                self.due.update((low,))
                self.handle.registerTimer(low // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Step through the polls that the watermark has passed, in time order; the timer moves to the earliest of the others."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        polls = sorted((p[0], p[1], p[2]) for p in self.waiting.get())
        ready, rest = [p for p in polls if p[0] < mark], [p for p in polls if p[0] >= mark]
        state = tuple(self.episode.get()) if self.episode.exists() else (None, False, None)
        out, state = _step(key[0], ready, state, self.dwell)
        self.episode.update(state)
        if rest:
            self.waiting.put(rest)
            self.due.update((rest[0][0],))
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
            self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=["airport", "as_of", "started_at", "minutes", "state", "score", "action"])

    def close(self) -> None:
        pass


def stream_alerts(scored: DataFrame, late: str = "1 hour", dwell: int = rules.DWELL_MINUTES) -> DataFrame:
    """Alert actions of a stream of scored polls (airport, as_of, state, score).

    Polls wait in keyed state, by event time, until the watermark has passed them, so the order of arrival within the
    allowed lateness does not matter; an event-time timer wakes the airport then, whether or not it gets new polls. A poll adds
    one row to a list in RocksDB, which the session is set to; nothing that waits is rewritten before its time. A started stream goes on from its checkpoint.
    """
    scored.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Times travel as microseconds, so the session's time zone plays no part in the comparison with the watermark.
    rows = scored.withColumn("as_of", F.col("as_of").cast("timestamp")).withWatermark("as_of", late).withColumn("micros", F.unix_micros("as_of"))
    actions = rows.groupBy("airport").transformWithStateInPandas(AlertMachine(dwell), ACTION_SCHEMA, "append", "EventTime")
    return actions.withColumns({c: F.timestamp_micros(c) for c in ("as_of", "started_at")})


#: Rows wait as JSON; times keep their microseconds in it.
_MICROS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class AsOfMachine(StatefulProcessor):
    """State of one key: the latest row of each right side, and rows of all sides that the watermark has not passed."""

    def __init__(self, sides: int) -> None:
        self.sides = sides

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getMapState("latest", "side int", "body string")
        self.waiting = handle.getListState("waiting", "at bigint, side int, body string")
        self.due = handle.getValueState("due", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        earliest = self.due.get()[0] if self.due.exists() else None
        for f in rows:
            come = [(int(t), int(s), b) for t, s, b in zip(f["micros"], f["side"], f["body"], strict=True)]
            self.waiting.appendList(come)
            low = min(c[0] for c in come)
            if earliest is None or low < earliest:
                if earliest is not None:
                    self.handle.deleteTimer(earliest // 1000 + 1)
                earliest = low
                self.due.update((low,))
                self.handle.registerTimer(low // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Answer the left rows that the watermark has passed; right rows of the same time come before them."""
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((w[0], w[1], w[2]) for w in self.waiting.get())
        latest = {int(k[0]): v[0] for k, v in self.latest.iterator()}
        out, changed = [], set()
        for _, side, body in (r for r in rows if r[0] < mark):
            if side < self.sides:
                latest[side] = body
                changed.add(side)
            else:
                out.append((body, *[latest.get(s) for s in range(self.sides)]))
        for side in changed:
            self.latest.updateValue((side,), (latest[side],))
        rest = [r for r in rows if r[0] >= mark]
        if rest:
            self.waiting.put(rest)
            self.due.update((rest[0][0],))
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
            self.due.clear()
        if out:
            yield pd.DataFrame(out, columns=["body", *[f"found{s}" for s in range(self.sides)]])

    def close(self) -> None:
        pass


def stream_as_of(left: DataFrame, rights: Sequence[DataFrame], key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Stream of the left rows, each with the latest row of every right stream of its key at or before its time.

    The streams are joined by key in one keyed state. The watermark, which follows the slowest stream, decides when a left row is
    answered: rows may come in any order within ``late``, and rows behind the watermark are dropped. What waits are the rows between the watermark and
    the newest ones; of the right sides one row each is kept beyond that, however old. Right streams have key, time and the columns to carry;
    of those with one key and time the one that is greatest as JSON counts. Rows without a key or time are left out.
    """
    spark = left.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    carried = [[c for c in r.columns if c not in (key, time)] for r in rights]
    sides = []
    for side, frame in enumerate([*rights, left]):
        names = carried[side] if side < len(rights) else frame.columns
        timed = frame.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
        body = F.to_json(F.struct(*names), {"ignoreNullFields": "false", **_MICROS})
        sides.append(timed.select(F.col(key).alias("key"), F.col("_at").alias("at"), F.unix_micros("_at").alias("micros"), F.lit(side).alias("side"), body.alias("body")).where("key IS NOT NULL AND at IS NOT NULL"))
    both = reduce(DataFrame.unionByName, sides)
    schema = ", ".join(["body string", *[f"found{s} string" for s in range(len(rights))]])
    told = both.groupBy("key").transformWithStateInPandas(AsOfMachine(len(rights)), schema, "append", "EventTime")
    parsed = told.select(F.from_json("body", left.schema, _MICROS).alias("l"), *[F.from_json(f"found{s}", r.select(*carried[s]).schema, _MICROS).alias(f"r{s}") for s, r in enumerate(rights)])
    return parsed.select("l.*", *[F.col(f"r{s}.{c}").alias(c) for s, names in enumerate(carried) for c in names])


def started(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start a stream that hands every micro-batch and its id to ``write``: each ``every``, or once over what is there."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def batch_folders(path: str, and_then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Sink of one folder a micro-batch: a repeated batch replaces its own folder, so each row is kept once.

    ``and_then`` is called with what was written, once it is safe; it has to recognise a batch id it has seen, as that of ``told_once`` does.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(folder)
        if and_then:
            and_then(batch.sparkSession.read.schema(batch.schema).parquet(folder), batch_id)

    return write


class Ledger:
    """Batch ids that are finished, one empty file each beside the output; it survives the stream."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, batch_id: int):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{batch_id:012d}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def __contains__(self, batch_id: int) -> bool:
        fs, path = self._at(batch_id)
        return fs.exists(path)

    def add(self, batch_id: int) -> None:
        fs, path = self._at(batch_id)
        fs.create(path, True).close()


def told_once(path: str, send: Callable[[DataFrame, int], None], key: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """For ``and_then``: ``send`` gets the rows of a batch with a ``payload_id``, unless the ledger at ``path`` has the batch.

    The id is written to the ledger after the notification. A stream that dies before it sends the batch once more when it is started
    again: with the same payload ids, hashes of ``key``, so a receiver can drop what it already has. A batch in the ledger is never sent again.
    """

    def then(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, path)
        if batch_id in ledger:
            return
        send(batch.withColumn("payload_id", F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256)), batch_id)
        ledger.add(batch_id)

    return then


def run_once(stream: DataFrame, folder: str, and_then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Run a stream over what its source holds now and read back all that it has written so far."""
    started(stream, batch_folders(f"{folder}/out", and_then), f"{folder}/state").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")

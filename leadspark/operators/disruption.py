"""Disruption scoring and the alert life cycle as window queries over poll history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark import rules
from leadspark.functions.columns import disruption_score, state_of, tuned_state


#: Seconds of a cell, the stretch of time of one key that one task orders.
CELL_SECONDS = 86_400
#: Polls, and hotels, of one airport in a cell of their join, about.
CELL_ROWS = 1024


def _cell(time: str, seconds: int) -> Column:
    """Number of the stretch of ``seconds`` that a time falls in; rows without a time come before all others."""
    return F.coalesce(F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000)).cast("bigint"), F.lit(-(1 << 62)).cast("bigint"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, carry: Sequence[str], cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (a right row of the same time counts).

    In two levels: every cell of (key, stretch of time) is ordered by itself, and a table of one row a cell carries the last right row
    of the cells before. So a key of any number of rows is as many tasks as it has cells. Of right rows with one key and time the one
    with the greatest ``carry`` values counts; rows without a key meet each other; a time that is null comes before all others.
    """
    # A struct of one null equals another, so rows without a key are joined like all others.
    place = [F.struct(F.col(key)).alias("_k"), F.col(time).alias("_t"), _cell(time, cell_seconds).alias("_cell")]
    marks = right.select(*place, F.struct(*carry).alias("_r"))
    rows = left.select(*place, F.struct(*left.columns).alias("_l"))
    ends = marks.groupBy("_k", "_cell").agg(F.max_by("_r", F.struct("_t", "_r")).alias("_end")).unionByName(rows.select("_k", "_cell").distinct(), allowMissingColumns=True)
    ends = ends.groupBy("_k", "_cell").agg(F.first("_end", True).alias("_end"))
    earlier = F.last("_end", True).over(Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select("_k", "_cell", earlier.alias("_carried"))
    both = marks.withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    within = Window.partitionBy("_k", "_cell").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_r", True).over(within)).where("_side = 1")
    found = found.join(carried, ["_k", "_cell"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    return found.select("_l.*", *[F.col(f"_found.{c}").alias(c) for c in carry])


def with_minutes_active(polls: DataFrame, onset_rate: float = 0.0, key: str = "airport", time: str = "as_of", close_minutes: int = 0, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Add minutes_active: whole minutes since the first poll of the current run with rate above ``onset_rate``.

    A cell of (key, stretch of time) maps the start of the run that is open when it begins to the start of the one open
    when it ends: a cell with a poll at or below the rate forgets what came before, any other hands it on. These maps are composed
    over the cells of a key, one row each; then all cells number their polls side by side. Polls are unique by key and time.
    """
    on = F.coalesce(F.col("rate") > onset_rate, F.lit(False))
    rows = polls.withColumns({"_on": on, "_k": F.struct(F.col(key)), "_cell": _cell(time, cell_seconds)})
    order = Window.partitionBy("_k", "_cell").orderBy(time)
    # Runs inside a cell are numbered by the polls that end them; run 0 may continue one of the cells before.
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("_k", "_cell", "_run").agg(F.min(F.when(F.col("_on"), F.col(time))).alias("_start"))
    cells = runs.groupBy("_k", "_cell").agg(F.max("_run").alias("_offs"), F.max_by("_start", "_run").alias("_open"))
    carried = _open_before(cells, ["_k"], F.col("_offs") > 0, {"_entry": F.first("_open", True)})
    here = F.min(F.when(F.col("_on"), F.col(time))).over(Window.partitionBy("_k", "_cell", "_run"))
    since = F.when(F.col("_run") == 0, F.coalesce("_entry", here)).otherwise(here)
    told = rows.join(carried, ["_k", "_cell"]).withColumn("_since", since)
    minutes = F.floor((F.unix_timestamp(time) - F.unix_timestamp("_since")) / 60) + close_minutes
    told = told.withColumn("minutes_active", F.when(F.col("_on"), minutes).otherwise(F.lit(0)).cast("int"))
    return told.select(*polls.columns, "minutes_active")


def _open_before(cells: DataFrame, keys: Sequence[str], resets: Column, carry: dict[str, Column]) -> DataFrame:
    """Compose what cells hand on: each (keys, _cell) with aggregates ``carry`` over the cells before it since the last one that ``resets``, that one included."""
    order = Window.partitionBy(*keys).orderBy("_cell")
    spans = cells.withColumn("_span", F.sum(F.when(resets, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = Window.partitionBy(*keys, "_span").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    left = spans.select(*keys, "_cell", *[c.over(upto).alias(n) for n, c in carry.items()])
    return left.select(*keys, "_cell", *[F.lag(n).over(order).alias(n) for n in carry])


def with_score(polls: DataFrame, time: str = "as_of", weather: Column | None = None, single_runway: Column | None = None) -> DataFrame:
    """Add score and state from rate, hour and minutes_active, tuned by weather and runway."""
    minutes = F.col("minutes_active")
    scored = polls.withColumn("score", disruption_score(F.col("rate"), F.hour(time), minutes))
    none = F.lit(None).cast("string")
    return scored.withColumn("state", tuned_state(state_of(F.col("score")), F.col("score"), minutes, weather if weather is not None else none, single_runway if single_runway is not None else F.lit(False)))


def alert_episodes(scored: DataFrame, keys: Sequence[str] = ("airport",), time: str = "as_of", dwell: int = rules.DWELL_MINUTES, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Every alert action of the scored polls: keys, time, started_at, minutes, state, score, action.

    Runs of states other than Ignore are episodes and the Ignore after one closes it. POST at the
    first poll with an alert state after the dwell time, UPDATE at later polls whose score changed,
    RESOLVE at the close if there was a POST; short or weak episodes end silently.

    The state machine of a key is not run in one task. A cell of (keys, stretch of time) is a function from the episode open at
    its beginning (when it started, its latest poll in an alert state, the last score) to the one open at its end: with an Ignore in the
    cell a constant, else the same episode with a later alert poll. That latest poll tells whether there was a POST, as
    it lies the dwell time after the start if any poll does. The functions are composed by prefix over the cells, one row each,
    and all cells then replay their polls side by side. Polls are unique by keys and time.
    """
    active = F.coalesce(F.col("state") != "Ignore", F.lit(False))
    place = {"_k": F.struct(*[F.col(k) for k in keys]), "_cell": _cell(time, cell_seconds), "_active": active}
    rows = scored.select(*keys, time, "state", "score").withColumns(place)
    order = Window.partitionBy("_k", "_cell").orderBy(time)
    closed = F.sum(F.when(F.col("_active"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Parts of a cell end with an Ignore; part 0 may continue an episode of the cells before.
    rows = rows.withColumns({"_part": F.coalesce(closed, F.lit(0)), "_before": F.lag("score").over(order), "_alerting": F.col("_active") & F.col("state").isin(*rules.ALERT_STATES)})
    parts = rows.groupBy("_k", "_cell", "_part").agg(
        F.min(F.when(F.col("_active"), F.col(time))).alias("_start"), F.max(F.when(F.col("_alerting"), F.col(time))).alias("_alert"),
        F.bool_or(~F.col("_active")).alias("_ends"), F.max_by("score", time).alias("_score"),
    )
    open_part = lambda c: F.max_by(F.when(~F.col("_ends"), F.col(c)), "_part")
    cells = parts.groupBy("_k", "_cell").agg(F.bool_or("_ends").alias("_resets"), open_part("_start").alias("_open"), open_part("_alert").alias("_late"), F.max_by("_score", "_part").alias("_end"))
    # An unbroken run of active polls hands on its first start, its latest alert poll and its last score.
    carried = _open_before(cells, ["_k"], F.col("_resets"), {"_since": F.first("_open", True), "_latest": F.max("_late"), "_score": F.last("_end")})
    rows = rows.join(carried, ["_k", "_cell"])
    first = F.col("_part") == 0
    part = Window.partitionBy("_k", "_cell", "_part")
    started = F.coalesce(F.when(first, F.col("_since")), F.min(F.when(F.col("_active"), F.col(time))).over(part))
    whole = lambda c: F.floor((F.unix_timestamp(c) - F.unix_timestamp("started_at")) / 60).cast("int")
    rows = rows.withColumn("started_at", started).withColumn("minutes", whole(time)).where("started_at IS NOT NULL")
    rows = rows.withColumns({"_due": F.col("_alerting") & (F.col("minutes") >= dwell), "_posted": first & F.coalesce(F.col("_since").isNotNull() & (whole("_latest") >= dwell), F.lit(False))})
    rows = rows.withColumns({"_first_due": F.min(F.when(F.col("_due"), F.col(time))).over(part), "_last": F.coalesce(F.col("_before"), F.when(first & (F.col("_since") < F.col(time)), F.col("_score")))})
    action = (
        F.when(~F.col("_active") & (F.col("_posted") | F.col("_first_due").isNotNull()), "RESOLVE")
        .when(~F.col("_active"), None)
        .when(~F.col("_posted") & (F.col(time) == F.col("_first_due")), "POST")
        .when((F.col("_posted") | (F.col(time) > F.col("_first_due"))) & (F.col("score") != F.col("_last")), "UPDATE")
    )
    return rows.withColumn("action", action).where("action is not null").select(*keys, time, "started_at", "minutes", "state", "score", "action")


def for_hotels(polls: DataFrame, hotel_airports: DataFrame, counted: DataFrame | None = None, key: str = "airport", time: str = "as_of", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Each poll once for every hotel that watches its airport.

    Polls and hotels of an airport are dealt to blocks of about ``cell_rows``, and every block of polls meets every block of hotels in a cell of its own: few
    airports with many of both are as many tasks as they have cells. A poll is copied once a block of hotels, a hotel once a block of polls, before
    the shuffle. ``counted`` has as many rows of each airport as ``polls`` where those take long to make.
    """
    watched, told = (f.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for f, n in ((hotel_airports, "_hotels"), (polls if counted is None else counted, "_polls")))
    blocks = told.join(watched, key).select(key, F.ceil(F.col("_polls") / cell_rows).alias("_across"), F.ceil(F.col("_hotels") / cell_rows).alias("_down"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = polls.join(blocks, key).withColumns({"_pb": F.pmod(F.xxhash64(time), F.col("_across")), "_hb": every("_down")}).drop("_across", "_down")
    right = hotel_airports.join(blocks, key).withColumns({"_hb": F.pmod(F.xxhash64("hotel_id"), F.col("_down")), "_pb": every("_across")}).drop("_across", "_down")
    # A stated number of partitions of either side: by the size of what goes in, these would be merged into a few.
    cell, parts = [key, "_pb", "_hb"], int(polls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(parts, *cell).join(right.repartition(parts, *cell), cell).drop("_pb", "_hb")


def assemble_polls(polls: DataFrame, weather: DataFrame, stops: DataFrame, hotel_airports: DataFrame, min_score: bool = False) -> DataFrame:
    """Polls with the weather alert and ground stop of their time, for every hotel that watches the airport."""
    first = weather.groupBy("airport", "as_of").agg(F.min_by("type", F.struct("zone", "pos")).alias("weather"))
    joined = as_of(as_of(polls, first, "airport", "as_of", ["weather"]), stops.withColumnRenamed("ground_stop", "notice_stop"), "airport", "as_of", ["notice_stop"])
    joined = joined.withColumn("ground_stop", F.coalesce("ground_stop", F.lit(False)) | F.coalesce("notice_stop", F.lit(False)))
    out = for_hotels(joined, hotel_airports, polls)
    return out.where(F.col("score") >= F.coalesce("alert_threshold_sps", F.lit(0.0))) if min_score and "score" in out.columns else out


def any_active(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(F.bool_or(F.col("state").isin(*rules.ALERT_STATES)).alias("any_active"))

"""Counts, ratios and histograms over leads, projects, model calls and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leadspark import rules

#: Tasks that the names of one frequent segment are dealt to.
SALTS = 4


def total_value(leads: DataFrame, value: str = "project_value", by: Sequence[str] = ()) -> DataFrame:
    """Number of rows, those with a value, and the sum of the values."""
    return leads.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col(value), F.lit(0)) > 0).alias("with_value"), F.coalesce(F.sum(value), F.lit(0)).alias("total_value"))


def run_counters(rows: DataFrame, **counters: Column) -> tuple[DataFrame, Observation]:
    """(the same rows, an observation): counters that Spark fills in while the run's own action reads the rows."""
    watched = Observation("run")
    return rows.observe(watched, F.count(F.lit(1)).alias("collected"), *[F.count_if(c).alias(n) for n, c in counters.items()]), watched


def field_hit_rate(signals: DataFrame, by: str = "source", fields: int = 6) -> DataFrame:
    """Mean hits and share of filled fields of the extracted signals, per source."""
    return signals.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("field_hits").alias("mean_hits"), (F.avg("field_hits") / fields).alias("hit_rate"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def call_metrics(calls: DataFrame, bounds: Sequence[int] = tuple(rules.LATENCY_BOUNDS)) -> DataFrame:
    """Calls, tokens and cumulative latency buckets by use case and status."""
    buckets = [F.count_if(F.col("latency_ms") <= b).alias(f"le_{b}") for b in bounds]
    return calls.groupBy("use_case", "status").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), *buckets)


def source_report(rows: DataFrame, won: Column, flagged: Column, by: str = "source") -> DataFrame:
    """Rows, wins, flags, hit rate and accuracy of every source; a source under 5 % hits is marked weak."""
    n, wins, flags = F.count(F.lit(1)), F.count_if(won), F.count_if(flagged)
    return rows.groupBy(by).agg(n.alias("n"), wins.alias("won"), flags.alias("flagged"), (wins / n).alias("hit_rate"), F.try_divide(wins, wins + flags).alias("accuracy"), (wins / n < 0.05).alias("weak"))


def shared_inputs(rows: DataFrame, key: str = "raw_input_id") -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def snapshot_changes(snapshots: DataFrame, key: str, order: str, digest: str) -> DataFrame:
    """Snapshots whose digest differs from the one before of the same key."""
    before = F.lag(digest).over(Window.partitionBy(key).orderBy(order))
    return snapshots.withColumn("previous", before).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(digest)))


def line_changes(snapshots: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """key, order, previous, added, removed: the lines that a snapshot has and the one before of its key lacks, and the other way round.

    Changes are found on hashes; only the texts of snapshots that changed are joined, each by its own (key, order), so a key of many
    snapshots is no single task's. Lines count once each, in their order; snapshots are unique by key and order.
    """
    ids = snapshots.select(key, order, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("_d"))
    by_time = Window.partitionBy(key).orderBy(order)
    told = ids.withColumns({"previous": F.lag(order).over(by_time), "_before": F.lag("_d").over(by_time)}).where("_before <> _d").select(key, order, "previous")
    lines = F.array_distinct(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    now, before = snapshots.select(key, order, lines.alias("_now")), snapshots.select(key, F.col(order).alias("previous"), lines.alias("_old"))
    both = told.join(now, [key, order]).join(before, [key, "previous"])
    return both.select(key, order, "previous", F.array_except("_now", "_old").alias("added"), F.array_except("_old", "_now").alias("removed"))


def attributed(leads: DataFrame, outcomes: DataFrame, days: int, by: Sequence[str] = ("source",), arrived: str = "created_at") -> DataFrame:
    """Leads, wins and the mean days to the win per group; a win counts for its lead if it came within ``days`` of the lead's arrival.

    ``outcomes`` has lead_id and at. The first win in the window counts, once a lead; a win before the arrival or after the window does not.
    """
    window = (F.col("at") >= F.col(arrived)) & (F.col("at") < F.col(arrived) + F.make_dt_interval(days=F.lit(days)))
    first = leads.select("id", arrived).join(outcomes.select(F.col("lead_id").alias("id"), "at"), "id").where(window).groupBy("id").agg(F.min("at").alias("won_at"))
    told = leads.join(first, "id", "left")
    late = (F.unix_micros("won_at") - F.unix_micros(arrived)) / 86_400_000_000
    return told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count("won_at").alias("won"), F.avg(late).alias("mean_days"), (F.count("won_at") / F.count(F.lit(1))).alias("hit_rate"))


def repeat_organisations(rows: DataFrame, past: DataFrame, name: str = "org_name", most_edits: int = 2, bonus: int = 2) -> DataFrame:
    """Rows with their past organisation: the name with the fewest edits once normalised, at most ``most_edits``.

    Names with that few edits share one of ``most_edits`` + 1 segments of the past name, moved by
    as many places at most, so every such pair meets in the join. The join is salted, as many names may share a segment.
    """
    plain = F.btrim(F.regexp_replace(F.lower(F.coalesce(F.col(name), F.lit(""))), r"\b(inc|ltd|corp|llc|co)\b|[^a-z0-9]+", " "))
    known = past.select(plain.alias("_p")).where("_p <> ''").distinct()
    asked = rows.select(F.col(name), plain.alias("_n")).distinct().where("_n <> ''")
    pieces, shifts = range(most_edits + 1), range(-most_edits, most_edits + 1)
    begin = lambda size, i: F.floor(size * i / len(pieces)).cast("int")

    def segment(c: str, size: Column, i: int, shift: int) -> Column:
        at, until = begin(size, i) + shift, begin(size, i + 1) + shift
        text = F.when((at >= 0) & (until <= F.char_length(c)), F.substring(F.col(c), at + 1, until - at))
        return F.when(text.isNotNull(), F.xxhash64(size, F.lit(i), text))

    size = F.char_length("_p")
    cuts = known.select("_p", F.explode(F.array(*[segment("_p", size, i, 0) for i in pieces])).alias("_k"))
    cuts = cuts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    sizes = F.explode(F.array(*[F.char_length("_n") + d for d in shifts])).alias("_size")
    places = F.array_distinct(F.array_compact(F.array(*[segment("_n", F.col("_size"), i, d) for i in pieces for d in shifts])))
    names = asked.select("_n").distinct()
    tries = names.select("_n", sizes).where("_size > 0").select("_n", F.explode(places).alias("_k"), F.pmod(F.xxhash64("_n"), F.lit(SALTS)).cast("int").alias("_s"))
    near = tries.join(cuts, ["_k", "_s"]).where(F.levenshtein("_n", "_p") <= most_edits)
    best = near.groupBy("_n").agg(F.min_by("_p", F.struct(F.levenshtein("_n", "_p"), "_p")).alias("matched"))
    best = asked.join(best, "_n").select(name, "matched")
    return rows.join(best, name, "left").withColumn("bonus", F.when(F.col("matched").isNotNull(), bonus).otherwise(0))


def weekly_demand(rows: DataFrame, time: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(F.date_trunc("week", time).alias("week"), *by).agg(F.count(F.lit(1)).alias("n"))

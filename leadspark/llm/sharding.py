"""Balanced label propagation: linked documents gather in few shards of equal row counts.

Linked documents see the same neighbours, so they hold one label together: a hub (a set of linked documents), or a part of a hub that
no shard could hold, is a piece that starts in the shard of its hash. Each shard keeps the largest of its pieces that its quota has places for. In
every round the other pieces ask for the places that are free then: they are laid along a line of all free places, each shard's stretch
a whole number of the largest piece that still fits somewhere, and those that lie within one shard's stretch move there. What fits
nowhere after the last round is cut over the emptiest shards, a hub after the other. Documents without links fill up, so the counts differ by one at most.

A document is linked through its hub instead of pairs, so a hub of any size costs one row a member; what reaches the driver is
one count a shard.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace, gapless_rank, spread_join, text_or_empty

SHARDS, ROUNDS = 40, 8
#: A hub is parted so that a part takes this share of a shard, as parts are dealt by hash and so of uneven size.
FULL = 0.95


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at.cast("int") + 1)


def _upto(edges: list[int], at: Column) -> Column:
    """Number of ``edges`` (ascending) at or below a value."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= at))


def running_total(rows: DataFrame, group: list[str], cell: Column, order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: sum of ``value`` up to each row within ``group``, by cells and then inside them, without bringing a group into one task."""
    parted = rows.withColumn("_cell", cell)
    sums = parted.groupBy(*group, "_cell").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parted.join(shift, [*group, "_cell"]).withColumn(out, F.col("_shift") + F.sum(value).over(within)).drop("_cell", "_shift")


def propagate(pieces: DataFrame, work: Workspace, targets: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(pieces with their shards and whether they are ``settled`` there, places left in each shard).

    ``pieces`` has hub, part, n; each counts its n rows in the shard of its hash first.
    """
    shards = len(targets)
    waiting = work.write(pieces.withColumn("shard", F.pmod(F.xxhash64("hub", "part"), F.lit(shards)).cast("int")), "pieces")
    buckets = max(1, min(4096, waiting.count() // 20_000 + 1))
    # Large pieces come first: cells go by the size's power of two, then by hash.
    cell = (63 - F.floor(F.log2("n"))) * buckets + F.pmod(F.xxhash64("hub", "part", F.lit(1)), F.lit(buckets))
    order = [F.desc("n"), F.col("hub"), F.col("part")]
    free, done = list(targets), []
    ranked = running_total(waiting, ["shard"], cell, order, "n", "total").withColumn("settled", F.col("total") <= _pick(free, F.col("shard")))
    for turn in range(rounds):
        asked = work.write(ranked.select("hub", "part", "n", "shard", "settled"), f"asked-{turn}")
        for r in asked.where("settled").groupBy("shard").agg(F.sum("n").alias("n")).collect():
            free[r["shard"]] -= r["n"]
        done.append(asked.where("settled"))
        waiting = asked.where("NOT settled")
        largest = waiting.where(F.col("n") <= max(free)).agg(F.max("n").alias("n")).first()["n"]
        if not largest or turn == rounds - 1:
            break
        by_room = sorted(range(shards), key=lambda s: -free[s])
        edges = list(accumulate(free[s] // largest * largest for s in by_room))
        laid = running_total(waiting.where(F.col("n") <= largest), [], cell, order, "n", "total").withColumn("_at", _upto(edges, F.col("total") - F.col("n")))
        fits = (F.col("_at") < shards) & (F.col("total") <= _pick(edges, F.least("_at", F.lit(shards - 1))))
        ranked = laid.withColumns({"settled": fits, "shard": F.when(fits, _pick(by_room, F.least("_at", F.lit(shards - 1))).cast("int")).otherwise(F.col("shard"))})
        ranked = ranked.drop("total", "_at").unionByName(waiting.where(F.col("n") > largest))
    for settled in done:
        waiting = waiting.unionByName(settled)
    return waiting, free


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text); documents of equal texts are linked.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is ``rows``: counts of
    two shards differ by one at most. A null text counts as empty; rows that repeat a doc_id or have none are placed
    one by one; an empty table gives an empty result; texts of any length travel as a hash and a checksum.
    """
    work = Workspace(docs.sparkSession, "shards")
    text = text_or_empty()
    nodes = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("hub"))
    nodes = work.write(nodes.withColumn("row", F.monotonically_increasing_id()), "nodes")
    hubs = work.write(nodes.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "hubs")
    total = nodes.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    room = max(1, min(targets))
    parts = F.when(F.col("n") > room, F.ceil(F.col("n") / (FULL * room))).otherwise(F.lit(1))
    linked = spread_join(nodes, hubs, ["hub"], "inner").withColumn("part", F.pmod(F.xxhash64("row"), parts))
    linked = work.write(linked, "linked")
    large = linked.where(F.col("n") > room).groupBy("hub", "part").agg(F.count(F.lit(1)).alias("n"))
    pieces = hubs.where(F.col("n") <= room).select("hub", F.lit(0).cast("long").alias("part"), "n").unionByName(large)
    pieces, free = propagate(pieces, work, targets, rounds)
    joined = spread_join(linked.drop("n"), work.write(pieces, "propagated"), ["hub", "part"], "inner")
    joined = work.write(joined, "joined")

    # Rows of pieces that fit nowhere take the free places in one line, a hub after the other, the emptiest shard first.
    by_room = sorted(range(shards), key=lambda s: -free[s])
    edges = list(accumulate(free[s] for s in by_room))
    many = F.greatest(F.lit(1), F.least(F.lit(1 << 16), F.floor(F.col("n") / 5000)))
    line = F.pmod(F.xxhash64("hub"), F.lit(1 << 13)) * (1 << 16) + F.pmod(F.xxhash64("row"), many)
    cut = gapless_rank(joined.where("NOT settled"), [], [F.col("hub"), F.col("row")], line, 1 << 29, "rank")
    cut = cut.withColumn("shard", _pick(by_room, F.least(_upto(edges, F.col("rank")), F.lit(shards - 1))).cast("int")).drop("rank")
    names = ["doc_id", "size", "text_crc32", "row", "shard"]
    alone = spread_join(nodes, hubs, ["hub"], "left_anti").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    placed = joined.where("settled").select(*names, F.lit(0).alias("alone")).unionByName(cut.select(*names, F.lit(0).alias("alone"))).unionByName(alone.select(*names, F.lit(1).alias("alone")))

    buckets = max(1, min(4096, total // (5000 * shards) + 1))
    spread = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(buckets)) + F.when(F.col("alone") == 1, buckets).otherwise(0)
    ranked = work.write(gapless_rank(placed, ["shard"], [F.col("row")], spread, 2 * buckets, "rank"), "ranked")
    have = [0] * shards
    for r in ranked.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect():
        have[r["shard"]] = r["n"]
    over = [0, *accumulate(max(0, h - t) for h, t in zip(have, targets, strict=True))][:-1]
    lack = [0, *accumulate(max(0, t - h) for h, t in zip(have, targets, strict=True))]
    surplus = F.col("rank") >= _pick(targets, F.col("shard"))
    number = F.col("rank") - _pick(targets, F.col("shard")) + _pick(over, F.col("shard"))
    out = ranked.withColumn("_g", F.when(surplus, number)).withColumn("_to", F.when(surplus, F.least(_upto(lack[1:], F.col("_g")), F.lit(shards - 1))).otherwise(F.col("shard")))
    slot = F.when(surplus, _pick(have, F.col("_to")) + F.col("_g") - _pick(lack[:-1], F.col("_to"))).otherwise(F.col("rank"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_to").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

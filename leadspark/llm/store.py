"""Shared working folders and small distributed building blocks of the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: list[str] = []


class Workspace:
    """A folder of written tables below ``spark.checkpoint.dir``.

    Writing a table cuts lineage and lets later steps survive a lost executor. A local session
    without that setting (a test) gets a temporary folder of its own; on a cluster the setting is required, as
    executors share no other folder. Tables that the result still reads stay until the session ends; the
    file system deletes the folder then.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            if not _OWN:
                _OWN.append(tempfile.mkdtemp(prefix="leadspark-"))
            base = _OWN[0]
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        fs, path = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again, and the shuffle files of finished steps."""
        for name in names:
            fs, path = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)
        # Spark's cleaner removes a shuffle once the driver has forgotten the plan that made it; the last plan is kept until another query ends.
        self.spark.sql("SELECT 1").collect()
        gc.collect()
        self.spark._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def spread_join(rows: DataFrame, counted: DataFrame, keys: list[str], how: str = "left_semi", parts: int = 64, most_hot: int = 1000) -> DataFrame:
    """Join ``rows`` with ``counted`` (keys, n: how many rows have them), a written table, on ``keys``.

    A key with over 1 / ``most_hot`` of all counted rows is dealt to ``parts`` parts, each of which gets a copy of its row
    of ``counted``. Fewer than ``most_hot`` keys can be that frequent, so naming them is a broadcast of bounded size.
    """
    limit = (counted.agg(F.sum("n").alias("n")).first()["n"] or 0) / most_hot
    hot = F.broadcast(counted.where(F.col("n") > limit).select(*keys, F.lit(True).alias("_hot")))
    part = F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(parts))).otherwise(F.lit(0)).alias("_part")
    copies = F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, keys, "left").select(*rows.columns, part)
    return left.join(counted.withColumn("_part", F.explode(copies.cast("array<bigint>"))), [*keys, "_part"], how).drop("_part")


def gapless_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, buckets: int, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2 ... within ``group``, without bringing a group into one task.

    Rows are dealt to (group, spread modulo buckets); each such cell is numbered by itself and
    shifted by the rows of the cells before it, whose counts form a table of at most groups
    times buckets rows.
    """
    cell = df.withColumn("_cell", F.pmod(spread, F.lit(buckets)).cast("int"))
    counts = cell.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*group, "_cell").orderBy(*order)
    numbered = cell.withColumn("_at", F.row_number().over(within))
    return numbered.join(shift, [*group, "_cell"]).withColumn(out, F.col("_shift") + F.col("_at") - 1).drop("_cell", "_shift", "_at")


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Smallest reachable id (``label``) of every ``id`` that a link (a, b) names.

    Every round hangs each node's larger neighbours under its smallest one and then each
    node's smaller neighbours likewise, so a chain of length n takes about log n rounds. Each
    round is a written table; only a changed-row count reaches the driver.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    # Two edge lists are equal if their numbers and two sums of hashes are, but for a chance of 2**-120 or so.
    digest = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    edges, turn = work.write(edges, f"{name}-0"), 0
    seen = digest(edges)
    while seen[0]:
        turn += 1
        around = both(edges)
        low = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = around.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        after = work.write(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        edges, before, seen = after, seen, digest(after)
        if seen == before:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label"))

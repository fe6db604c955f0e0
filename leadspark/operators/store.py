"""Tables in folders that change bucket by bucket, and look-ups and anti joins that read or move only what they need.

A table is a set of folders, one for each hash bucket of its key and write, and a manifest that names those of the current version. A change
writes new folders for the buckets it touches and then publishes the next manifest by a rename that fails if that version exists: a crash
at any moment leaves the old version or the new one, and of two writers one is told that it came second.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
#: A look-up names up to so many keys in the scan's filter; more of them are joined.
NAMED_KEYS = 1000


class VersionTaken(RuntimeError):
    """Another writer has published this version; the change has to be made again from the current state."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class TableStore:
    """Tables below one path of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # Manifests ---------------------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def manifest(self, name: str) -> dict:
        """The current version of a table: version, key, buckets, folders (bucket, folder below the table)."""
        found = [n for n in self._names(f"{self.root}/{name}/manifests") if n.startswith("v")]
        if not found:
            return {"version": 0, "key": None, "buckets": 1, "folders": []}
        fs, path = self._fs(f"{self.root}/{name}/manifests/{found[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, name: str, before: dict, **changes) -> None:
        after = {**before, **changes, "version": before["version"] + 1}
        folder = f"{self.root}/{name}/manifests"
        self._commit(self._stage(folder, after), f"{folder}/v{after['version']:010d}")

    def _stage(self, folder: str, manifest: dict) -> str:
        """A manifest that has no version's name yet."""
        path = f"{folder}/.{uuid.uuid4().hex}"
        fs, at = self._fs(path)
        stream = fs.create(at)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        return path

    def _commit(self, staged: str, final: str) -> None:
        """The moment of change: a rename that fails if the version is there."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        (fs, source), (_, target) = self._fs(staged), self._fs(final)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            if not fs.exists(target):
                raise
            fs.delete(source, False)
            raise VersionTaken(f"{final} exists already") from error

    # Data --------------------------------------------------------------------------------------------

    def _write(self, name: str, rows: DataFrame, key: str | None, buckets: int) -> list[list]:
        """Write rows to a new folder, one part of it a bucket and sorted by key there; returns [bucket, folder] pairs."""
        folder = f"data/{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{folder}"
        if key is None:
            rows.write.parquet(path)
            return [[0, folder]]
        keyed = rows.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket").sortWithinPartitions("_bucket", key)
        keyed.write.option(f"parquet.bloom.filter.enabled#{key}", "true").partitionBy("_bucket").parquet(path)
        return [[int(n.partition("=")[2]), f"{folder}/{n}"] for n in self._names(path) if n.startswith("_bucket=")]

    def _scan(self, name: str, schema: str, folders: Sequence[Sequence]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for _, f in folders])

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version; a table that was never written is empty. It stays readable until it is vacuumed."""
        return self._scan(name, schema, self.manifest(name)["folders"])

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows without reading any; in a keyed table they join the buckets of their keys."""
        before = self.manifest(name)
        self._publish(name, before, folders=before["folders"] + self._write(name, rows, before["key"], before["buckets"]))

    def swap(self, name: str, state: DataFrame, key: str | None = None, buckets: int = BUCKETS) -> None:
        """Replace the whole table; with a key it is laid out in buckets."""
        before = self.manifest(name)
        self._publish(name, before, key=key, buckets=buckets if key else 1, folders=self._write(name, state, key, buckets))

    def change(self, name: str, schema: str, batch: DataFrame, to: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replace the rows of just those buckets that hold keys of ``batch`` by ``to(their rows, batch)``; returns the buckets.

        ``to`` may drop, change and add rows of the batch's keys; all others it has to hand on. Files of other buckets stay as they are.
        """
        before = self.manifest(name)
        key, buckets = before["key"], before["buckets"]
        if key is None:
            raise ValueError(f"{name} has no key: swap it in with one first")
        # At most as many numbers as the table has buckets.
        touched = sorted(r["b"] for r in batch.select(bucket_of(key, buckets).alias("b")).distinct().collect())
        if not touched:
            return []
        old = self._scan(name, schema, [f for f in before["folders"] if f[0] in touched])
        new = self._write(name, to(old, batch), key, buckets)
        if {b for b, _ in new} - set(touched):
            raise ValueError("the change made rows of keys that the batch does not have")
        self._publish(name, before, folders=[f for f in before["folders"] if f[0] not in touched] + new)
        return touched

    def find(self, name: str, schema: str, wanted: DataFrame, key: str, most: int = NAMED_KEYS) -> DataFrame:
        """The asked keys with their rows, null where a key is missing.

        Up to ``most`` different keys are named in the filter of a scan of their buckets alone, where sorted files and bloom filters
        skip what cannot hold them; more keys are joined.
        """
        now, asked = self.manifest(name), wanted.select(key)
        some = asked.distinct().where(F.col(key).isNotNull()).limit(most + 1).withColumn("_b", bucket_of(key, now["buckets"])).collect()
        if now["key"] != key or len(some) > most:
            return asked.join(self.read(name, schema), key, "left")
        held = {r["_b"] for r in some}
        rows = self._scan(name, schema, [f for f in now["folders"] if f[0] in held])
        return asked.join(rows.where(F.col(key).isin([r[key] for r in some])), key, "left")

    def clear(self, *names: str) -> None:
        for name in names:
            before = self.manifest(name)
            if before["folders"]:
                self._publish(name, before, folders=[])

    def vacuum(self, name: str, keep: int = 1) -> None:
        """Delete manifests but the newest ``keep`` and folders that those do not name, leftovers of crashes too; not while another writer is at work."""
        path = f"{self.root}/{name}"
        manifests = [n for n in self._names(f"{path}/manifests") if n.startswith("v")]
        named = set()
        for n in manifests[-keep:]:
            fs, at = self._fs(f"{path}/manifests/{n}")
            stream = fs.open(at)
            named |= {f for _, f in json.loads(bytes(stream.readAllBytes()).decode())["folders"]}
            stream.close()
        gone = [f"manifests/{n}" for n in self._names(f"{path}/manifests") if n not in manifests[-keep:]]
        for write in self._names(f"{path}/data"):
            whole = f"data/{write}"
            parts = [f"{whole}/{n}" for n in self._names(f"{path}/{whole}") if n.startswith("_bucket=")]
            if whole not in named:
                gone += [p for p in parts if p not in named] if named & set(parts) else [whole]
        for each in gone:
            fs, at = self._fs(f"{path}/{each}")
            fs.delete(at, True)


def write_bucketed(rows: DataFrame, table: str, key: str, path: str, buckets: int, mode: str = "errorifexists") -> DataFrame:
    """Write a catalog table that Spark knows to be bucketed and sorted by ``key``; joins on the key do not move it.

    ``buckets`` should not be below ``spark.sql.shuffle.partitions``, or Spark may deal the table out anew for more parallel tasks.
    """
    rows.repartition(buckets, key).write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)

"""Named sources of project records: frames, and collectors read through Spark's Python data source API.

A ``Sources`` object holds what it was given and nothing else, so two of them never see each other's sources.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from leadspark import schemas

#: What a source did not say about a record stays null; what is not in the schema goes.
COLUMNS = [c.split()[0] for c in schemas.PROJECT.split(", ")]


@dataclass
class Bounds:
    """What a query asks of a source, as far as its filters say so: days (both ends inside) and external ids."""

    since: dt.date | None = None
    until: dt.date | None = None
    external_ids: frozenset[str] | None = None

    def takes(self, condition: Filter) -> bool:
        """Narrow the bounds by a condition; whether it is one of those that they can express."""
        name, value = condition.attribute[0] if len(getattr(condition, "attribute", ())) == 1 else None, getattr(condition, "value", None)
        if name == "issued_at" and isinstance(value, dt.date):
            if isinstance(condition, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.since = max(self.since or value, value)
            if isinstance(condition, (LessThan, LessThanOrEqual, EqualTo)):
                self.until = min(self.until or value, value)
            return isinstance(condition, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual))
        if name == "external_id" and isinstance(condition, (EqualTo, In)):
            asked = frozenset([value] if isinstance(condition, EqualTo) else value)
            self.external_ids = asked if self.external_ids is None else self.external_ids & asked
            return True
        return False


class Collector:
    """One source of records. Subclasses are pickled to the executors, so they hold settings, not connections.

    ``partitions`` names independent parts of what the bounds ask for (a page, a day, a file), each of which one task
    reads by ``read``. A collector may return more than asked for: Spark applies all conditions once more.
    """

    name = "collector"

    def partitions(self, bounds: Bounds) -> Sequence[Any]:
        raise NotImplementedError

    def read(self, part: Any, bounds: Bounds) -> Iterator[dict[str, Any]]:
        raise NotImplementedError


class _Part(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, collector: Collector, schema: StructType, batch_rows: int) -> None:
        self.collector, self.schema, self.batch_rows, self.bounds = collector, schema, batch_rows, Bounds()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for condition in filters:
            self.bounds.takes(condition)
            yield condition  # bounds are coarser than conditions

    def partitions(self) -> list[InputPartition]:
        return [_Part(p) for p in self.collector.partitions(self.bounds)]

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        """Arrow batches of the schema; a record without a field has null there. Spark reads no part as None."""
        if partition is None:
            return
        arrow, names = to_arrow_schema(self.schema), self.schema.fieldNames()
        waiting: list[dict[str, Any]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in waiting], t.type) for n, t in zip(names, arrow, strict=True)], schema=arrow)

        for record in self.collector.read(partition.value, self.bounds):
            waiting.append(record)
            if len(waiting) >= self.batch_rows:
                yield batch()
                waiting = []
        if waiting:
            yield batch()


def data_source(collector: Collector, schema: str = schemas.PROJECT, batch_rows: int = 5000) -> type[DataSource]:
    """A data source class over one collector. Its short name follows from the collector's name and settings, so other collectors never replace it."""
    digest = hashlib.sha256(repr((type(collector).__qualname__, collector.name, sorted(vars(collector).items()))).encode()).hexdigest()[:12]
    short, parsed = f"leadspark_{collector.name}_{digest}", _parse_datatype_string(schema)

    class Collected(DataSource):
        @classmethod
        def name(cls) -> str:
            return short

        def schema(self) -> StructType:
            return parsed

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(collector, schema, batch_rows)

    return Collected


def collect(spark: SparkSession, collector: Collector, schema: str = schemas.PROJECT) -> DataFrame:
    """The records of a collector as a table; conditions on issued_at and external_id narrow what it is asked for."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    source = data_source(collector, schema)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).load()


class Sources:
    """Sources by name, in the order they were added."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._named: dict[str, DataFrame | Collector] = {}

    def add(self, name: str, source: DataFrame | Collector) -> Sources:
        if name in self._named:
            raise ValueError(f"there is a source {name} already")
        self._named[name] = source
        return self

    @property
    def names(self) -> list[str]:
        return list(self._named)

    def read(self, name: str) -> DataFrame:
        """One source in the project schema; columns it lacks are null, others go."""
        source = self._named[name]
        frame = collect(self.spark, source) if isinstance(source, Collector) else source
        return self.spark.createDataFrame([], schemas.PROJECT).unionByName(frame.select([c for c in frame.columns if c in COLUMNS]), allowMissingColumns=True)

    def union(self, enabled: dict[str, bool] | None = None) -> DataFrame:
        """All sources that are not switched off, in one table of the project schema."""
        frames = [self.read(n) for n in self._named if (enabled or {}).get(n, True)]
        return reduce(DataFrame.unionByName, frames, self.spark.createDataFrame([], schemas.PROJECT))


class PageFiles(Collector):
    """Records in JSON lines in folders ``day=YYYY-MM-DD`` below a path of any file system that Arrow reads.

    A part is one file; days out of the bounds are not listed. Lines that are no JSON objects, or whose fields have
    other types, come as records with their text in ``raw_data`` and the type ``bad``, so one of them stops nothing.
    """

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path

    def _system(self):
        from pyarrow import fs

        if self.path.startswith("file:") or "://" not in self.path:
            return fs.LocalFileSystem(), re.sub("^file:/+", "/", self.path)
        return fs.FileSystem.from_uri(self.path)

    def partitions(self, bounds: Bounds) -> Sequence[str]:
        from pyarrow import fs

        system, root = self._system()
        found = []
        for folder in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            label, _, day = folder.base_name.partition("=")
            if label != "day" or folder.type != fs.FileType.Directory:
                continue
            at = None if day.startswith("__") else dt.date.fromisoformat(day)
            outside = at is not None and ((bounds.since and at < bounds.since) or (bounds.until and at > bounds.until))
            # A record without a day satisfies no condition on it.
            if outside or (at is None and (bounds.since or bounds.until)):
                continue
            found += [f.path for f in system.get_file_info(fs.FileSelector(folder.path)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return sorted(found)

    def read(self, part: str, bounds: Bounds) -> Iterator[dict[str, Any]]:
        import io
        import json
        import os

        day = os.path.basename(os.path.dirname(part)).partition("=")[2]
        at = None if day.startswith("__") else dt.date.fromisoformat(day)
        system, _ = self._system()
        texts = ("source", "external_id", "title", "location", "description", "source_url")
        with system.open_input_stream(part, compression="detect") as raw:
            for line in io.BufferedReader(raw):
                try:
                    record = json.loads(line)
                    good = isinstance(record, dict) and all(isinstance(record.get(t), (str, type(None))) for t in texts) and isinstance(record.get("value"), (int, type(None)))
                except ValueError:
                    good = False
                if not good:
                    yield {"source": self.name, "issued_at": at, "raw_data": line.rstrip(b"\n"), "raw_type": "bad"}
                elif bounds.external_ids is None or record.get("external_id") in bounds.external_ids:
                    yield {**{k: record.get(k) for k in (*texts, "value")}, "issued_at": at}

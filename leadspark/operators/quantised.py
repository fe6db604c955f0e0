"""Nearest neighbours through product quantisation: a few bytes a vector are searched, and exact vectors read for the best of them alone.

A vector is cut into stretches, and each is replaced by the number of the nearest of up to 256 centres of that stretch. What a query and
a code have in common is the sum over stretches of the query's products with the centres, its distance tables. The best few hundred by these sums are scored exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadspark.operators.store import TableStore
from leadspark.operators.vectors import matrix, nearest_centres, stretches, units

CENTRES, STRETCH = 256, 4
#: Rows that the centres are fitted on, rows of codes a cell of the search holds, queries a cell holds.
FIT_ROWS, CELL_CODES, CELL_QUERIES = 20_000, 200_000, 2048


def _fit_stretch(rounds: int, centres: int):
    """Arrow task over one stretch of all fitted vectors: its centres by Lloyd's rounds from evenly spaced rows."""

    def fit(rows: pa.Table) -> pa.Table:
        x, stretch = matrix(rows.column("part")), rows.column("stretch")[0].as_py()
        x = x[np.lexsort(x.T)]
        own = np.unique(x[np.linspace(0, len(x) - 1, min(centres, len(x))).astype(int)], axis=0)
        for _ in range(rounds):
            near = nearest_centres(x, own)[:, 0]
            size = np.bincount(near, minlength=len(own))
            sums = np.stack([np.bincount(near, x[:, d], len(own)) for d in range(x.shape[1])], axis=1)
            own = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], own)
        return pa.table({"stretch": pa.array([stretch] * len(own), pa.int32()), "number": pa.array(range(len(own)), pa.int32()), "centre": pa.array(own.tolist(), pa.list_(pa.float64()))})

    return fit


class ProductIndex:
    """Codes of vectors in a store, with a list of later changes that is merged when it outgrows a share of them.

    The centres are fitted once, on at most ``fit_rows`` rows; every row is coded. An update writes codes of new and changed vectors and marks of deleted ones to
    a table of changes, the latest of which holds for an id. Vectors without length are not indexed.
    """

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint", id_col: str = "vec_id", vec: str = "embedding") -> None:
        self.spark, self.store, self.id_col, self.vec, self.id_type = spark, TableStore(spark, root), id_col, vec, id_type
        self.base_schema, self.change_schema = f"id {id_type}, code binary", f"turn bigint, id {id_type}, code binary"

    def build(self, vectors: DataFrame, fit_rows: int = FIT_ROWS, stretch: int = STRETCH, centres: int = CENTRES, rounds: int = 8) -> ProductIndex:
        sample = vectors.where(F.size(self.vec) > 0).orderBy(F.xxhash64(self.id_col), self.id_col).limit(fit_rows)
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / stretch).cast("int")), lambda i: F.slice("v", i * stretch + 1, stretch))
        cut = _with_units(sample, self.id_col, self.vec, self.id_type).select(F.posexplode(parts).alias("stretch", "part"))
        self.store.swap("centres", cut.groupBy("stretch").applyInArrow(_fit_stretch(rounds, centres), "stretch int, number int, centre array<double>"))
        self.store.swap("codes", self._coded(vectors))
        self.store.clear("changes")
        return self

    def centres(self) -> list[np.ndarray]:
        """One matrix of centres a stretch: as many numbers as a vector has, 256 times."""
        rows = self.store.read("centres", "stretch int, number int, centre array<double>").orderBy("stretch", "number").collect()
        return [np.array([r["centre"] for r in rows if r["stretch"] == s]) for s in range(rows[-1]["stretch"] + 1)] if rows else []

    def _coded(self, vectors: DataFrame) -> DataFrame:
        centres = self.centres()

        def code(batches):
            for batch in _unit_batches(batches):
                x, at, out = matrix(pa.chunked_array([batch.column(1)])), 0, []
                for own in centres:
                    part = x[:, at : at + own.shape[1]] if len(x) else np.zeros((0, own.shape[1]))
                    out.append(nearest_centres(part, own)[:, 0].astype(np.uint8))
                    at += own.shape[1]
                codes = np.stack(out, axis=1) if len(x) else np.zeros((0, len(centres)), np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "code"])

        return _with_length(vectors, self.id_col, self.vec).mapInArrow(code, self.base_schema)

    # Upkeep ------------------------------------------------------------------------------------------

    def update(self, vectors: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Insert or replace ``vectors`` and drop the ids of ``deleted``; nothing is fitted or coded anew but these."""
        turn = self.store.manifest("changes")["version"] + 1
        for rows in (None if vectors is None else self._coded(vectors), None if deleted is None else deleted.select(F.col(self.id_col).alias("id"), F.lit(None).cast("binary").alias("code"))):
            if rows is not None:
                self.store.append("changes", rows.select(F.lit(turn).cast("bigint").alias("turn"), "id", "code"))

    def rows(self) -> DataFrame:
        """id and code of everything that is indexed now."""
        base, changes = self.store.read("codes", self.base_schema), self.store.read("changes", self.change_schema)
        last = changes.groupBy("id").agg(F.max_by("code", F.struct("turn", F.col("code").isNotNull())).alias("code"))
        return base.join(last.select("id"), "id", "left_anti").unionByName(last.where("code IS NOT NULL"))

    def merge(self, share: float = 0.2) -> bool:
        """Fold the changes into the codes if they are more than ``share`` of them; a crash in between leaves changes that change nothing."""
        if self.store.read("changes", self.change_schema).count() <= share * self.store.read("codes", self.base_schema).count():
            return False
        self.store.swap("codes", self.rows())
        self.store.clear("changes")
        return True

    # Search ------------------------------------------------------------------------------------------

    def candidates(self, queries: DataFrame, many: int) -> DataFrame:
        """query_id, q, neighbor_id: the ``many`` best codes of each query by its distance tables, itself excepted.

        Blocks of queries meet blocks of codes; a cell keeps the best of each query before the shuffle.
        """
        codes = self.rows()
        across, down = max(1, -(-queries.count() // CELL_QUERIES)), max(1, -(-codes.count() // CELL_CODES))
        asked = _with_units(queries, self.id_col, self.vec, self.id_type).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(across))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        rows = codes.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(down)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))
        found = asked.groupBy("qb", "rb").cogroup(rows.groupBy("qb", "rb")).applyInArrow(_nearest_codes(self.centres(), many), f"query_id {self.id_type}, neighbor_id {self.id_type}, estimate double")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "neighbor_id"))
        return found.withColumn("place", place).where(F.col("place") <= many).select("query_id", "neighbor_id")

    def search(self, vectors: DataFrame, queries: DataFrame, k: int, rerank: int = 200) -> DataFrame:
        """query_id, neighbor_id, similarity, rank: the k best of the ``rerank`` candidates of each query by exact cosine.

        ``vectors`` are the current ones; only rows that are candidates of some query are joined.
        """
        found = self.candidates(queries, rerank)
        exact = _with_units(vectors, self.id_col, self.vec, self.id_type).select(F.col("id").alias("neighbor_id"), "v")
        asked = _with_units(queries, self.id_col, self.vec, self.id_type).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        both = found.join(exact, "neighbor_id").join(asked, "query_id").select("query_id", "neighbor_id", "q", "v")
        scored = both.mapInArrow(_products, f"query_id {self.id_type}, neighbor_id {self.id_type}, similarity double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _unit_batches(batches):
    """id and unit vector v of the rows that have a length."""
    for batch in batches:
        v, whole = units(matrix(pa.chunked_array([batch.column(1)])))
        rows = v[whole]
        offsets = pa.array(np.arange(len(rows) + 1) * (rows.shape[1] if len(rows) else 0), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(whole)), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.float64()))], ["id", "v"])


def _with_length(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    return vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).where("size(v) > 0")


def _with_units(vectors: DataFrame, id_col: str, vec: str, id_type: str) -> DataFrame:
    return _with_length(vectors, id_col, vec).mapInArrow(_unit_batches, f"id {id_type}, v array<double>")


def _nearest_codes(centres: list[np.ndarray], many: int):
    """Arrow task over cells of (queries, codes): the best codes of each query."""

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": left.column("query_id").slice(0, 0), "neighbor_id": right.column("id").slice(0, 0), "estimate": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return none
        asked, other = left.column("query_id").to_numpy(), right.column("id").to_numpy()
        q, code = matrix(left.column("q")), np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(other), -1)
        at, tables = 0, []
        for own in centres:
            tables.append(q[:, at : at + own.shape[1]] @ own.T)
            at += own.shape[1]
        parts = []
        for part in stretches(len(asked), len(other)):
            ids = asked[part]
            score = np.zeros((len(ids), len(other)))
            for s, table in enumerate(tables):
                score += table[part].take(code[:, s], axis=1)
            score[ids[:, None] == other[None, :]] = -np.inf
            n = min(many, score.shape[1])
            top = np.argpartition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n :]
            value = np.take_along_axis(score, top, axis=1).ravel()
            keep = np.isfinite(value)
            parts.append((np.repeat(ids, n)[keep], other[top.ravel()][keep], value[keep]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.table({"query_id": pa.array(columns[0], none.schema.types[0]), "neighbor_id": pa.array(columns[1], none.schema.types[1]), "estimate": columns[2]})

    return best


def _products(batches):
    """Exact products of the candidates' vectors with their queries'."""
    for batch in batches:
        q, v = (matrix(pa.chunked_array([batch.column(i)])) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((q * v).sum(axis=1) if len(q) else np.zeros(0))], ["query_id", "neighbor_id", "similarity"])

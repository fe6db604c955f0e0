"""Exact and cluster-pruned nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.columns import cosine


def unit(c: Column | str) -> Column:
    """Vector over its norm in doubles; null for an empty or zero vector."""
    v = F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector: a scan that keeps k rows a task."""
    q = F.lit([float(x) for x in query])
    return vectors.select(id_col, cosine(vec, q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def matrix(column):
    """A column of number lists of one length, none null, as rows of doubles."""
    import numpy as np

    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def units(vectors):
    """(rows over their norms, whether there is one); a zero row stays zero."""
    import numpy as np

    norm = np.sqrt((vectors**2).sum(axis=1))
    return vectors / np.where(norm > 0, norm, 1.0)[:, None], norm > 0


#: Scores of rows against others that a task makes at once, 8 MB of doubles.
SCORES = 1 << 20


def stretches(rows: int, others: int) -> list[slice]:
    """Cuts of ``rows`` so small that the scores of one against all ``others`` are within SCORES."""
    step = max(1, SCORES // max(1, others))
    return [slice(i, i + step) for i in range(0, rows, step)]


def nearest_centres(x, centres, n: int = 1):
    """Numbers of the ``n`` nearest centres of each row, the lower of equal ones first."""
    import numpy as np

    out, size = np.zeros((len(x), min(n, len(centres))), np.int64), (centres**2).sum(axis=1)
    for at in stretches(len(x), len(centres)):
        far = size[None, :] - 2 * x[at] @ centres.T
        out[at] = np.argmin(far, axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
    return out


def _block_scores(k: int, kind: str):
    """Arrow task over cells of (queries, vectors): the k best neighbours of each query in the cell."""
    import numpy as np
    import pyarrow as pa

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "neighbor_id", "similarity"]
        if not len(left) or not len(right):
            return pa.Table.from_arrays([left.column("query_id").slice(0, 0), right.column("neighbor_id").slice(0, 0), pa.array([], pa.float64())], names)
        (q, some), (v, whole) = units(matrix(left.column("q"))), units(matrix(right.column("v")))
        asked, other = left.column("query_id").to_numpy(), right.column("neighbor_id").to_numpy()
        parts = []
        for at_once in stretches(len(asked), len(other)):
            ids = asked[at_once]
            score = q[at_once] @ v.T
            score[(ids[:, None] == other[None, :]) | ~some[at_once, None] | ~whole[None, :]] = -np.inf
            # Only those that reach the k-th best score are sorted, ties by id.
            if k < score.shape[1]:
                least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
                row, at = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            else:
                row, at = np.nonzero(np.isfinite(score))
            order = np.lexsort((other[at], -score[row, at], row))
            row, at = row[order], at[order]
            first = np.searchsorted(row, np.arange(len(ids)))
            keep = np.arange(len(row)) - first[row] < k
            parts.append((ids[row[keep]], other[at[keep]], score[row[keep], at[keep]]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.Table.from_arrays([pa.array(columns[0], left.column("query_id").type), pa.array(columns[1], right.column("neighbor_id").type), pa.array(columns[2], pa.float64())], names)

    return best, f"query_id {kind}, neighbor_id {kind}, similarity double"


def _best_of_cells(asked: DataFrame, rows: DataFrame, cell: list[str], k: int, kind: str) -> DataFrame:
    """Exact k best over all cells in which a query meets vectors; a cell is bounded on both sides."""
    best, schema = _block_scores(k, kind)
    found = asked.groupBy(*cell).cogroup(rows.groupBy(*cell)).applyInArrow(best, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_each(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec: str = "embedding", block: int = 2048, rows_per_cell: int = 20_000) -> DataFrame:
    """query_id, neighbor_id, similarity, rank of the k nearest others of every query vector.

    A stated query set meets all rows in cells of about ``block`` queries by ``rows_per_cell`` vectors: both tables are dealt to blocks, each
    query block is copied to every vector block, and a cell keeps the k best of each query before the shuffle. Nothing passes
    through the driver but two counts.
    """
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("q")).where("size(q) > 0")
    rows = vectors.select(F.col(id_col).alias("neighbor_id"), F.col(vec).alias("v")).where("size(v) > 0")
    n_asked, n_rows = queries.count(), vectors.count()
    across, down = max(1, -(-n_asked // block)), max(1, -(-n_rows // rows_per_cell))
    asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(across))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint"))))
    rows = rows.withColumn("rb", F.pmod(F.xxhash64("neighbor_id"), F.lit(down))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))
    return _best_of_cells(asked, rows, ["qb", "rb"], k, queries.schema[id_col].dataType.simpleString())


class ClusterIndex:
    """Inverted lists around k-means centres of unit vectors.

    The fit sees at most ``fit_rows`` rows; every row is in a list. The number of lists grows with the root of
    the rows. Lists are dealt to parts of bounded size, so a hot list is many cells; a query meets every part of its lists. Queries are dealt to
    blocks, as most of them look into the same list where vectors have no clusters.
    """

    def __init__(self, vectors: DataFrame, lists: int | None = None, fit_rows: int = 50_000, seed: int = 7, id_col: str = "vec_id", vec: str = "embedding", rows_per_cell: int = 5_000) -> None:
        import numpy as np

        self.id_col, self.kind = id_col, vectors.schema[id_col].dataType.simpleString()
        rows = vectors.select(F.col(id_col).alias("neighbor_id"), unit(vec).alias("v")).where("v is not null")
        total = rows.count()
        self.lists = lists or max(1, min(4096, round(total**0.5)))
        sample = rows.orderBy(F.xxhash64("neighbor_id"), "neighbor_id").limit(fit_rows).withColumn("f", array_to_vector("v"))
        model = KMeans(k=self.lists, seed=seed, featuresCol="f", maxIter=5, initMode="random").fit(sample)
        self.centres = np.array(model.clusterCenters())
        self.parts = max(1, -(-total // (rows_per_cell * self.lists)))
        self.rows = self._listed(rows, "v", 1).withColumn("part", F.pmod(F.xxhash64("neighbor_id"), F.lit(self.parts)))

    def _listed(self, rows: DataFrame, c: str, n: int) -> DataFrame:
        """Rows once for each of their ``n`` nearest lists."""
        centres = self.centres

        def near(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                # What is handed on at once has as many numbers as the scores it comes from.
                for at in stretches(batch.num_rows, len(centres)):
                    some = batch.slice(at.start, at.stop - at.start)
                    found = nearest_centres(matrix(pa.chunked_array([some.column(c)])), centres, n)
                    offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], [*some.schema.names, "near"])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", near array<bigint>"
        return rows.mapInArrow(near, schema).withColumn("list", F.explode("near")).drop("near")

    def search(self, queries: DataFrame, k: int, probe: int = 3, vec: str = "embedding", block: int = 16_384) -> DataFrame:
        """query_id, neighbor_id, similarity, rank from the ``probe`` nearest lists, scored exactly."""
        asked = queries.select(F.col(self.id_col).alias("query_id"), unit(vec).alias("q")).where("q is not null")
        asked = self._listed(asked, "q", probe).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.parts - 1).cast("bigint"))))
        across = max(1, -(-queries.count() // block))
        asked = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(across)))
        rows = self.rows.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint"))))
        return _best_of_cells(asked, rows, ["list", "part", "qb"], k, self.kind)

    def share_scanned(self, queries: DataFrame, probe: int, vec: str = "embedding") -> DataFrame:
        """One row: mean share of all vectors that a query with ``probe`` lists is scored against."""
        sizes = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
        asked = self._listed(queries.select(F.col(self.id_col).alias("query_id"), unit(vec).alias("q")).where("q is not null"), "q", probe)
        total = self.rows.agg(F.count(F.lit(1)).alias("total"))
        met = asked.join(sizes, "list").groupBy("query_id").agg(F.sum("n").alias("n"))
        return met.crossJoin(F.broadcast(total)).agg(F.avg(F.col("n") / F.col("total")).alias("share_scanned"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found."""
    hits = exact.select("query_id", "neighbor_id").join(found.select("query_id", "neighbor_id").withColumn("hit", F.lit(1)), ["query_id", "neighbor_id"], "left")
    return hits.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"), F.count(F.lit(1)).alias("neighbours"))


def cross_source_pairs(found: DataFrame, sources: DataFrame, least: float = 0.95) -> DataFrame:
    """Neighbour pairs of different sources at or above a similarity; sources has id and source."""
    a = sources.select(F.col("id").alias("query_id"), F.col("source").alias("query_source"))
    b = sources.select(F.col("id").alias("neighbor_id"), F.col("source").alias("neighbor_source"))
    return found.where(F.col("similarity") > least).join(a, "query_id").join(b, "neighbor_id").where("query_source <> neighbor_source")

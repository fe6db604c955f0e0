import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from leadspark.operators import vectors
from leadspark.operators.quantised import ProductIndex, _nearest_codes

SF = "/root/testdata/sf0.01/embeddings.parquet"


def found(df):
    return sorted((r["query_id"], r["neighbor_id"], r["rank"], round(r["similarity"], 9)) for r in df.collect())


def test_search_finds_nine_in_ten_and_scores_exactly(spark, tmp_path):
    rows = spark.read.parquet(SF)
    asked = rows.where("vec_id % 20 = 0")
    index = ProductIndex(spark, str(tmp_path)).build(rows)
    got, exact = index.search(rows, asked, 10, rerank=48), vectors.nearest_each(rows, asked, 10)
    assert vectors.recall(got, exact).first()["recall"] >= 0.9
    both = got.join(exact.withColumnRenamed("similarity", "true"), ["query_id", "neighbor_id"])
    assert both.where(F.abs(F.col("similarity") - F.col("true")) > 1e-9).count() == 0
    assert found(index.search(rows, asked, 10, rerank=500)) == found(exact)
    most = index.candidates(asked, 48).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert most == 48 < rows.count() / 10


def test_estimates_are_products_with_the_centres(spark, tmp_path):
    rows = spark.read.parquet(SF).limit(60)
    index = ProductIndex(spark, str(tmp_path)).build(rows, centres=8)
    centres = index.centres()
    assert len(centres) == 16 and all(c.shape[1] == 4 and len(c) <= 8 for c in centres)
    raw = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    for r in index.rows().collect():
        v = raw[r["id"]] / np.linalg.norm(raw[r["id"]])
        for s, own in enumerate(centres):
            far = ((v[4 * s : 4 * s + 4] - own) ** 2).sum(axis=1)
            assert far[r["code"][s]] <= far.min() + 1e-12


def test_upkeep_equals_a_rebuilt_index(spark, tmp_path):
    """After an upsert of a tenth and deletions, search equals that over all current rows coded anew, before and after the merge."""
    rows = spark.read.parquet(SF)
    index = ProductIndex(spark, f"{tmp_path}/a").build(rows.where("vec_id < 450"))
    changed = rows.where("vec_id >= 400").withColumn("embedding", F.reverse("embedding"))
    index.update(changed.where("vec_id < 480"))
    index.update(changed.where("vec_id >= 480"), rows.where("vec_id IN (3, 5, 490)"))
    index.update(changed.where("vec_id = 490"))
    index.update(deleted=rows.where("vec_id = 7"))
    now = rows.where("vec_id < 400 AND vec_id NOT IN (3, 5, 7)").unionByName(changed)
    whole = index._coded(now)
    same = lambda: sorted((r["id"], bytes(r["code"])) for r in index.rows().collect()) == sorted((r["id"], bytes(r["code"])) for r in whole.collect())
    asked = now.where("vec_id % 25 = 0")
    assert same()
    before = found(index.search(now, asked, 5, 40))
    assert not index.merge(share=0.5) and index.merge(share=0.1)
    assert same() and found(index.search(now, asked, 5, 40)) == before and index.store.read("changes", index.change_schema).count() == 0


def test_a_cell_makes_few_scores_at_once():
    """Queries against a full cell of codes take memory for a few of them at a time, and the best codes stay the same."""
    rnd = np.random.default_rng(4)
    n, many = 120_000, 50
    centres = [rnd.standard_normal((16, 4)) for _ in range(2)]
    q, code = rnd.standard_normal((64, 8)), rnd.integers(0, 16, (n, 2)).astype(np.uint8)
    left = pa.table({"query_id": np.arange(64), "q": pa.array(list(q), pa.list_(pa.float64()))})
    right = pa.table({"id": np.arange(n), "code": pa.array([c.tobytes() for c in code], pa.binary())})
    tracemalloc.start()
    got = _nearest_codes(centres, many)(left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 64 * n * 8
    score = sum((q[:, 4 * s : 4 * s + 4] @ own.T)[:, code[:, s]] for s, own in enumerate(centres))
    score[np.arange(64), np.arange(64)] = -np.inf
    want = -np.sort(-score, axis=1)[:, :many]
    found = np.array(got.column("estimate")).reshape(64, many)
    assert np.allclose(-np.sort(-found, axis=1), want) and len(set(zip(got.column("query_id").to_pylist(), got.column("neighbor_id").to_pylist(), strict=True))) == 64 * many


def test_rows_without_length_and_an_empty_table(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, []), (4, None), (5, [2.0, 0.1])], "vec_id bigint, embedding array<float>")
    index = ProductIndex(spark, f"{tmp_path}/a").build(rows)
    assert found(index.search(rows, rows, 3)) == [(1, 5, 1, 0.998752339), (5, 1, 1, 0.998752339)]
    empty = ProductIndex(spark, f"{tmp_path}/b").build(rows.where("false"))
    assert empty.rows().count() == 0 and found(empty.search(rows, rows, 3)) == []

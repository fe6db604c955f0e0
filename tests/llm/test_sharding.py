import functools
import itertools
import random
import zlib
from collections import Counter, defaultdict

import pytest

from leadspark.llm.sharding import balanced_shards
from tests.llm.fixtures import awkward_docs, empty_docs


def check(docs, shards):
    got = balanced_shards(docs, shards).collect()
    text = defaultdict(set)
    for r in docs.collect():
        text[r["doc_id"]].add((r["text"] or "").encode())
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert (r["size"], r["text_crc32"]) in {(len(t) + 16, zlib.crc32(t)) for t in text[r["doc_id"]]}
        assert r["law"] == "rows" and r["grown_shard"] is None
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and max(slots) < shards
    return got, text


def test_rows_law_and_groups(spark):
    check(awkward_docs(spark, 70), 8)
    check(awkward_docs(spark, 5), 40)


def test_few_groups_are_cut(spark):
    got, text = check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 40)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"], r["size"]].add(r["shard"])
    groups = Counter((r["text_crc32"], r["size"]) for r in got)
    cut = sum(len(where[g]) > 1 for g, n in groups.items() if n > 1)
    assert cut <= 2


def test_hot_group_fills_whole_shards(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(900)], "doc_id long, text string")
    got, _ = check(docs, 10)
    assert len({r["shard"] for r in got if r["size"] == 20 and r["doc_id"] % 3 == 0}) <= 5


def test_empty_table(spark):
    assert balanced_shards(empty_docs(spark)).collect() == []


def spread_of(spark, groups, of, alone, shards):
    """Mean number of shards that a group of equal texts lies in."""
    rows = [(g * of + i, f"group {g}") for g in range(groups) for i in range(of)] + [(10**6 + i, f"alone {i}") for i in range(alone)]
    got, text = check(spark.createDataFrame(rows, "doc_id long, text string"), shards)
    where = defaultdict(set)
    for r in got:
        if r["doc_id"] < 10**6:
            where[r["doc_id"] // of].add(r["shard"])
    return sum(map(len, where.values())) / groups


@pytest.mark.parametrize(
    ("groups", "of", "alone", "most"),
    [(50, 40, 0, 2.0), (40, 40, 400, 1.1), (1000, 2, 0, 1.1), (25, 40, 1000, 1.1)],
    ids=["all linked, more groups than shards", "four fifths linked", "all in pairs", "half linked"],
)
def test_groups_stay_together_when_most_rows_are_linked(spark, groups, of, alone, most):
    assert spread_of(spark, groups, of, alone, 40) <= most


def fewest_shards(sizes, shards):
    """Fewest (group, shard) incidences over all ways to fill equal shards, by search over whole and cut groups."""
    room = -(-sum(sizes) // shards)

    @functools.cache
    def best(i, free):
        if i == len(sizes):
            return 0
        out = []
        for takes in itertools.product(*[range(min(f, sizes[i]) + 1) for f in free]):
            if sum(takes) == sizes[i]:
                out.append(sum(t > 0 for t in takes) + best(i + 1, tuple(sorted(f - t for f, t in zip(free, takes, strict=True)))))
        return min(out, default=10**6)

    return best(0, (room,) * shards)


def test_small_cases_are_near_the_best_packing(spark):
    """Against brute force over all packings: at most one more cut for every two groups, none where all groups fit whole by size."""
    rnd = random.Random(4)
    for _ in range(4):
        shards = 3
        sizes = [rnd.randrange(2, 6) for _ in range(6)]
        sizes[-1] += -sum(sizes) % shards
        rows = [(g * 100 + i, f"group {g}") for g, n in enumerate(sizes) for i in range(n)]
        got, _ = check(spark.createDataFrame(rows, "doc_id long, text string"), shards)
        met = len({(r["doc_id"] // 100, r["shard"]) for r in got})
        assert fewest_shards(tuple(sizes), shards) <= met <= fewest_shards(tuple(sizes), shards) + len(sizes) // 2


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "x")] * 30 + [(None, None), (1, "")], "doc_id long, text string")
    got = balanced_shards(docs, 4).collect()
    assert Counter(r["shard"] for r in got) == {0: 8, 1: 8, 2: 8, 3: 8} and sum(r["doc_id"] is None for r in got) == 31

import itertools
import random
import re

from pyspark.sql import functions as F

from leadspark.llm.near_dedup import SKETCH_SCHEMA, _set_batches, _whole_sets, least_shared, near_duplicate_groups, prefix_links, sketch_links
from leadspark.llm.store import Workspace
from tests.llm.fixtures import awkward_docs, empty_docs


def brute(rows):
    sets = {}
    for doc, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            label[max(x, y)] = min(x, y)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_matches_all_pairs(spark):
    docs = awkward_docs(spark, 64)
    want = brute({(r["doc_id"], r["text"]) for r in docs.collect()})
    got = near_duplicate_groups(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_matches_all_pairs_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute({(r["doc_id"], r["text"]) for r in docs.collect()})
    got = near_duplicate_groups(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_chain_of_edits_is_one_component(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        words[i * 6] = f"edited{i}"
        rows.append((100 - i, " ".join(words)))
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {71}


def test_empty_table(spark):
    assert near_duplicate_groups(empty_docs(spark)).collect() == []


def test_least_shared_leaves_room():
    assert 8 <= least_shared(32, 75) <= 11


def graph(rows):
    """Components of rows (id, text), each a document of its own."""
    want = brute([(i, text) for i, (_, text) in enumerate(rows)])
    groups = {}
    for i, (_, component, _) in want.items():
        groups.setdefault(component, []).append(rows[i][0])
    lowest = {c: min((d for d in ids if d is not None), default=None) for c, ids in groups.items()}
    return sorted((str(rows[i][0]), n, str(lowest[c] if n else rows[i][0])) for i, (n, c, _) in want.items())


def test_texts_under_one_id_and_rows_without_id_keep_their_links(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, a + " y"), (None, "c " * 9), (None, "c " * 8), (None, None), (7, "")]
    for order in (rows, rows[::-1]):
        got = near_duplicate_groups(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == graph(rows)
        assert sum(r["kept"] for r in got if r["component_id"] == 1) == 2


def test_template_corpus(spark):
    """Unlinked texts that share most of a template, and linked groups of them, against all pairs."""
    rnd = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(150):
        own = [f"o{i}_{j}" for j in range(rnd.choice([10, 25, 40, 60]))]
        rows.append((2 * i, " ".join(base + own)))
        if i % 3 == 0:
            own[rnd.randrange(len(own))] = "edit"
            rows.append((2 * i + 1, " ".join(base + own)))
    want = brute(rows)
    got = near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == want


def test_sketches_alone_find_nearly_all(spark, tmp_path):
    """Recall of the sketch path: the share of linked documents that it already joins."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    work = Workspace(spark, "recall")
    sketches = docs.select("doc_id", "text").mapInArrow(_set_batches(5, 32), SKETCH_SCHEMA)
    classes = sketches.where("n > 0").groupBy("key_a", "key_b", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = work.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels, _ = sketch_links(classes, docs.select("doc_id", "text"), work, 5, 32, 75)
    sets = work.write(_whole_sets(docs.select("doc_id", "text"), classes, 5), "sets")
    assert labels.count() >= 0.9 * prefix_links(sets, labels, work, 75).count() > 0

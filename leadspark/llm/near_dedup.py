"""Near-duplicate groups by bottom-k sketches and exact Jaccard verification.

1. One hash function turns every text into its set of word-shingle hashes; the ``k`` smallest
   are its bottom-k sketch. Texts with equal sets form one class; everything below works on classes.
2. Inverted lists of the retained values, rarest value first: two classes at the threshold share at least
   ``least`` retained values (``least_shared``: but for a chance of 1e-7), so a class enters
   only the lists of that prefix of its sketch that must meet a partner's.
3. Each list pairs its most central member with the others and the overlaps of a pair are
   counted; the bottom-k sketch of the union estimates a pair's similarity and drops those that cannot reach
   the threshold; the others are verified by exact Jaccard on the full sets.
4. A class is undecided while ``least`` or more of its values stand in lists that hold another component
   too. Undecided classes get inverted lists over their whole sets, of which a similarity of 0.75 needs
   only the prefix; the smaller class of a pair needs a shorter one, and the place of a shared value in the
   two orders bounds the overlap. This is exact and loses no link.

A list of thousands of copies costs one comparison a member; unlinked classes that share a template meet in no
list, as the template's values come last in their orders.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace, connected_components
from leadspark.llm.textops import blocks, distinct_sets, mix, shingle_hashes, utf8_parts

WIDTH, K, PERCENT = 5, 32, 75
#: Parts that the rows of one class are dealt to.
SALTS = 64
SKETCH_SCHEMA = "doc_id long, n long, key_a long, key_b long, sketch array<long>"
SET_SCHEMA = "doc_id long, n long, key_a long, key_b long, items array<long>"


def least_shared(k: int, percent: int, miss: float = 1e-7) -> int:
    """Values of two bottom-k sketches that a pair at the threshold shares, but for ``miss``."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += math.comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > miss:
            return max(1, x)
    return 1


def _set_batches(width: int, k: int | None):
    """Arrow task: the sorted distinct 63-bit shingle hashes of every text, or the k smallest."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                value, docs = shingle_hashes(data[base : offsets[hi]], offsets[lo : hi + 1] - base, width)
                value, at = distinct_sets(value >> np.uint64(1), docs, hi - lo)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value + np.uint64(s))))) for s in (0x1234567, 0x89ABCDEF)]
                key_a, key_b = ((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                n = np.diff(at)
                if k is not None:
                    keep = np.arange(len(value)) - np.repeat(at[:-1], n) < k
                    value, kept = value[keep], np.minimum(n, k)
                    at = np.concatenate(([0], np.cumsum(kept)))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(key_a), pa.array(key_b), lists],
                    ["doc_id", "n", "key_a", "key_b", "sketch" if k is not None else "items"],
                )

    return run


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("_na"), F.col("items").alias("_ia"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("_nb"), F.col("items").alias("_ib"))
    both = F.size(F.array_intersect("_ia", "_ib"))
    return pairs.join(left, "a").join(right, "b").where(both * (100 + percent) >= percent * (F.col("_na") + F.col("_nb"))).select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame, k: int, least: Column) -> DataFrame:
    """The pairs of which the union's bottom-k sketch holds ``least`` common values or more."""
    left = classes.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("_sa"))
    right = classes.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("_sb"))
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("_sa", "_sb")))
    return pairs.join(left, "a").join(right, "b").where(common >= least).select("a", "b")


def _whole_sets(texts: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cid, n, items of the ``wanted`` classes (cid, rep, n, key_a, key_b), read from their representatives' texts."""
    known = F.coalesce("doc_id", F.lit(-1)).alias("doc_id")
    reps = wanted.select(F.coalesce("rep", F.lit(-1)).alias("doc_id")).distinct()
    found = texts.select(known, "text").join(reps, "doc_id", "left_semi").mapInArrow(_set_batches(width, None), SET_SCHEMA)
    return found.join(wanted.select("cid", "n", "key_a", "key_b"), ["key_a", "key_b", "n"]).dropDuplicates(["cid"]).select("cid", "n", "items")


def _extended(labels: DataFrame, links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """``labels`` (id, label) once ``links`` between classes have joined their components; only components are walked."""
    ends = _with_component(links.select(F.col("a").alias("cid"), "b"), labels).select(F.col("comp").alias("a"), F.col("b").alias("cid"))
    over = connected_components(_with_component(ends, labels).select("a", F.col("comp").alias("b")), work, name)
    ids = labels.select("id", "label").union(over.select("id", F.col("id").alias("label")))
    joined = ids.join(over.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label", "left")
    return work.write(joined.select("id", F.coalesce("_to", "label").alias("label")).where("id <> label"), f"{name}-labels")


def _with_component(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("comp", F.coalesce("label", "cid")).drop("label")


def _undecided(lists: DataFrame, labels: DataFrame, least: Column) -> DataFrame:
    """cid of the classes of ``lists`` (v, cid, n) with ``least`` or more values that another component holds too."""
    placed = _with_component(lists, labels)
    mixed = placed.groupBy("v", "comp").agg(F.lit(1)).groupBy("v").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1").select("v")
    return placed.join(mixed, "v", "left_semi").groupBy("cid", "n").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least).select("cid")


def sketch_links(classes: DataFrame, texts: DataFrame, work: Workspace, width: int, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(labels of the classes that verified links join, cids that stay undecided) by lists of retained values of ``classes`` (cid, rep, n, key_a, key_b, sketch)."""
    least = F.least(F.lit(least_shared(k, percent)), F.ceil(F.col("n") * percent / 100)).cast("int")
    retained = classes.select("cid", "n", F.explode("sketch").alias("v"))
    shared = retained.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    order = retained.join(shared, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("order"), F.sum("df").alias("weight"))
    order = work.write(order.where(F.size("order") >= least), "order")
    # Values of one class only come first in the order; they take up a part of the prefix.
    room = F.least(F.col("n"), F.lit(k)) - least + 1 - (F.least(F.col("n"), F.lit(k)) - F.size("order"))
    posts = order.select("cid", "weight", F.explode(F.slice("order", F.lit(1), room.cast("int"))).alias("p")).select("p.v", "cid", "weight")
    central = posts.groupBy("v").agg(F.max(F.struct("weight", "cid")).alias("h")).select("v", F.col("h.cid").alias("c"))
    met = posts.join(central, "v").where("cid <> c").select(F.least("cid", "c").alias("a"), F.greatest("cid", "c").alias("b"))
    pairs = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap"))
    n = F.least("na", "nb")
    likely = work.write(_estimated(pairs, classes, k, F.least(F.lit(least_shared(k, percent)), F.ceil(n * percent / 100))), "likely")
    wanted = classes.join(likely.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi")
    sets = work.write(_whole_sets(texts, wanted, width), "likely-sets")
    links = work.write(_verify(likely, sets, percent), "sketch-links")
    work.drop("likely", "likely-sets")
    lists = order.select("cid", "n", F.explode("order.v").alias("v"))
    labels = connected_components(links, work, "sketched")
    return labels, _undecided(lists, labels, least)


def prefix_links(sets: DataFrame, labels: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """``labels`` (id, label) with all further links between ``sets`` (cid, n, items); none is lost."""
    items = sets.select("cid", "n", F.explode("items").alias("v"))
    common = items.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = items.join(common, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("order"))
    lone = F.col("n") - F.size("order")
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - lone
    posts = ranked.where(room > 0).select("cid", "n", lone.alias("lone"), F.posexplode(F.slice("order", F.lit(1), room.cast("int"))))
    posts = work.write(posts.select("cid", "n", (F.col("lone") + F.col("pos")).cast("long").alias("pos"), F.col("col.v").alias("v")), "posts")

    def candidates(left: DataFrame, right: DataFrame, *more) -> DataFrame:
        most = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
        on = (F.col("x.v") == F.col("y.v")) & (most * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n")))
        for m in more:
            on = on & m
        found = left.alias("x").join(right.alias("y"), on)
        return found.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()

    placed = _with_component(posts, labels)
    central = placed.groupBy("v").agg(F.min(F.struct((F.col("pos") / F.col("n")).alias("far"), "cid", "n", "pos", "comp")).alias("h")).select("v", "h.*")
    first = work.write(_verify(candidates(central, placed, F.col("x.comp") != F.col("y.comp")), sets, percent), "first")

    # What is still apart: the smaller class of a pair shares a value in its shorter prefix.
    labels = _extended(labels, first, work, "between")
    placed = work.write(_with_component(posts, labels), "placed")
    per = placed.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = per.groupBy("v").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    mixed = placed.join(main, "v").withColumn("aside", F.col("comp") != F.col("main"))
    small = mixed.where((F.col("n") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("n"))
    apart = (F.col("x.comp") != F.col("y.comp"), F.struct("x.n", "x.cid") < F.struct("y.n", "y.cid"))
    rest = candidates(small.where("aside"), mixed, *apart).union(candidates(small.where("not aside"), mixed.where("aside"), *apart)).distinct()
    labels = _extended(labels, work.write(_verify(rest, sets, percent), "rest"), work, "last")
    work.drop("posts", "placed")
    return labels


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link if 100 * intersection >= percent * union of their sets of distinct
    ``width``-word shingles (the whole word sequence where a text is shorter). A null or empty text
    and one without words has an empty set and links with nothing; rows with equal sets are
    always linked. Every row is a document of its own, so two texts under one doc_id each keep their links. Rows without a
    doc_id link others but name no component; where no row of a group has an id, component_id is null and
    all are kept. Texts are read whole; a text takes about twenty times its bytes of memory while it is hashed.
    """
    work = Workspace(docs.sparkSession, "near")
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    sketches = work.write(texts.mapInArrow(_set_batches(width, k), SKETCH_SCHEMA), "sketches")
    key = ["key_a", "key_b", "n"]
    classes = sketches.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    classes = work.write(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    labels, open_classes = sketch_links(classes, texts, work, width, k, percent)
    open_classes = work.write(open_classes, "undecided")
    sets = work.write(_whole_sets(texts, classes.join(open_classes, "cid", "left_semi"), width), "sets")
    work.drop("order")
    labels = prefix_links(sets, labels, work, percent)
    work.drop("sets")

    members = _with_component(classes.select("cid", *key, "rep"), labels)
    lowest = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    reps = work.write(members.join(lowest, "comp").select(*key, "component_id"), "components")
    # Rows of one class are spread over parts, each of which gets the class's component.
    parted = sketches.select("doc_id", *key, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("_part"))
    parts = parted.select(*key, "_part").distinct().join(reps, key)
    out = parted.join(parts, [*key, "_part"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.coalesce(component == F.col("doc_id"), component.isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))

"""Removal of every byte that a long repeated string covers, by content-sampled window hashing.

This replaces external induced sorting: no suffix is ordered and no common prefix is computed.
A text position is sampled if its k-byte string has the smallest hash in some window of ``length``
bytes; the windows that chose the same sample are one run. Samples carry tuples of hashes:

* a context string around the sample that every window of the (half) run contains; runs whose
  context occurs once in the corpus hold no repeated window and leave;
* the whole stretch that the run's windows cover: where it is repeated, every window of the run is,
  so the inside of a long repeat settles with one comparison a sample;
* only at the ends of repeats are single windows compared, each against one representative
  of every settled stretch with the same context.

Grouping is done by Spark's disk-backed sorts and shuffles with counts combined before the
shuffle; equal strings have equal pairs of 64-bit hashes. Two windows in one run differ in the distance to
their sample, so they are never equal and a stretch never matches itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace, spread_join, text_or_empty
from leadspark.llm.textops import RollingHash, blocks, utf8_parts

LENGTH, SEED = 200, 32
RUN_SCHEMA = "doc_id long, th long, context long, stretch long, first int, last int"
WINDOW_SCHEMA = "doc_id long, th long, alone boolean, context long, w long, at int"
RESULT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sampled_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Half-runs of windows of one block: document, context, stretch, first and last window start."""
    n, w = len(data), length - seed + 1
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    rolling = RollingHash(data)
    at = np.arange(n - seed + 1)
    keyed = (rolling.ranges(at, at + seed) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    padded = np.full(-(-len(keyed) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keyed)] = keyed
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    edge = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(np.diff(offsets) >= length)
    edge[offsets[long]] += 1
    edge[offsets[long + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 5
    sample = (np.minimum(behind[starts], ahead[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # Windows that begin far before their sample hold the string up to it, the others the string after it.
    reach = w // 2
    before = sample - starts >= reach
    new = np.ones(len(starts), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (starts[1:] != starts[:-1] + 1) | (before[1:] != before[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts)) - 1
    first, last, x, early = starts[head], starts[tail], sample[head], before[head]
    left = np.where(early, x - reach, x)
    right = np.where(early, x + seed, x + (length - reach + 1))
    context = rolling.ranges(left, right) ^ np.where(early, np.uint64(0x5BD1E995), np.uint64(0))
    stretch = rolling.ranges(first, last + length)
    doc = np.searchsorted(offsets, first, side="right") - 1
    return doc, context.view(np.int64), stretch.view(np.int64), first - offsets[doc], last - offsets[doc]


def _run_batches(length: int, seed: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(2))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                doc, context, stretch, first, last = sampled_runs(data[base : offsets[hi]], offsets[lo : hi + 1] - base, length, seed)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(context), pa.array(stretch), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))],
                    ["doc_id", "th", "context", "stretch", "first", "last"],
                )

    return run


def _window_batches(length: int):
    """Hash of every window of the listed runs of each text; of copies of a row that meet in a task the first is enough."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            batch = batch.filter(pa.array([k not in seen and not seen.add(k) for k in keys], pa.bool_()))
            data, offsets = utf8_parts(batch.column(2))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                rolling = RollingHash(data[base : offsets[hi]])
                runs = batch.column(3).slice(lo, hi - lo)
                flat = runs.flatten()
                counts = np.asarray(runs.value_lengths().fill_null(0))
                first, last = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                alone = np.asarray(flat.field(2).cast(pa.int8())).astype(bool)
                context = np.asarray(flat.field(3)).astype(np.int64)
                doc = np.repeat(np.arange(lo, hi), counts)
                width = last - first + 1
                each = np.repeat(np.arange(len(first)), width)
                at = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + first[each]
                place = at + offsets[doc[each]] - base
                take = pa.array(doc[each])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(alone[each]), pa.array(context[each]), pa.array(rolling.ranges(place, place + length).view(np.int64)), pa.array(at.astype(np.int32))],
                    ["doc_id", "th", "alone", "context", "w", "at"],
                )

    return run


def _cut_batches(batches):
    """Bytes left of each text once its spans are merged and removed."""
    for batch in batches:
        data, offsets = utf8_parts(batch.column(1))
        out = []
        for i, (doc, spans) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
            text = data[offsets[i] : offsets[i + 1]]
            kept, removed, n_spans, at = hashlib.sha256(), 0, 0, 0
            if spans.is_valid and len(spans.values):
                begin, end = np.asarray(spans.values.field(0)), np.asarray(spans.values.field(1))
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                cut = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                for a, b in zip(begin[cut], end[np.append(cut[1:], len(begin)) - 1], strict=True):
                    kept.update(text[at:a].tobytes())
                    removed, n_spans, at = removed + int(b - a), n_spans + 1, int(b)
            kept.update(text[at:].tobytes())
            out.append((doc, len(text), removed, n_spans, kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 4 else pa.int64()) for i, c in enumerate(columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Spans (doc_id, th, begin, end) that windows of ``length`` repeated bytes cover; they may overlap.

    ``docs`` has doc_id, th (a hash of the text) and text, none of them null. Rows that repeat both are two
    copies. Equality is that of two 64-bit hashes, of the context and of the stretch or window.
    """
    work = Workspace(docs.sparkSession, "repeats")
    runs = docs.mapInArrow(_run_batches(length, seed), RUN_SCHEMA)
    twice = work.write(runs.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "twice")
    work.drop()
    kept = work.write(spread_join(runs, twice, ["context"]), "runs")
    work.drop("twice")
    classes = kept.groupBy("context", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "first", "last")).alias("rep"))
    classes = work.write(classes, "classes")
    several = classes.groupBy("context").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("context")
    open_runs = classes.join(several, "context", "left_semi").select("rep.*", "context", (F.col("n") == 1).alias("alone"))
    per_doc = open_runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last", "alone", "context")).alias("runs"))
    windows = docs.join(per_doc.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "runs").mapInArrow(_window_batches(length), WINDOW_SCHEMA)
    windows = work.write(windows, "windows")
    work.drop()
    again = windows.groupBy("context", "w").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("open")).where("n > 1 AND open").select("context", "w")
    single = windows.where("alone").join(again, ["context", "w"], "left_semi").select("doc_id", "th", F.col("at").alias("begin"), (F.col("at") + length).alias("end"))
    whole = spread_join(kept, classes.where("n > 1").select("context", "stretch", "n"), ["context", "stretch"])
    spans = work.write(whole.select("doc_id", "th", F.col("first").alias("begin"), (F.col("last") + length).alias("end")).union(single), "spans")
    work.drop("runs", "classes", "windows")
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes; texts shorter than ``length`` bytes keep all of theirs. Rows without
    a doc_id count like all others and keep their null id.
    """
    bare = F.col("id").isNull()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text"))
    # The join keys are never null; the flag in the hash keeps rows without an id apart from those of id 0.
    texts = texts.select(F.coalesce("id", F.lit(0)).alias("doc_id"), F.xxhash64("text", bare).alias("th"), bare.alias("bare"), "text")
    # Copies of a row have the same spans, which are kept once.
    spans = repeated_spans(texts.drop("bare"), length).groupBy("doc_id", "th").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    joined = texts.join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left")
    return joined.select(F.when(~F.col("bare"), F.col("doc_id")).alias("doc_id"), "text", "spans").mapInArrow(_cut_batches, RESULT_SCHEMA)

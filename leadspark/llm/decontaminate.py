"""Benchmark leaks: word n-grams as seeds, Smith-Waterman alignment as the judge.

The items' n-grams form a table of seeds (an item of fewer than ``n`` words is one seed of its own length). One
pass over the texts notes the places of the n-grams that pass a bit table of the seeds; places and seeds are joined by
shuffle, so the benchmark may be of any size. How often the corpus holds a seed decides nothing: many copies
of an edited or cut item make some of its seeds frequent and leave the others absent, like everyday words do.
Every document with enough seeds of one item within its reach is therefore a candidate. An
alignment matches at most the words that item and window share, counted with repeats; a candidate
that cannot reach the least score by this bound is passed over, which loses nothing. The
others are aligned word by word, and the score is the share of a perfect alignment that the best local one reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace
from leadspark.llm.textops import blocks, mix, utf8_parts, word_hashes

N_GRAM = 3
#: Size of the bit table of seeds, as a power of two; it reaches the driver as at most 2**(BITS - 6) rows.
BITS = 24
LEAST_SEEDS, LEAST_SCORE = 2, 0.4
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of a window that are aligned at once, at least; longer windows are cut into overlapping ones.
PIECE = 4096
ITEM_SCHEMA = "item_id long, size int, words array<long>, seeds array<struct<seed:long,place:int>>"
HIT_SCHEMA = "doc_id long, text string, hits array<struct<seed:long,at:int>>"
RESULT_SCHEMA = "doc_id long, item_id long, seeds int, score double, begin_word int, end_word int"


def _grams(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words; the length is a part of it."""
    out = np.full(max(0, len(value) - n + 1), n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x8CB92BA72F3D8DD7) + value[j : len(value) - n + 1 + j]
    return mix(out)


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


def _item_batches(n: int):
    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = _words(text)
                if len(value):
                    grams = _grams(value, min(n, len(value))).view(np.int64).tolist()
                    rows.append({"item_id": item, "size": len(value), "words": value.view(np.int64).tolist(), "seeds": [{"seed": g, "place": i} for i, g in enumerate(grams)]})
            kinds = {"item_id": pa.int64(), "size": pa.int32(), "words": pa.list_(pa.int64()), "seeds": pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    return run


def bit_table(seeds: DataFrame, bits: int = BITS) -> np.ndarray:
    """Which of the 2**``bits`` leading bit patterns some seed has, as packed 64-bit words."""
    lead = F.shiftrightunsigned("seed", 64 - bits)
    set_bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - bits}) & 63 AS INT))")
    rows = seeds.groupBy(F.shiftrightunsigned(lead, 6).alias("at")).agg(F.bit_or(set_bit).alias("word")).toPandas()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows["at"].to_numpy(np.int64)] = rows["word"].to_numpy(np.int64)
    return table.view(np.uint64)


def _hit_batches(table: np.ndarray, lengths: list[int], bits: int):
    """Places of the n-grams of each length that pass the bit table."""
    one = np.uint64(1)

    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for lo, hi in blocks(offsets):
                base = offsets[lo]
                value, _, _, docs = word_hashes(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
                found, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for n in lengths:
                    if len(value) >= n:
                        grams = _grams(value, n)
                        lead = grams >> np.uint64(64 - bits)
                        at = np.flatnonzero((table[(lead >> np.uint64(6)).astype(np.int64)] >> (lead & np.uint64(63)) & one).astype(bool) & (docs[: len(grams)] == docs[n - 1 :]))
                        found.append(grams[at])
                        places.append(at)
                seed, at = np.concatenate(found), np.concatenate(places)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                seed, at = seed[order], at[order]
                count = np.bincount(docs, minlength=hi - lo)
                word = at - (np.cumsum(count) - count)[docs[at]]
                doc, begin = np.unique(docs[at], return_index=True)
                entries = pa.StructArray.from_arrays([pa.array(seed.view(np.int64)), pa.array(word.astype(np.int32))], ["seed", "at"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)).astype(np.int32)), entries)
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists], ["doc_id", "text", "hits"])

    return run


def align(jobs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of (item words, text words) jobs: score, begin and end in the text words.

    All jobs of a call move together by one item word a step; gaps along the text come from a running
    maximum.
    """
    n, rows = len(jobs), max((len(a) for a, _ in jobs), default=0)
    width = max((len(b) for _, b in jobs), default=0)
    item, text = np.zeros((n, rows), np.uint64), np.zeros((n, width), np.uint64)
    there = np.zeros((n, width), bool)
    for k, (a, b) in enumerate(jobs):
        item[k, : len(a)], text[k, : len(b)], there[k, : len(b)] = a, b, True
    sizes = np.array([len(a) for a, _ in jobs])
    score, origin = np.zeros((n, width + 1), np.int32), np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1)).copy()
    column = np.arange(width + 1, dtype=np.int32)
    best, begin, end = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
    for i in range(rows):
        same = (text == item[:, i : i + 1]) & there
        diagonal = score[:, :-1] + np.where(same, MATCH, MISMATCH)
        above = score + GAP
        now, start = above.copy(), origin.copy()
        better = diagonal > now[:, 1:]
        now[:, 1:] = np.where(better, diagonal, now[:, 1:])
        start[:, 1:] = np.where(better, origin[:, :-1], start[:, 1:])
        fresh = now <= 0
        now[fresh] = 0
        start = np.where(fresh, column, start)
        # A gap along the text: the best earlier cell less one a word, with its origin carried along.
        lifted = (now.astype(np.int64) - GAP * column) * (width + 2) + np.arange(width + 1)
        top = np.maximum.accumulate(lifted, axis=1)
        source = top % (width + 2)
        reached = (top // (width + 2) + GAP * column).astype(np.int32)
        take = reached > now
        start = np.where(take, np.take_along_axis(start, source, axis=1), start)
        now = np.where(take, reached, now)
        score, origin = now, start
        live = i < sizes
        at = score.argmax(axis=1)
        value = score[np.arange(n), at]
        gain = live & (value > best)
        best[gain], end[gain], begin[gain] = value[gain], at[gain], origin[np.arange(n), at][gain]
    return best, begin, end


def most_matches(item: tuple[np.ndarray, np.ndarray], window: np.ndarray) -> int:
    """Words of ``window`` that an alignment can match at most; ``item`` has distinct sorted words and their counts."""
    word, count = item
    spot = np.minimum(np.searchsorted(word, window), len(word) - 1)
    held = np.bincount(spot[word[spot] == window], minlength=len(word))
    return int(np.minimum(held, count).sum())


def pieces(begin: int, end: int, size: int, least_score: float) -> list[tuple[int, int]]:
    """Cuts of the window [begin, end) that overlap by as many words as an alignment of the least score can take."""
    reach = size + int(np.ceil(MATCH * size * (1 - least_score))) + 1
    length = max(PIECE, 2 * reach)
    return [(a, min(end, a + length)) for a in range(begin, max(begin + 1, end - reach), length - reach)]


def _windows(spots: list[tuple[int, int]], size: int, n_words: int, least: int):
    """(seeds, first word, last word) of every cluster of (place in the text, place in the item) pairs."""
    at = np.array(sorted(spots), np.int64)
    cut = np.flatnonzero(np.diff(at[:, 0]) > size + 8) + 1
    for part in np.split(at, cut):
        seeds = len(np.unique(part[:, 1]))
        if seeds >= least:
            yield seeds, max(0, int(part[0, 0]) - size - 8), min(n_words, int(part[-1, 0]) + size + 8)


def _least(size, n: int, least_seeds: int):
    return min(least_seeds, max(1, size - n + 1))


def _judge_batches(n: int, least_seeds: int, least_score: float, batch_jobs: int = 128, batch_words: int = 1 << 18):
    """Candidates (doc_id, text, items: item_id, words, spots) to findings."""

    def run(batches):
        for batch in batches:
            out: dict[tuple[int, int], tuple] = {}
            jobs, about, width = [], [], 0

            def settle():
                score, begin, end = align(jobs)
                for (row, k, seeds, lo), (words, _), s, a, b in zip(about, jobs, score, begin, end, strict=True):
                    share = float(s) / (MATCH * len(words))
                    if share >= least_score and share > out.get((row, k), (0, 0.0))[1]:
                        out[row, k] = (seeds, share, lo + int(a), lo + int(b))
                jobs.clear()
                about.clear()

            doc_ids = batch.column(0).to_pylist()
            for row, (text, items) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                value = _words(text.as_py())
                for item in items:
                    k, words, spots = item["item_id"].as_py(), np.asarray(item["words"].values, np.int64).view(np.uint64), item["spots"].as_py()
                    distinct = np.unique(words, return_counts=True)
                    for seeds, begin, end in _windows([(s["at"], s["place"]) for s in spots], len(words), len(value), _least(len(words), n, least_seeds)):
                        for lo, hi in pieces(begin, end, len(words), least_score):
                            if most_matches(distinct, value[lo:hi]) < least_score * len(words):
                                continue
                            # Jobs are padded to the widest of their batch.
                            if jobs and max(width, hi - lo) * (len(jobs) + 1) > batch_words:
                                settle()
                            width = max(width, hi - lo) if jobs else hi - lo
                            jobs.append((words, value[lo:hi]))
                            about.append((row, k, seeds, lo))
                            if len(jobs) >= batch_jobs:
                                settle()
            if jobs:
                settle()
            rows = [(doc_ids[row], k, *v) for (row, k), v in out.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "seeds", "score", "begin_word", "end_word"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N_GRAM, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE, bits: int = BITS) -> DataFrame:
    """Documents that hold a benchmark item or an edited copy: doc_id, item_id, seeds, score, begin_word, end_word.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Null and empty texts and items
    match nothing; letters match in either case; an item of one word is found wherever a text has that word. Of the texts under
    one item_id, and of the rows under one doc_id (null included), the best alignment counts. Word places are of
    the text's white-space words, end exclusive.
    """
    work = Workspace(docs.sparkSession, "leaks")
    texts = docs.select(F.col("doc_id").cast("long"), F.lower("text").alias("text")).where("text is not null")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.lower("text").alias("text")).distinct()
    items = work.write(items.mapInArrow(_item_batches(n), ITEM_SCHEMA).withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = items.select("item", "size", F.explode("seeds").alias("s")).select("s.seed", "s.place", "item", "size")
    lengths = sorted(r[0] for r in items.select(F.least("size", F.lit(n))).distinct().collect())
    hits = texts.mapInArrow(_hit_batches(bit_table(seeds, bits), lengths, bits), HIT_SCHEMA)
    hits = work.write(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    marks = hits.select("row", F.explode("hits").alias("h")).select("row", "h.seed", "h.at")
    spots = marks.join(seeds, "seed").groupBy("row", "item").agg(F.collect_list(F.struct("at", "place")).alias("spots"), F.count_distinct("place").alias("places"), F.first("size").alias("size"))
    enough = F.least(F.lit(least_seeds), F.greatest(F.lit(1), F.col("size") - n + 1))
    told = spots.where(F.col("places") >= enough).join(items.select("item", "item_id", "words"), "item")
    per_row = told.groupBy("row").agg(F.collect_list(F.struct("item_id", "words", "spots")).alias("items"))
    found = hits.join(per_row, "row").select("doc_id", "text", "items").mapInArrow(_judge_batches(n, least_seeds, least_score), RESULT_SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(*[F.max_by(c, F.struct("score", "begin_word")).alias(c) for c in ("seeds", "score", "begin_word", "end_word")])

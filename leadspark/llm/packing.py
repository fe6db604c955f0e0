"""Best-fit packing of tokenised texts into sequences of fixed capacity.

The plan depends on the histogram of piece lengths alone, at most ``capacity`` counts, so it is made
on the driver whatever the corpus holds: for the longest lengths first, the exact complement
is looked up in a hash index of single lengths, sums of two and sums of three, and consumed as often as all its
parts are available; where no combination fills a gap exactly, best fit takes the longest length that
fits and the search goes on with what is left. Pieces then find their place by their rank
within their length, which Spark numbers without gathering a length in one task.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace, gapless_rank

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The symbol that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_SYMBOLS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
#: A blank before white space or the end.
_UNEVEN = re.compile(r" (?:\s|\Z)")


class CachedEncoder:
    """Token ids of whole texts, by the tokenizer itself, as little-endian unsigned 32-bit bytes.

    The pre-tokenizer never joins what a single blank before a visible character separates, so a
    text is encoded blank by blank; repeated words come from a bounded cache, plain ones go to the tokenizer's
    model and the others to the whole tokenizer in one batch. Texts with other runs of white space around a blank, and those that hold
    the string of a special token, are encoded in one go.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Ids of a blank and the word after it.
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, word: str) -> bytes | None:
        """Ids of a blank and Latin letters with one mark at most, which the pre-tokenizer takes as they are; None for other words."""
        found = _LETTERS.fullmatch(word)
        if not found:
            return None
        letters, mark = found.groups()
        pieces = ["\u0120" + letters.encode().decode("latin-1").translate(_BYTE_SYMBOLS), *mark]
        return self._bytes([t.id for p in pieces for t in self.tokenizer.model.tokenize(p)])

    def _learn(self, words: list[str]) -> None:
        fresh = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(fresh) > self.most:
            self.words.clear()
            fresh = list(set(words))
        self.words.update((w, self._plain(w)) for w in fresh)
        other = [w for w in fresh if self.words[w] is None]
        found = self.tokenizer.encode_batch_fast([" " + w for w in other], add_special_tokens=False)
        self.words.update((w, self._bytes(e.ids)) for w, e in zip(other, found, strict=True))

    def __call__(self, text: str) -> bytes:
        if _UNEVEN.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            found = b"".join([self.words[w] for w in rest])
        except KeyError:
            self._learn(rest)
            found = b"".join([self.words[w] for w in rest])
        return self._whole(first) + found if first else found


@lru_cache(maxsize=2)
def _encoder(path: str) -> CachedEncoder:
    return CachedEncoder(path)


def _piece_batches(path: str, capacity: int) -> Callable:
    def run(batches):
        encode, end = _encoder(path), b"\0\0\0\0"
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                start, piece, view = 0, 0, memoryview(ids)
                while start < n:
                    stop = start + ((n - start - 1) % capacity + 1 if start == 0 else capacity)
                    rows.append((doc, piece, start, stop - start, zlib.crc32(view[4 * start : 4 * stop])))
                    start, piece = stop, piece + 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names)

    return run


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every row of ``docs`` (doc_id, text): its ids, then id 0, cut only if over ``capacity``.

    A null text is empty and gives the one piece [0].
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_piece_batches(path, capacity), PIECE_SCHEMA)


class SumIndex:
    """Hash index of the single, pair and triple sums of the lengths in stock.

    For every sum that was asked for, the index keeps the longest first part that may still
    lead to it. Stock only falls, so what has run out never comes back, and all look-ups together take
    no more steps than there are (sum, first part) pairs.
    """

    def __init__(self, counts: list[int]) -> None:
        self.counts = counts
        self.pairs: dict[int, int] = {}
        self.triples: dict[int, int] = {}

    def _holds(self, a: int, b: int) -> bool:
        return self.counts[a] > (a == b) and self.counts[b] > 0

    def pair(self, total: int, taken: int = 0) -> list[int] | None:
        """Two lengths of the sum, longest first, beside one piece of length ``taken``."""
        first = self.pairs.get(total, min(total - 1, len(self.counts) - 1))
        while 2 * first >= total and not self._holds(first, total - first):
            first -= 1
        self.pairs[total] = first
        if not taken:
            return [first, total - first] if 2 * first >= total else None
        self.counts[taken] -= 1
        while 2 * first >= total and not self._holds(first, total - first):
            first -= 1
        self.counts[taken] += 1
        return [first, total - first] if 2 * first >= total else None

    def fill(self, gap: int) -> list[int] | None:
        """One, two or three lengths in stock that sum to ``gap``."""
        if gap <= 0:
            return None
        if gap < len(self.counts) and self.counts[gap]:
            return [gap]
        if two := self.pair(gap):
            return two
        first = self.triples.get(gap, min(gap - 2, len(self.counts) - 1))
        found = None
        while 3 * first >= gap and found is None:
            found = self.pair(gap - first, first) if self.counts[first] else None
            first -= found is None
        self.triples[gap] = first
        return found and [first, *found]


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences); uses every piece exactly once."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    index = SumIndex(counts)
    plan: list[tuple[tuple[int, ...], int]] = []
    for seed in range(capacity, 0, -1):
        while counts[seed]:
            parts, gap = [seed], capacity - seed
            counts[seed] -= 1
            while gap:
                found = index.fill(gap) or next(([n] for n in range(min(gap, capacity), 0, -1) if counts[n]), None)
                if not found:
                    break
                for length in found:
                    counts[length] -= 1
                    parts.append(length)
                    gap -= length
            need = Counter(parts)
            again = min(counts[n] // k for n, k in need.items())
            for n, k in need.items():
                counts[n] -= again * k
            plan.append((tuple(parts), 1 + again))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, piece, length, ...).

    Only the counts of the at most ``capacity`` lengths reach the driver. An empty table stays empty.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, base = [], 0
    taken: dict[int, int] = {}
    for parts, times in plan_packing(histogram, capacity):
        offset = 0
        for length in parts:
            rows.append((length, taken.get(length, 0), base, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        base += times
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
    total = sum(histogram.values()) + 1
    keys = slots[:, 0] * total + slots[:, 1]

    def place(frames):
        for f in frames:
            key = f["length"].to_numpy(np.int64) * total + f["rank"].to_numpy(np.int64)
            slot = slots[np.searchsorted(keys, key, side="right") - 1]
            yield pd.concat([f.drop(columns="rank"), pd.DataFrame({"sequence_id": slot[:, 2] + f["rank"].to_numpy(np.int64) - slot[:, 1], "offset": slot[:, 3]}, index=f.index)], axis=1)

    buckets = max(1, min(4096, sum(histogram.values()) // 5000 + 1))
    ranked = gapless_rank(pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.xxhash64("doc_id", "piece"), buckets, "rank")
    names = [f for f in pieces.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", sequence_id long, offset long"
    return ranked.select(*[f.name for f in names], "rank").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise ``docs`` once, write the pieces and pack them."""
    work = Workspace(docs.sparkSession, "packing")
    return pack(work.write(token_pieces(docs, path, capacity), "pieces"), capacity)

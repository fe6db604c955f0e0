"""Alignment of two tokenizers' tokens over the bytes of a text, and corpus-wide counts of aligned id pairs.

Both token sequences spell the same bytes, so each is an increasing array of ends. Groups end where both arrays hold the same
value. Over stretches of one-to-one groups the arrays are equal at a constant index shift (a diagonal); windows of doubling size are
compared there as a whole, and the window that differs is halved until the stretch ends. The irregular group behind it is walked
token by token, which gives the shift of the next stretch.

How many documents hold an id pair linked is counted in two levels. Tasks count within blocks of documents; only the distinct pairs of a
block are shuffled, joined with their corpus counts and handed back to the block, so a pair that every document holds
is one row a block.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace
from leadspark.llm.textops import blocks, utf8_parts

TOKENIZER_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of a block of documents; a longer text is a block of its own.
BLOCK = 4 << 20
#: Text bytes that are encoded and aligned in one pass.
PASS = 1 << 18
#: Ids below 2**20 each, so that a pair is one long.
ID_BITS = 20
#: A blank after a visible character: both tokenizers always end a token before it. Some characters without width are kept out, as they may count as white space.
_CUT = re.compile("(?<=[^\\s᠎​⁠﻿]) ")
#: White space beside a blank, where cutting at every blank would not do.
_UNEVEN = re.compile("[\\s᠎​⁠﻿] | [\\s᠎​⁠﻿]|\\A | \\Z")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers each, end to end."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


class Growing:
    """An array that doubles when it is full, so adding to it copies each entry about once."""

    def __init__(self, kind: type) -> None:
        self.held, self.used = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        end = self.used + len(values)
        if end > len(self.held):
            wider = np.zeros(max(end, 2 * len(self.held)), self.held.dtype)
            wider[: self.used] = self.held[: self.used]
            self.held = wider
        self.held[self.used : end] = values
        self.used = end


#: The symbol that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SYMBOLS = {b: b for b in _PRINTED} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
#: Words that the first tokenizer's pattern takes as they are after a blank: letters, and one mark behind them at most.
_LETTERS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")


class TwoEncoders:
    """Ids of both tokenizers for blank + text, cut at blanks into units that a bounded cache remembers."""

    def __init__(self, path_a: str, path_b: str, most: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        told = json.loads(self.a.to_str())
        before = told["pre_tokenizer"] or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex") or told["normalizer"]:
            raise ValueError("the first tokenizer must be byte-level with its usual pattern and without normalisation")
        self.most = most
        self._forget()
        symbols = {chr(s): b for b, s in _SYMBOLS.items()}
        #: Bytes of every id.
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in symbols for c in token)
            self.bytes_a[i] = bytes(symbols[c] for c in token) if known else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        #: Texts of the ids before another of the same side, A's before the B side, B's before the next group.
        names = [[str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b)]
        self.names = [n + end for side, ends in zip(names, (",|", ",;"), strict=True) for end in ends for n in side]

    def _ids_a(self, units: list[str]) -> list[list[int]]:
        """Ids of a blank and each unit; plain words go to the tokenizer's model, the others to the whole tokenizer."""
        out: list[list[int] | None] = []
        tokenize = self.a.model.tokenize
        for u in units:
            found = _LETTERS.fullmatch(u)
            if found:
                letters, mark = found.groups()
                plain = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_SYMBOLS)
                ids = [t.id for t in tokenize("\u0120" + plain)]
                out.append(ids + [t.id for t in tokenize(mark)] if mark else ids)
            else:
                out.append(None)
        other = [u for u, ids in zip(units, out, strict=True) if ids is None]
        rest = iter(self.a.encode_batch_fast([" " + u for u in other], add_special_tokens=False))
        return [next(rest).ids if ids is None else ids for ids in out]

    def _forget(self) -> None:
        #: Number of each unit; its ids on both sides are stretches of two flat arrays, and it has none where the bytes differ.
        self.units: dict[str, int] = {}
        self.spelt = Growing(bool)
        self.flat, self.first, self.size = [Growing(np.int32), Growing(np.int32)], [Growing(np.int64), Growing(np.int64)], [Growing(np.int32), Growing(np.int32)]

    def _learn(self, units: set[str]) -> None:
        fresh = list(units)
        sides = [self._ids_a(fresh), self.b.encode(fresh, num_threads=1)]
        text = [b" " + u.encode() for u in fresh]
        sizes = [np.fromiter(map(len, ids), np.int32, len(fresh)) for ids in sides]
        flats = [np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum())) for ids, n in zip(sides, sizes, strict=True)]
        spelt = np.ones(len(fresh), bool)
        for ids, tokens in zip(sides, (self.bytes_a, self.bytes_b), strict=True):
            of = tokens.__getitem__
            spelt &= np.fromiter([b"".join(map(of, i)) == t for i, t in zip(ids, text, strict=True)], bool, len(fresh))
        known = len(self.units)
        self.units.update(zip(fresh, range(known, known + len(fresh)), strict=True))
        self.spelt.add(spelt)
        for side in (0, 1):
            self.first[side].add(np.cumsum(sizes[side]) - sizes[side] + self.flat[side].used)
            self.flat[side].add(flats[side])
            self.size[side].add(sizes[side])

    def _cut(self, text: str) -> list[str]:
        if not _UNEVEN.search(text):
            return text.split(" ")
        units = _CUT.split(text)
        # An empty last unit would stand for a blank at the end, which belongs to the unit before it.
        return units if units[-1] else [*units[:-2], units[-2] + " "]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of A end to end, of B, number of ids of each text in A, in B); none for a text that is empty or whose bytes either side spells otherwise."""
        cut = [self._cut(t) if t else [] for t in texts]
        units = list(chain.from_iterable(cut))
        number = np.fromiter(map(self.units.get, units, repeat(-1)), np.int64, len(units))
        lost = np.flatnonzero(number < 0)
        if len(lost):
            missing = {units[i] for i in lost.tolist()}
            if len(self.units) + len(missing) > self.most:
                self._forget()
                missing, lost = set(units), np.arange(len(units))
            self._learn(missing)
            number[lost] = [self.units[units[i]] for i in lost.tolist()]
        doc = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        odd = np.zeros(len(cut), bool)
        odd[doc[~self.spelt.held[number]]] = True
        number, doc = number[~odd[doc]], doc[~odd[doc]]
        out = [self.flat[side].held[_ranges(self.first[side].held[number], self.size[side].held[number])].astype(np.int64) for side in (0, 1)]
        return *out, *[np.bincount(doc, self.size[side].held[number], len(cut)).astype(np.int64) for side in (0, 1)]


@lru_cache(maxsize=1)
def _encoders(path_a: str, path_b: str) -> TwoEncoders:
    return TwoEncoders(path_a, path_b)


def one_to_one(a: bytes, b: bytes, i: int, j: int) -> int:
    """How many entries (of eight bytes) from ``i`` of ``a`` and ``j`` of ``b`` on are equal, the first of which are.

    Windows double, from four entries on, while they are equal; the one that differs is halved until its first difference is found.
    """
    x, y = 8 * i, 8 * j
    most = min(len(a) - x, len(b) - y)
    done, width = 8, 32
    while True:
        if done >= most:
            return most // 8
        high = done + width
        if high > most:
            high = most
        if a[x + done : x + high] != b[y + done : y + high]:
            break
        done, width = high, 2 * width
    while high - done > 8:
        middle = (done + high) // 16 * 8
        if a[x + done : x + middle] == b[y + done : y + middle]:
            done = middle
        else:
            high = middle
    return done // 8


def align(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals, irregular groups) of two arrays of ends that close at the same byte.

    A diagonal (i, j, n) is n one-to-one groups from tokens i and j on; an irregular group (i, k, j, m) is tokens [i, k) beside [j, m).
    """
    a, b = end_a.tolist(), end_b.tolist()
    raw_a, raw_b = end_a.astype("<i8").tobytes(), end_b.astype("<i8").tobytes()
    diagonals, groups = [], []
    i = j = 0
    n = len(a)
    while i < n:
        x, y = a[i], b[j]
        if x == y:
            run = one_to_one(raw_a, raw_b, i, j)
            diagonals.append((i, j, run))
            i, j = i + run, j + run
            continue
        k, m = i, j
        while x != y:
            if x < y:
                k += 1
                x = a[k]
            else:
                m += 1
                y = b[m]
        groups.append((i, k + 1, j, m + 1))
        i, j = k + 1, m + 1
    return np.array(diagonals, np.int64).reshape(-1, 3), np.array(groups, np.int64).reshape(-1, 4)


def group_links(a: list[int], b: list[int], group: tuple[int, int, int, int]) -> Iterator[tuple[int, int]]:
    """Token places of an irregular group whose byte ranges overlap; ``a`` and ``b`` are the ends."""
    i, k, j, m = group
    while i < k and j < m:
        yield i, j
        if a[i] < b[j]:
            i += 1
        elif a[i] > b[j]:
            j += 1
        else:
            i, j = i + 1, j + 1


def all_links(end_a: np.ndarray, end_b: np.ndarray, diagonals: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and the B token of every link, in no order."""
    i, k, j, m = groups.T
    one_a, one_b = k - i == 1, m - j == 1
    left = [_ranges(diagonals[:, 0], diagonals[:, 2]), np.repeat(i[one_a], (m - j)[one_a]), _ranges(i[one_b], (k - i)[one_b])]
    right = [_ranges(diagonals[:, 1], diagonals[:, 2]), _ranges(j[one_a], (m - j)[one_a]), np.repeat(j[one_b], (k - i)[one_b])]
    both = groups[~one_a & ~one_b]
    if len(both):
        a, b = end_a.tolist(), end_b.tolist()
        x, y = zip(*chain.from_iterable(group_links(a, b, g) for g in both.tolist()), strict=True)
        left.append(np.array(x, np.int64))
        right.append(np.array(y, np.int64))
    return np.concatenate(left), np.concatenate(right)


def group_text(ids_a: np.ndarray, ids_b: np.ndarray, groups: np.ndarray, names: list[str], n_a: int, n_b: int) -> tuple[np.ndarray, list[str]]:
    """(whether each A token is the last of its group, texts of all tokens in order) for texts like `a1,a2|b1;a3|b2;`.

    All groups but ``groups`` are one to one. ``names`` holds the texts of A's ids with a comma and with a bar, then of B's with a comma and with a
    semicolon; n_a and n_b are the numbers of ids.
    """
    i, k, j, m = groups.T
    last_a, last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    last_a[_ranges(i, k - i - 1)] = False
    last_b[_ranges(j, m - j - 1)] = False
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    ends_a, ends_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    # A group's B tokens follow its A tokens, so a token's place is its own index and the number of tokens of the other side before it.
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    order[np.arange(len(ids_a)) + np.append(0, ends_b)[of_a]] = ids_a + n_a * last_a
    order[np.arange(len(ids_b)) + ends_a[of_b]] = ids_b + n_b * last_b + 2 * n_a
    return last_a, [names[x] for x in order.tolist()]


@dataclass
class Described:
    """Documents of one pass: their numbers, the hashes of their groups, and end to end their distinct pairs and how often each is linked."""

    n_a: list[int]
    n_b: list[int]
    n_groups: list[int]
    n_links: list[int]
    hashes: list[str]
    n_pairs: list[int]
    pairs: np.ndarray
    times: np.ndarray


def describe(texts: list[str], both: TwoEncoders) -> Described:
    """Align documents laid end to end: both tokenizers end at the end of each, so no group reaches into the next."""
    n = len(texts)
    ids_a, ids_b, size_a, size_b = both(texts)
    end_a, end_b = np.cumsum(both.size_a[ids_a]), np.cumsum(both.size_b[ids_b])
    diagonals, groups = align(end_a, end_b)
    left, right = all_links(end_a, end_b, diagonals, groups)
    last_a, texts = group_text(ids_a, ids_b, groups, both.names, len(both.size_a), len(both.size_b))
    upto_a, upto_b = np.append(0, np.cumsum(size_a)), np.append(0, np.cumsum(size_b))
    n_groups = np.diff(np.append(0, np.cumsum(last_a))[upto_a])
    doc = np.searchsorted(upto_a, left, side="right") - 1
    keys, times = np.unique(doc << 2 * ID_BITS | ids_a[left] << ID_BITS | ids_b[right], return_counts=True)
    at = (upto_a + upto_b).tolist()
    hashes = [hashlib.sha256("".join(texts[x:y])[:-1].encode()).hexdigest() if y > x else "" for x, y in zip(at, at[1:], strict=False)]
    n_pairs = np.bincount(keys >> 2 * ID_BITS, minlength=n)
    return Described(size_a.tolist(), size_b.tolist(), n_groups.tolist(), np.bincount(doc, minlength=n).tolist(), hashes, n_pairs.tolist(), keys & (1 << 2 * ID_BITS) - 1, times)


#: Rows of documents (pair and times are its distinct pairs and how often they are linked) and, with ``n_a`` null, of blocks (its distinct pairs and in how many documents).
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _lists(values: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))


def _aligned(path_a: str, path_b: str, limit: int) -> Callable:
    def close(block: int, docs: list[int], told: list[Described]) -> pa.RecordBatch:
        """Rows of the documents of a block and then the row of the block."""
        pairs = np.concatenate([d.pairs for d in told])
        whole, held = np.unique(pairs, return_counts=True)
        of = lambda name: [x for d in told for x in getattr(d, name)]
        numbers = [pa.array([*c, None], pa.int64()) for c in (docs, of("n_a"), of("n_b"), of("n_groups"), of("n_links"))]
        sizes = [*of("n_pairs"), len(whole)]
        lists = [_lists(np.concatenate([pairs, whole]), sizes), _lists(np.concatenate([*[d.times for d in told], held]), sizes)]
        columns = [pa.array([block] * (len(docs) + 1), pa.int64()), *numbers, pa.array([*of("hashes"), None], pa.string()), *lists]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ALIGNED.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, part, n_blocks = _encoders(path_a, path_b), TaskContext.get().partitionId(), 0
        docs: list[int] = []
        told: list[Described] = []
        size = 0
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            view, names = memoryview(data), batch.column(0).to_pylist()
            # Units that are new among a few hundred kilobytes of texts are learned together.
            for lo, hi in blocks(offsets, min(limit, PASS)):
                texts = [bytes(view[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace") for i in range(lo, hi)]
                docs += names[lo:hi]
                told.append(describe(texts, both))
                size += int(offsets[hi] - offsets[lo]) + 64 * (hi - lo)
                if size >= limit:
                    yield close(part << 32 | n_blocks, docs, told)
                    n_blocks, docs, told, size = n_blocks + 1, [], [], 0
        if docs:
            yield close(part << 32 | n_blocks, docs, told)

    return run


def _answer(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums over the links of each document of a block, from the corpus counts of the block's pairs."""
    pair, n, best = (counts.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    pairs, times = (docs.column(c).combine_chunks() for c in ("pairs", "times"))
    offsets = pairs.offsets.to_numpy()
    at = order[np.searchsorted(pair[order], pairs.values.to_numpy()[offsets[0] : offsets[-1]])]
    many = times.values.to_numpy()[times.offsets[0].as_py() : times.offsets[-1].as_py()]
    upto = [np.concatenate([[0], np.cumsum(v[at] * many)]) for v in (best.astype(np.int64), n)]
    cut = offsets - offsets[0]
    sums = [pa.array(u[cut[1:]] - u[cut[:-1]], pa.int64()) for u in upto]
    return docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", sums[0]).append_column("count_sum", sums[1]).append_column("groups_sha256", docs.column("groups_sha256"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs) of the two tokenizers over ``docs`` (doc_id, text).

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. pairs: a_id, b_id, n_docs and whether no other pair of
    its a_id is in more documents. Null and empty texts and those that a tokenizer does not spell byte by byte have no
    tokens: zeros and an empty hash. Every row is a document, repeated rows and rows without a doc_id too; other columns
    are ignored; an empty table gives empty tables. A very long text is one block, of memory for some hundred times its bytes.
    """
    work = Workspace(docs.sparkSession, "alignment")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = work.write(rows.mapInArrow(_aligned(path_a, path_b, block), ALIGNED), "aligned")
    held = table.where("n_a is null").select(F.col("block").alias("held_by"), F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("held_by", F.col("p.pairs").alias("pair"), F.col("p.times").alias("n"))
    counted = held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a_id", F.shiftright("pair", ID_BITS))
    most = counted.groupBy("a_id").agg(F.max("n").alias("most"))
    counted = work.write(counted.join(most, "a_id").select("pair", "a_id", "n", (F.col("n") == F.col("most")).alias("best")), "counted")
    known = held.select("held_by", "pair").join(counted.select("pair", "n", "best"), "pair")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    answered = table.where("n_a is not null").groupBy("block").cogroup(known.groupBy("held_by")).applyInArrow(_answer, schema)
    pairs = counted.select("a_id", F.col("pair").bitwiseAND(F.lit((1 << ID_BITS) - 1)).alias("b_id"), F.col("n").alias("n_docs"), "best")
    return answered, pairs

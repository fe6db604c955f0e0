"""Fill-in-middle transformation of texts cut into units, by arithmetic on eight bytes at a time.

A unit is a run of letters A-Z in either case or any other single character. The bytes of a text are viewed as
64-bit words; a handful of word operations mark in each byte's top bit whether a unit ends there. Ones are counted
per word, a search in their running sum finds the word that holds the k-th end, and a select inside that word its byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.textops import utf8_parts

U64 = np.uint64
TOP, LOW = U64(0x8080808080808080), U64(0x7F7F7F7F7F7F7F7F)
#: Marks before the three parts of a transformed text.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 documents so many are transformed, and so many of those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _repeated(byte: int) -> np.uint64:
    return U64(byte * 0x0101010101010101)


def as_words(text: bytes | memoryview) -> np.ndarray:
    """The bytes as little-endian words, with one zero byte after them at least."""
    words = np.zeros(len(text) // 8 + 1, "<u8")
    words.view(np.uint8)[: len(text)] = np.frombuffer(text, np.uint8)
    return words


def _next_byte(marks: np.ndarray) -> np.ndarray:
    """Each byte's mark moved to the byte before it, across words."""
    out = marks >> U64(8)
    out[:-1] |= marks[1:] << U64(56)
    return out


def letter_marks(words: np.ndarray) -> np.ndarray:
    """Top bit of every byte that is a letter A-Z or a-z."""
    low = (words | _repeated(0x20)) & LOW
    from_a, past_z = low + _repeated(0x80 - ord("a")), low + _repeated(0x80 - ord("z") - 1)
    return from_a & ~past_z & ~words & TOP


def inside_marks(words: np.ndarray) -> np.ndarray:
    """Top bit of every continuation byte 10xxxxxx."""
    return words & ~(words << U64(1)) & TOP


def _inside_text(marks: np.ndarray, n_bytes: int) -> np.ndarray:
    """Marks without those of the padding."""
    marks[-1] &= U64((1 << 8 * (n_bytes % 8)) - 1)
    return marks


def end_marks(words: np.ndarray, n_bytes: int) -> np.ndarray:
    """Top bit of every byte at which a unit ends: of a character's last byte, unless it and the next are letters."""
    letter = letter_marks(words)
    return _inside_text(TOP & ~_next_byte(inside_marks(words)) & ~(letter & _next_byte(letter)), n_bytes)


def select_ends(marks: np.ndarray, ranks: Iterable[int]) -> tuple[int, list[int]]:
    """(number of marks, byte offset after the k-th mark for each k of ``ranks``; 0 for k = 0)."""
    upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)
    out = []
    for k in ranks:
        if k == 0:
            out.append(0)
            continue
        at = int(np.searchsorted(upto, k))
        word, skip = int(marks[at]), k - (int(upto[at - 1]) if at else 0) - 1
        for _ in range(skip):
            word &= word - 1
        out.append(8 * at + (word & -word).bit_length() // 8)
    return int(upto[-1]), out


def code_points(marks_inside: np.ndarray, start: int, end: int) -> int:
    """Characters that start in bytes [start, end): bytes that continue none."""
    if end <= start:
        return 0
    first, last = start // 8, (end - 1) // 8
    part = marks_inside[first : last + 1].copy()
    part[-1] &= U64((1 << 8 * (end - 8 * last)) - 1)
    part[0] &= U64((1 << 64) - (1 << 8 * (start - 8 * first)))
    return end - start - int(np.bitwise_count(part).sum())


def transform(text: bytes, form: str, prefix: int, middle: int) -> bytes:
    """The text in ``form`` with its prefix ending at byte ``prefix`` and its middle at byte ``middle``."""
    a, b, c = text[:prefix], text[prefix:middle], text[middle:]
    if form == "psm":
        return b"".join([PREFIX, a, SUFFIX, c, MIDDLE, b])
    if form == "spm":
        return b"".join([SUFFIX, c, PREFIX, a, MIDDLE, b])
    return text


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform`` was given; the parts hold no mark, so the first of each is the one put there."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    head, rest = output.removeprefix(first).split(second, 1)
    tail, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (head, tail) if form == "psm" else (tail, head)
    return prefix + middle + suffix


def choose(text: bytes, h: tuple[int, int, int, int]) -> tuple[int, str, int, int, int | None, int | None]:
    """(units, form, prefix end, middle end, characters of prefix, of middle) of a text and its four random numbers."""
    words = as_words(text)
    marks = end_marks(words, len(text))
    n = int(np.bitwise_count(marks).sum())
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= TRANSFORMED:
        return n, "plain", 0, 0, None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    _, (prefix, middle) = select_ends(marks, (low, high))
    inside = _inside_text(inside_marks(words), len(text))
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    return n, form, prefix, middle, code_points(inside, 0, prefix), code_points(inside, prefix, middle)


def transformed(texts: Iterator[tuple[bytes, tuple[int, int, int, int]]]) -> Iterator[tuple]:
    """(units, form, characters of prefix, of middle, output) of each text."""
    for text, h in texts:
        n, form, prefix, middle, n_prefix, n_middle = choose(text, h)
        yield n, form, n_prefix, n_middle, transform(text, form, prefix, middle)


def random_numbers(seed: str, doc_id: str = "doc_id") -> list:
    """Four columns of random numbers below 2**32 that follow from the seed and the id alone."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _prepared(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *random_numbers(seed))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, tuple[int, int, int, int]]]:
    data, offsets = utf8_parts(batch.column(1))
    view = memoryview(data)
    numbers = zip(*[batch.column(i).to_pylist() for i in range(2, 6)], strict=True)
    for a, b, h in zip(offsets.tolist(), offsets[1:].tolist(), numbers, strict=False):
        yield bytes(view[a:b]), h


def fill_middle(docs: DataFrame, seed: str = "1:") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the transformed text of every row of ``docs`` (doc_id, text).

    A null or empty text, or one with a mark in it, stays plain. A null id draws its numbers from the seed alone, repeated rows
    give equal rows, other columns are ignored, an empty table gives an empty one. One pass without a shuffle; a text
    of any length takes a few arrays of its own size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*transformed(_texts(batch)), strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(rows[:4], kinds, strict=True)]
            output = pa.array(rows[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, output], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return _prepared(docs, seed).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_middle_digests(docs: DataFrame, seed: str = "1:") -> DataFrame:
    """The columns of ``fill_middle`` with hashes of the output and of the text restored from it, made in the same task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = [(n, form, p, m, sha(out), sha(restore(out, form))) for n, form, p, m, out in transformed(_texts(batch))]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [c.split()[0] for c in SCHEMA.split(", ")])

    return _prepared(docs, seed).mapInArrow(run, SCHEMA)


SQL = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (
  SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS a, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS b, coalesce(array_to_string(u[hi + 1:], ''), '') AS c FROM f)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b WHEN 'spm' THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p"""

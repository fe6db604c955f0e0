"""Token counts by a merge tokenizer compiled to a finite-state transducer.

The encoding of a text is a sequence of tokens each two neighbours of which also encode to themselves
when they stand alone, and every prefix of the sequence encodes the text it covers. So the last
token of each prefix of a text follows from the last tokens of the prefixes that a vocabulary piece may still
continue, and those, with their counts relative to the newest one, are the state of a deterministic
transducer over bytes. A transition carries the number of tokens by which the encoding grows (it shrinks when
a merge takes tokens back). States and transitions are compiled when a text first needs them and kept in flat tables.

Texts are cut into chunks that advance side by side, one table look-up a byte for all chunks of a block. A
chunk that starts where no piece can reach across has one entry state, and its map is constant; any other
chunk is tabulated for the states that its left context suggests and completed for the states that reach it.
The maps (entry state to exit state and count) are then composed by a parallel prefix scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.textops import BLOCK_BYTES, blocks, utf8_parts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: States kept at a time; the table takes 1 kB for each.
MOST_STATES = 160_000
#: Bytes of a chunk, and characters of left context from which a chunk without a safe start guesses its entry states.
CHUNK, CONTEXT = 512, 16


class MergeRules:
    """The pieces of a sentencepiece merge model, and which pairs of tokens may stand side by side."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = proto.ModelProto.SentencePiece
        rules, trained = model.normalizer_spec, model.trainer_spec
        plain = rules.name == "identity" and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and rules.add_dummy_prefix
        odd = [p for p in model.pieces if p.type in (kinds.USER_DEFINED, kinds.UNUSED)]
        if not plain or odd or trained.model_type != trained.BPE or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("only merge models with byte fallback, a leading blank and no normalisation can be compiled")
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.letters = set("".join(self.score))
        #: Proper beginnings of pieces: what a later character may continue.
        self.begun = {p[:i] for p in self.score for i in range(1, len(p))}
        #: Neighbouring characters that some piece holds; between others a token always ends.
        self.joined = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.forget()

    def forget(self) -> None:
        self._whole: dict[str, bool] = {}
        self._beside: dict[tuple[str, str], bool] = {}
        self._reached: dict[tuple[str, str], bool] = {}

    def encode(self, text: str) -> list[str]:
        """Merge neighbours, the best score and then the leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            found = [(-score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in score]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def is_token(self, text: str) -> bool:
        """Whether the text encodes to itself as one token (a character outside of the vocabulary does)."""
        known = self._whole.get(text)
        if known is None:
            known = self._whole[text] = len(text) == 1 or (text in self.score and self.encode(text) == [text])
        return known

    def beside(self, left: str | None, right: str) -> bool:
        """Whether ``left`` and ``right`` stay two tokens when they meet; None is the start of a text."""
        if left is None or left[-1] + right[0] not in self.joined:
            return True
        known = self._beside.get((left, right))
        if known is None:
            known = self._beside[left, right] = self.encode(left + right) == [left, right]
        return known

    def reaches(self, left: str, begun: str) -> bool:
        """Whether an end of ``left`` could merge with a beginning of some piece that begins with ``begun``."""
        known = self._reached.get((left, begun))
        if known is None:
            ends, score = [left[i:] for i in range(len(left))], self.score
            known = any(e + begun in self.begun or any(e + begun[:n] in score for n in range(1, len(begun) + 1)) for e in ends)
            self._reached[left, begun] = known
        return known

    def weight(self, token: str) -> int:
        """Tokens that are counted: one, or the bytes of a character outside of the vocabulary."""
        return 1 if token in self.score else len(token.encode())


class Transducer:
    """Deterministic transducer over UTF-8 bytes; state 0 is the start of a text.

    A state is (begun piece, for each place where a piece may have begun the last token before it and its count
    relative to the newest count) or, inside a character, the state before it and the bytes read.
    """

    def __init__(self, rules: MergeRules, most_states: int = MOST_STATES) -> None:
        self.rules, self.most = rules, most_states
        self._clear()

    def _clear(self) -> None:
        self.rules.forget()
        self.objects: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        #: By 256 * state + byte: 64 * next state + 32 + tokens gained; -1 where not compiled.
        self.table = np.full(256 * 1024, -1, np.int32)
        self.number(("", ((None, 0),)))

    def number(self, state: tuple) -> int:
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.objects)
            self.objects.append(state)
            if 256 * (n + 1) > len(self.table):
                self.table = np.concatenate([self.table, np.full(max(256 * 1024, len(self.table) // 4), -1, np.int32)])
        return n

    def make_room(self, *held: np.ndarray) -> list[np.ndarray]:
        """Forget all states but those in ``held`` once there are too many; returns ``held`` in new numbers."""
        if len(self.objects) <= self.most:
            return list(held)
        olds = [[self.objects[s] for s in np.unique(h)] for h in held]
        uniques = [np.unique(h) for h in held]
        self._clear()
        out = []
        for h, old, unique in zip(held, olds, uniques, strict=True):
            new = np.array([self.number(s) for s in old], np.int64)
            out.append(new[np.searchsorted(unique, h)] if len(h) else h)
        return out

    def after(self, state: tuple, letter: str) -> tuple[tuple, int]:
        """(state after a character, tokens gained)."""
        begun, last = state
        rules = self.rules
        if letter not in rules.letters:
            return ("", ((None, 0),)), len(letter.encode())
        text = begun + letter
        for size in range(len(text), 0, -1):
            token, before = text[-size:], last[size - 1]
            if before is not None and rules.is_token(token) and rules.beside(before[0], token):
                break
        gain = before[1] + rules.weight(token)
        while text and text not in rules.begun:
            text = text[1:]
        # The last token before a place matters only if a piece can join it to what has begun there.
        kept = [(token, 0)]
        for size in range(1, len(text) + 1):
            old, tail = last[size - 1], text[-size:]
            if old is None or tail not in rules.begun:
                kept.append(None)
            else:
                kept.append((old[0] if old[0] and rules.reaches(old[0], tail) else None, old[1] - gain))
        return (text, tuple(kept)), gain

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Fill in one transition: (next state, tokens gained)."""
        found = self.objects[state]
        base, read = (found[1], found[2]) if found[0] is None else (found, b"")
        read += bytes([byte])
        size = 1 if read[0] < 0xC0 else 2 if read[0] < 0xE0 else 3 if read[0] < 0xF0 else 4
        if len(read) < size:
            new, gain = (None, base, read), 0
        else:
            letter = read.decode("utf-8", "replace")
            new, gain = self.after(base, SPACE if letter == " " else letter)
        n = self.number(new)
        self.table[256 * state + byte] = 64 * n + 32 + gain
        return n, gain

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray, *held: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(exit states, tokens gained, ``held`` in current numbers) of runs over data[start:end], all in step."""
        size = end - start
        order = np.argsort(-size, kind="stable")
        at, now, count = start[order].astype(np.int64), state[order].astype(np.int64), np.zeros(len(order), np.int64)
        left = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
        for n in left.tolist():
            key = now[:n] * 256 + data[at[:n]]
            to = self.table.take(key)
            if to.min(initial=0) < 0:
                for k in set(key[to < 0].tolist()):
                    self.compile(k >> 8, k & 255)
                to = self.table.take(key)
            count[:n] += (to & 63) - 32
            now[:n] = to >> 6
            at[:n] += 1
            if len(self.objects) > self.most:
                now, *held = self.make_room(now, *held)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return now[back], count[back], list(held)


def cut_chunks(data: np.ndarray, offsets: np.ndarray, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, document, safe) of chunks of about ``size`` bytes; a safe one starts with a blank that no blank precedes.

    A chunk starts at the first safe place of the next ``size`` bytes, and where there is none at a character.
    """
    n = len(data)
    safe_at = np.zeros(n + 1, bool)
    if n:
        # 0x81 may end a blank that is written as the blank symbol of the vocabulary.
        safe_at[1:n] = (data[1:] == 32) & (data[:-1] != 32) & (data[:-1] != 0x81)
    safe = np.append(np.flatnonzero(safe_at), n)
    length = np.diff(offsets)
    pieces = np.maximum(length // size, 1)
    doc = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = offsets[doc] + nth * size
    found = safe[np.searchsorted(safe, start)]
    is_safe = (nth > 0) & (found < np.minimum(start + size, offsets[doc + 1]))
    start = np.where(is_safe, found, start)
    for _ in range(3):
        inside = (nth > 0) & ((data[np.minimum(start, max(n - 1, 0))] & 0xC0) == 0x80) if n else np.zeros(len(start), bool)
        start = start + (inside & (start < offsets[doc + 1]))
    keep = np.ones(len(start), bool)
    keep[1:] = (nth[1:] == 0) | (start[1:] > start[:-1])
    keep &= (nth == 0) | (start < offsets[doc + 1])
    return start[keep], doc[keep], is_safe[keep]


def _guesses(data: np.ndarray, start: int, low: int) -> list[int]:
    """Starts of the characters shortly before ``start``, from which a run may guess the state there."""
    out, at = [], start
    while at > low and len(out) < CONTEXT:
        at -= 1
        while at > low and data[at] & 0xC0 == 0x80:
            at -= 1
        out.append(at)
    return out


def count_block(machine: Transducer, data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Tokens of every text of a block."""
    n_docs = len(offsets) - 1
    filled = np.flatnonzero(np.diff(offsets) > 0)
    out = np.zeros(n_docs, np.int64)
    if not len(filled):
        return out
    machine.make_room()
    first_state, first_gain = machine.compile(0, 32)
    start, doc, safe = cut_chunks(data, offsets, chunk)
    keep = np.diff(offsets)[doc] > 0
    start, doc, safe = start[keep], doc[keep], safe[keep]
    n = len(start)
    opens = np.append(True, doc[1:] != doc[:-1])
    end = np.append(start[1:], len(data))
    end = np.minimum(end, offsets[doc + 1])
    # The entries of each chunk: one for a safe start, for others what the characters before it lead to.
    of, entry = [np.arange(n)[opens | safe]], [np.where(opens, first_state, 0)[opens | safe]]
    guess = [(c, at) for c in np.flatnonzero(~opens & ~safe).tolist() for at in _guesses(data, int(start[c]), int(offsets[doc[c]]))]
    if guess:
        c, at = np.array(guess, np.int64).T
        state, _, entry = machine.run(data, at, start[c], np.zeros(len(c), np.int64), *entry)
        pairs = np.unique(np.stack([c, state]), axis=1)
        of.append(pairs[0])
        entry.append(pairs[1])
    of, entry = np.concatenate(of), np.concatenate(entry)
    leave, count, (entry,) = machine.run(data, start[of], end[of], entry, entry)
    constant = np.append(opens[1:] | safe[1:], True)
    closes = np.append(opens[1:], True)
    while True:
        # Rows of the maps in order of (chunk, entry); a row leads to the row of the next chunk that its exit enters.
        order = np.lexsort((entry, of))
        of, entry, leave, count = of[order], entry[order], leave[order], count[order]
        base = int(max(entry.max(), leave.max())) + 1
        key = of * base + entry
        first_row = np.searchsorted(of, np.arange(n))
        wanted = np.where(constant[of], 0, (of + 1) * base + leave)
        row = np.searchsorted(key, wanted)
        hit = ~constant[of] & (row < len(key)) & (key[np.minimum(row, len(key) - 1)] == wanted)
        step = np.where(hit, row, -1)
        step = np.where(constant[of] & ~closes[of], first_row[np.minimum(of + 1, n - 1)], step)
        lost = ~constant[of] & ~hit
        if not lost.any():
            break
        # Complete the maps for states that no guess foresaw.
        pairs = np.unique(np.stack([of[lost] + 1, leave[lost]]), axis=1)
        more, gained, (entry, leave, come) = machine.run(data, start[pairs[0]], end[pairs[0]], pairs[1], entry, leave, pairs[1])
        of, entry = np.append(of, pairs[0]), np.append(entry, come)
        leave, count = np.append(leave, more), np.append(count, gained)
    # Parallel prefix: every round composes each row's map with the one that it leads to, doubling the reach.
    total, to = count, step
    while (to >= 0).any():
        on = to >= 0
        far = np.where(on, to, 0)
        total, to = total + np.where(on, total[far], 0), np.where(on, to[far], -1)
    out[filled] = total[first_row[opens]] + first_gain
    return out


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(MergeRules(path))


def _well_formed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with every byte that is no UTF-8 replaced by U+FFFD."""
    raw = data.tobytes()
    try:
        raw.decode()
        return data, offsets
    except UnicodeDecodeError:
        mended = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets, offsets[1:], strict=False)]
        return np.frombuffer(b"".join(mended), np.uint8), np.concatenate([[0], np.cumsum([len(m) for m in mended])]).astype(np.int64)


def _count_batches(path: str, text_at: int, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]):
        machine = transducer(path)
        for batch in batches:
            data, offsets = _well_formed(*utf8_parts(batch.column(text_at)))
            counts = np.zeros(batch.num_rows, np.int64)
            for lo, hi in blocks(offsets, BLOCK_BYTES):
                a, b = offsets[lo], offsets[hi]
                counts[lo:hi] = count_block(machine, data[a:b], offsets[lo : hi + 1] - a)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts)], names)

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text), in one pass without a shuffle.

    A null or empty text has no tokens. Repeated rows and rows without a doc_id are counted each by itself, other columns are
    ignored, an empty table gives an empty one. A text of any length is cut into chunks, so it needs memory for
    some forty times its bytes and no more steps than a short one needs for each chunk.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_count_batches(path, 2, ["doc_id", "n_bytes", "n_tokens"]), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

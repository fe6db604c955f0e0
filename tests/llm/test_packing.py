import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadspark.llm.packing import CachedEncoder, SumIndex, _encoder, pack_documents, plan_packing, tokenizer_path
from tests.llm.fixtures import awkward_docs, empty_docs


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    docs = awkward_docs(spark)
    want = []
    for r in docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r["doc_id"], i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = pack_documents(docs, tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(r["length"] for r in got) // 2048)


def test_empty_table(spark):
    assert pack_documents(empty_docs(spark), tokenizer_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_uses_every_piece_once(histogram):
    used = {}
    for parts, times in plan_packing(histogram, 64):
        assert sum(parts) <= 64
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == histogram


def test_exact_complements_fill_up():
    assert sum(t for _, t in plan_packing({60: 5, 40: 5, 30: 5, 70: 5, 50: 4, 20: 4, 10: 4}, 100)) == 14


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1,.😀 ", max_size=60))
def test_cached_encoder_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    encode = CachedEncoder(tokenizer_path())
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_exact_triples_are_found_however_deep():
    counts = np.zeros(2049, np.int64)
    counts[801:901] = 1
    counts[[300, 333, 367]] = 1
    assert SumIndex(counts.tolist()).fill(1000) == [367, 333, 300]
    rnd = random.Random(6)
    for _ in range(400):
        counts = np.zeros(61, np.int64)
        for _ in range(rnd.randrange(1, 9)):
            counts[rnd.randrange(1, 61)] += rnd.randrange(1, 3)
        gap, there = rnd.randrange(1, 100), [int(n) for n in np.repeat(np.arange(61), counts)]
        fits = any(sum(parts) == gap for k in (1, 2, 3) for parts in itertools.combinations(there, k))
        found = SumIndex(counts.tolist()).fill(gap)
        assert (found is not None) == fits
        if found:
            assert sum(found) == gap and (np.bincount(found, minlength=61) <= counts).all()


def test_index_stays_right_as_stock_falls():
    rnd = random.Random(8)
    for _ in range(40):
        counts = [0] * 61
        for _ in range(10):
            counts[rnd.randrange(1, 61)] += rnd.randrange(1, 3)
        index = SumIndex(counts)
        for _ in range(20):
            gap = rnd.randrange(1, 61)
            there = [n for n in range(61) for _ in range(counts[n])]
            fits = any(sum(parts) == gap for k in (1, 2, 3) for parts in itertools.combinations(there, k))
            found = index.fill(gap)
            assert (found is not None) == fits
            for n in found or ():
                counts[n] -= 1
            assert min(counts) >= 0


def test_every_text_of_the_tables_equals_the_tokenizer():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encode, tok = CachedEncoder(tokenizer_path(), 5000), Tokenizer.from_file(tokenizer_path())
    for text in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        assert np.frombuffer(encode(text or ""), "<u4").tolist() == tok.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzAZÀÖØöøÿéß.,;:!?'’-×÷ 0", max_size=40))
def test_plain_words_equal_the_tokenizer(text):
    encode = _encoder(tokenizer_path())
    assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_keep_their_ids():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b<|endoftext|>"
    assert np.frombuffer(CachedEncoder(tokenizer_path())(text), "<u4").tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids == [64, 220, 50256, 275, 50256]

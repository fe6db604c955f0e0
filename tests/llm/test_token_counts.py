import random

import numpy as np
import pytest
import sentencepiece

from leadspark.llm import token_counts as tc
from leadspark.llm.packing import tokenizer_path
from tests.llm.fixtures import awkward_docs, empty_docs

PATH = tokenizer_path(tc.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def laid(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def random_texts(library, seed, n):
    rnd = random.Random(seed)
    pieces = [library.id_to_piece(i).replace("▁", " ") for i in range(259, library.get_piece_size())]
    odd = ["a", "th", "e", " ", "▁", "é", "中", "🙂", "\n", "\0", "  ", "<s>", "<0x41>", "1"]
    out = []
    for _ in range(n):
        k, kind = rnd.randint(0, 60), rnd.randrange(5)
        if kind == 0:
            out.append("".join(rnd.choice(pieces) for _ in range(k)))
        elif kind == 1:
            out.append("".join(rnd.choice("ab ") for _ in range(5 * k)))
        elif kind == 2:
            out.append("".join(rnd.choice(pieces).strip() for _ in range(3 * k)))
        elif kind == 3:
            out.append("".join(rnd.choice(odd) for _ in range(3 * k)))
        else:
            out.append(rnd.choice(["a", "e", " ", "th", "中"]) * (20 * k) + "x")
    return out


@pytest.mark.parametrize("chunk", [8, 37, 512])
def test_any_text_in_any_chunks(library, chunk):
    machine = tc.transducer(PATH)
    for seed in range(12):
        texts = random_texts(library, seed, 25)
        assert tc.count_block(machine, *laid(texts), chunk).tolist() == [len(x) for x in library.encode(texts)]


def test_states_are_forgotten_and_made_again(library):
    machine = tc.Transducer(tc.MergeRules(PATH), most_states=60)
    for seed in range(6):
        texts = random_texts(library, seed, 12)
        assert tc.count_block(machine, *laid(texts), 32).tolist() == [len(x) for x in library.encode(texts)]
        assert len(machine.objects) <= 60 + sum(map(len, texts))


def test_maps_of_unsafe_chunks_are_composed(library):
    """One long word: no chunk but the first has a safe start, and each entry state comes from its left context or from the scan."""
    word = "thetheonedonisteronandingthat" * 400
    start, _, safe = tc.cut_chunks(*laid([word]), 64)
    assert len(start) > 100 and not safe.any()
    assert tc.count_block(tc.transducer(PATH), *laid([word, "", word[:700]]), 64).tolist() == [len(library.encode(t)) for t in (word, "", word[:700])]


def test_rules_encode_like_the_library(library):
    rules = tc.MergeRules(PATH)
    for i in range(259, library.get_piece_size(), 37):
        piece = library.id_to_piece(i)
        text = piece.removeprefix(tc.SPACE)
        if text and tc.SPACE not in text and piece != text:
            assert rules.encode(piece) == library.encode(text, out_type=str)


def test_documents(spark, library):
    docs = awkward_docs(spark)
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in docs.collect()]
    got = tc.count_tokens(docs, PATH, limit=200).collect()
    assert sorted(map(tuple, got)) == sorted((d, b, n, n > 200) for d, b, n in want)


def test_long_and_nameless_texts(spark, library):
    rows = [(None, "one two"), (None, "one two"), (5, "word and word " * 100_000), (6, "x" * 1_100_000), (7, None)]
    got = tc.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == sorted((d or 0, len(library.encode(t or ""))) for d, t in rows)


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert tc.count_tokens(docs, PATH).first()["n_tokens"] > 0


def test_empty_table(spark):
    assert tc.count_tokens(empty_docs(spark), PATH).collect() == []

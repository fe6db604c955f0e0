"""Texts over the block that the byte operators work in: what lies across its border is found like anything else."""

import random

import pytest

from leadspark.llm.decontaminate import find_leaks
from leadspark.llm.near_dedup import near_duplicate_groups
from leadspark.llm.packing import pack_documents, tokenizer_path
from leadspark.llm.secret_scan import scan_secrets
from leadspark.llm.textops import BLOCK_BYTES


@pytest.fixture(scope="module")
def long_text():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    out, size = [], 0
    while size < BLOCK_BYTES + 200_000:
        out.append(rnd.choice(words))
        size += len(out[-1]) + 1
    return " ".join(out)


def test_near_duplicates(spark, long_text):
    words = long_text.split()
    edited = list(words)
    for at in range(500, len(words), 100):
        edited[at] = "edited"
    rows = [(3, long_text), (1, " ".join(edited)), (2, "short and other text of seven words"), (9, long_text)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = lambda w: len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert got == {1: (shingles(edited), 1, True), 3: (shingles(words), 1, False), 9: (shingles(words), 1, False), 2: (3, 2, True)}


def test_leak_across_the_border(spark, long_text):
    item = " ".join(f"item{i}" for i in range(30))
    at = long_text.index(" ", BLOCK_BYTES - 90)
    docs = spark.createDataFrame([(1, long_text[:at] + f" {item} " + long_text[at:]), (2, long_text)], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["score"], r["begin_word"]) for r in got] == [(1, 5, 1.0, long_text[:at].count(" ") + 1)]


def test_secret_across_the_border(spark, long_text):
    at = long_text.index(" ", BLOCK_BYTES - 12)
    rows = [(1, long_text[:at] + " password=Abcdefgh12345678 " + long_text[at:]), (2, long_text)]
    got = {r["doc_id"]: r["n_assign"] for r in scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0}


def test_pieces(spark, long_text):
    from tokenizers import Tokenizer

    ids = len(Tokenizer.from_file(tokenizer_path()).encode(long_text, add_special_tokens=False).ids) + 1
    got = pack_documents(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), tokenizer_path()).collect()
    assert sum(r["length"] for r in got) == ids and len(got) == -(-ids // 2048) and max(r["start"] + r["length"] for r in got) == ids

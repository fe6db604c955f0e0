import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadspark.llm import token_alignment as ta
from leadspark.llm.packing import tokenizer_path
from tests.llm.fixtures import awkward_docs, empty_docs

A, B = tokenizer_path(ta.TOKENIZER_A), tokenizer_path(ta.MODEL_B)


@pytest.fixture(scope="module")
def both():
    return ta.TwoEncoders(A, B)


def plain_tokens(both, text):
    """Both libraries over the whole text, and the bytes of each token."""
    if not text:
        return [], [], [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text, num_threads=1)
    x, y = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]
    return (a, b, x, y) if b"".join(x) == b"".join(y) == (" " + text).encode() else ([], [], [], [])


def plain_links(x, y):
    spans = lambda parts: [(e - len(p), e) for p, e in zip(parts, np.cumsum([len(p) for p in parts]).tolist(), strict=True)]
    x, y = spans(x), spans(y)
    links = [(i, j) for i, (s, e) in enumerate(x) for j, (t, f) in enumerate(y) if s < f and t < e]
    shared = sorted({e for _, e in x} & {f for _, f in y})
    groups, low = [], 0
    for end in shared:
        groups.append(([i for i, (_, e) in enumerate(x) if low < e <= end], [j for j, (_, f) in enumerate(y) if low < f <= end]))
        low = end
    return links, groups


def test_documents_and_counts_against_all_pairs(spark, both):
    docs = awkward_docs(spark)
    found = []
    for r in docs.collect():
        a, b, x, y = plain_tokens(both, r["text"])
        if len(a) > 3000:
            # The long document stays cheap to check: its links come from the interval sweep.
            ends = sorted(set(np.cumsum([len(p) for p in x]).tolist()) | set(np.cumsum([len(p) for p in y]).tolist()))
            ea, eb = np.cumsum([len(p) for p in x]), np.cumsum([len(p) for p in y])
            links = [(int(np.searchsorted(ea, e)), int(np.searchsorted(eb, e))) for e in ends]
            _, groups = [], []
            i = j = 0
            for e in sorted(set(ea.tolist()) & set(eb.tolist())):
                k, m = int(np.searchsorted(ea, e)) + 1, int(np.searchsorted(eb, e)) + 1
                groups.append((list(range(i, k)), list(range(j, m))))
                i, j = k, m
        else:
            links, groups = plain_links(x, y)
        text = ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups)
        found.append((r["doc_id"], len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], hashlib.sha256(text.encode()).hexdigest() if a else ""))
    held = Counter(p for f in found for p in set(f[4]))
    top = {}
    for (i, _), n in held.items():
        top[i] = max(top.get(i, 0), n)
    want = [(d, n, m, g, len(p), sum(held[q] == top[q[0]] for q in p), sum(held[q] for q in p), s) for d, n, m, g, p, s in found]
    for block in (300, ta.BLOCK):
        got, pairs = ta.align_tokens(docs, A, B, block)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert {(r["a_id"], r["b_id"]): (r["n_docs"], r["best"]) for r in pairs.collect()} == {q: (n, n == top[q[0]]) for q, n in held.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=80), st.lists(st.integers(1, 4), max_size=80), st.integers(0, 60))
def test_runs_and_groups_of_any_ends(a, b, same):
    a, b = [1] * same + a, [1] * same + b
    short = sum(a) - sum(b)
    (b if short > 0 else a).extend([1] * abs(short))
    x, y = np.cumsum(a, dtype=np.int64), np.cumsum(b, dtype=np.int64)
    diagonals, groups = (d.tolist() for d in ta.align(x, y))
    closes = sorted([int(x[i + k]) for i, _, n in diagonals for k in range(n)] + [int(x[k - 1]) for _, k, _, _ in groups])
    assert closes == sorted(set(x.tolist()) & set(y.tolist()))
    assert all((x[i : i + n] == y[j : j + n]).all() for i, j, n in diagonals)
    assert sum(n for *_, n in diagonals) + sum(k - i for i, k, _, _ in groups) == len(a)
    left, right = ta.all_links(x, y, *ta.align(x, y)) if a else ([], [])
    both = sorted(set(x.tolist()) | set(y.tolist()))
    assert sorted(zip(left, right, strict=True)) == [(int(np.searchsorted(x, e)), int(np.searchsorted(y, e))) for e in both]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1,.😀▁ ​\0 <|endoftext|>", max_size=60))
def test_units_give_the_libraries_ids(both, text):
    a, b, _, _ = plain_tokens(both, text)
    got = both([text, "", text])
    assert [x.tolist() for x in got] == [2 * a, 2 * b, [len(a), 0, len(a)], [len(b), 0, len(b)]]


def test_full_cache_starts_anew():
    small = ta.TwoEncoders(A, B, most=5)
    for text in ("one two three four five six seven", "eight nine ten one two"):
        a, b, _, _ = plain_tokens(small, text)
        got = small([text])
        assert (got[0].tolist(), got[1].tolist()) == (a, b)


def test_repeated_and_nameless_rows_and_a_text_of_megabytes(spark, both):
    rows = [(None, "one two"), (None, "one two"), (5, "one two"), (6, None), (7, "a▁b"), (8, "word " * 300_000)]
    got, _ = ta.align_tokens(spark.createDataFrame(rows, "doc_id long, text string"), A, B)
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    assert got.count() == 6 and by[5]["count_sum"] == 3 * by[5]["n_links"]
    assert by[6]["groups_sha256"] == by[7]["groups_sha256"] == "" and by[7]["n_a"] == 0
    assert by[8]["n_a"] == len(both.a.encode(" " + rows[5][1], add_special_tokens=False).ids)


def test_empty_table(spark):
    got, pairs = ta.align_tokens(empty_docs(spark), A, B)
    assert got.collect() == [] and pairs.collect() == []

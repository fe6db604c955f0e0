import random

import numpy as np

from leadspark.llm.decontaminate import GAP, MATCH, MISMATCH, PIECE, align, find_leaks, most_matches, pieces
from tests.llm.fixtures import awkward_docs


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max()


def test_alignment_equals_the_textbook():
    rnd = random.Random(2)
    jobs = [(np.array([rnd.randrange(5) for _ in range(rnd.randrange(1, 14))], np.uint64), np.array([rnd.randrange(5) for _ in range(rnd.randrange(0, 25))], np.uint64)) for _ in range(60)]
    score, begin, end = align(jobs)
    for (a, b), s, x, y in zip(jobs, score, begin, end, strict=True):
        assert s == smith_waterman(a, b)
        if s:
            assert smith_waterman(a, b[x:y]) == s


def test_copies_and_edits_are_found_and_clean_rows_are_not(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdéfghij") for _ in range(rnd.randrange(2, 8)))
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", word(), word()]) for _ in range(n))
    items = [(i, prose(40)) for i in range(12)]
    rows, want = [], set()
    for i in range(120):
        text = prose(rnd.randrange(30, 200))
        if i % 3 == 0:
            item, passage = items[i % 12]
            parts = passage.upper().split() if i % 2 else passage.split()
            for _ in range(rnd.randrange(0, 7)):
                at = rnd.randrange(len(parts))
                parts[at : at + 1] = rnd.choice([[], [word()], [parts[at], word()]])
            text = f"{text} {' '.join(parts)} {prose(20)}"
            want.add((i, item))
        rows.append((i, text))
    rows.append(rows[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (98, None), (99, ""), (0, items[0][1])], "item_id long, text string")
    for bits in (24, 8):
        got = find_leaks(docs, bench, bits=bits).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)


def test_awkward_rows_and_empty_benchmark(spark):
    docs = awkward_docs(spark)
    assert find_leaks(docs, spark.createDataFrame([(1, "zz yy xx ww vv uu")], "item_id long, text string")).collect() == []
    assert find_leaks(docs, spark.createDataFrame([], "item_id long, text string")).collect() == []
    assert find_leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).collect() == []


def test_many_edited_and_half_copies_are_found(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    items = [(1, [word() for _ in range(40)]), (2, [word() for _ in range(40)])]
    edited = ["changed" if i % 5 == 4 else w for i, w in enumerate(items[0][1])]
    half = items[1][1][:20]
    rows, want = [], set()
    for i in range(90):
        passage, item = ((edited, 1), (half, 2), ([], 0))[i % 3]
        rows.append((i, " ".join([*(word() for _ in range(50)), *passage, *(word() for _ in range(30))])))
        want |= {(i, item)} if item else set()
    rows.append((90, " ".join(" ".join([word(), *edited]) for _ in range(25))))
    want.add((90, 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()} == want


def test_bound_is_never_under_the_alignment():
    rnd = random.Random(5)
    for _ in range(200):
        a, b = (np.array([rnd.randrange(6) for _ in range(rnd.randrange(1, 20))], np.uint64) for _ in range(2))
        assert MATCH * most_matches(np.unique(a, return_counts=True), b) >= smith_waterman(a, b)


def test_short_items_are_found(spark):
    docs = spark.createDataFrame([(1, "here stands Zorblatt quux alone"), (2, "zorblatt here, quux there"), (3, "one gnarf"), (None, "zorblatt quux"), (None, "gnarf gnarf")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "zorblatt quux"), (8, "gnarf"), (9, "a b c d")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["begin_word"]) for r in find_leaks(docs, bench).collect()}
    assert got == {(1, 7): (1.0, 2), (3, 8): (1.0, 1), (None, 7): (1.0, 0), (None, 8): (1.0, 0)}


def test_equals_aligning_every_pair(spark):
    """Scores against a plain alignment of whole texts, wherever two seeds stand near each other."""
    rnd = random.Random(12)
    vocabulary = [f"v{i}" for i in range(30)]
    items = {i: [rnd.choice(vocabulary) for _ in range(rnd.randrange(4, 12))] for i in range(6)}
    texts = {}
    for i in range(40):
        part = list(items[i % 6])
        if i % 2:
            part[rnd.randrange(len(part))] = "edit"
        texts[i] = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 30))] + (part if i % 3 else [])
    number = {w: k for k, w in enumerate([*vocabulary, "edit"])}
    want = {}
    for d, t in texts.items():
        for k, item in items.items():
            share = smith_waterman([number[w] for w in item], [number[w] for w in t]) / (2 * len(item))
            grams = {tuple(item[i : i + 3]) for i in range(len(item) - 2)}
            seeds = {tuple(t[i : i + 3]) for i in range(len(t) - 2)} & grams
            if share >= 0.4 and len(seeds) >= min(2, len(grams)):
                want[d, k] = share
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in find_leaks(docs, bench).collect()}
    assert set(got) <= set(want) and all(got[x] == want[x] for x in got)
    whole = {(d, d % 6) for d in texts if d % 3 and d % 2 == 0}
    assert whole <= set(got) and len(got) >= 0.9 * len(want)


def test_long_windows_are_cut_without_loss(spark):
    for begin, end, size in ((0, 10, 5), (3, 50_000, 40), (0, PIECE + 1, 40), (7, 9_000, 3000)):
        cuts = pieces(begin, end, size, 0.4)
        reach = size + int(1.2 * size) + 1
        assert cuts[0][0] == begin and cuts[-1][1] == end
        assert all(b - c >= min(reach, end - c) for (_, b), (c, _) in zip(cuts, cuts[1:], strict=False))
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"{item} other " * 6000)], "doc_id long, text string")
    got = find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["item_id"], r["score"]) for r in got] == [(1, 1.0)]

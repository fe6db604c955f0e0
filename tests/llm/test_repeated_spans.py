import hashlib
import random
from collections import Counter

from leadspark.llm.repeated_spans import remove_repeats
from tests.llm.fixtures import awkward_docs, empty_docs


def brute(rows, length=200):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((doc, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(spark, docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(map(tuple, remove_repeats(docs).collect())) == want


def test_awkward_rows(spark):
    check(spark, awkward_docs(spark))


def test_repeats_of_every_kind(spark):
    rnd = random.Random(5)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    shared = [noise(n) for n in (199, 200, 201, 260, 900, 100)]
    rows = []
    for i in range(60):
        parts = [noise(rnd.randrange(0, 150))]
        for _ in range(rnd.randrange(0, 4)):
            s = rnd.choice(shared)
            a = rnd.randrange(0, max(1, len(s) - 190))
            parts += [s[a:], noise(rnd.randrange(0, 40))]
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, "a" * 200), (103, "x" + "a" * 199)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_real_rows(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table(spark):
    assert remove_repeats(empty_docs(spark)).collect() == []


def test_rows_without_id_lose_their_repeats_too(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh") for _ in range(400))
    rows = [(None, long), (4, "x" + long), (None, "short"), (None, "q" * 150), (0, long[:250] + "y")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((w[1], w[2], w[4]) for w in brute([(i, t) for i, (_, t) in enumerate(rows)]))


def test_hundreds_of_equal_rows(spark):
    """Copies of a row share its spans: lists of spans stay as long as those of one row."""
    rnd = random.Random(11)
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    same, other = noise(1500), noise(900)
    rows = [(None, same)] * 500 + [(7, same)] * 20 + [(8, other), (9, "x" + other[:400] + "y"), (None, None), (None, "")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == {(None, 1500, 1500): 500, (7, 1500, 1500): 20, (8, 900, 400): 1, (9, 402, 400): 1, (None, 0, 0): 2}


def test_text_over_a_block(spark):
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)]
    long = " ".join(rnd.choice(words) for _ in range(200_000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, long[(1 << 20) - 150 : (1 << 20) + 150]), (3, long[500:699])]
    got = {r["doc_id"]: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[3]["n_removed"]) == (300, 300, 0)

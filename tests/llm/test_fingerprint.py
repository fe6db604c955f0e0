import hashlib
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadspark.llm.fingerprint import delete, fingerprint_edits, fingerprints, insert, with_next
from tests.llm.fixtures import awkward_docs, empty_docs


def test_edits_and_equality(spark):
    docs = awkward_docs(spark).dropDuplicates(["doc_id"])
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    assert len(got) == len(rows)
    by_text = {}
    for i, (doc, text) in enumerate(rows):
        follows, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if edited == text:
            assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
    assert len(set(by_text.values())) == len(by_text)


def test_paragraph_order_does_not_matter_but_counts_do(spark):
    rows = [(1, "a b c\nd e f\ng h"), (2, "g h\na b c\nd e f"), (3, "g h\na b c\nd e f\ng h"), (4, "a b c d e f g h")]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_half_edited_texts_are_nearer_than_neighbours(spark):
    got = fingerprint_edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    long = got[got.n_chars > 300]
    assert (long.near_edited > long.near_next).mean() > 0.97
    assert 0.35 < long.near_edited.median() < 0.7


def test_repeated_rows_and_empty_table(spark):
    docs = awkward_docs(spark)
    assert fingerprint_edits(docs).count() == docs.count()
    assert fingerprint_edits(empty_docs(spark)).collect() == []


def plain_lanes(spark, texts):
    """Lanes in plain Python; Spark only hashes the word pairs."""
    pairs = {(a, b) for t in texts for p in t.split("\n") for a, b in zip(p.split(" "), [*p.split(" ")[1:], None], strict=True)}
    table = spark.createDataFrame(list(pairs), "l string, r string").select("l", "r", *[F.xxhash64("l", "r", F.lit(s)).alias(f"h{s}") for s in range(2)])
    hashed = {(r["l"], r["r"]): (r["h0"], r["h1"]) for r in table.collect()}
    out = {}
    for t in texts:
        identity, count, bits = [0] * 8, 0, [0] * 128
        for p in t.split("\n"):
            digest = hashlib.sha256(p.encode()).hexdigest()
            identity = [(x + int(digest[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(identity)]
            words = p.split(" ")
            for pair in zip(words, [*words[1:], None], strict=True):
                count += 1
                for s, h in enumerate(hashed[pair]):
                    for k in range(32):
                        bits[64 * s + 2 * k] += h >> (k + 32) & 1
                        bits[64 * s + 2 * k + 1] += h >> k & 1
        out[t] = ("".join(f"{x:08x}" for x in [*identity, count, *bits]), [2 * b - count for b in bits])
    return out


def test_equals_plain_python(spark):
    docs = awkward_docs(spark, 24).dropDuplicates(["doc_id"]).where("n_chars < 9000")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    edits = [t[: len(t) - len(t) // 2] + rows[(i + 1) % len(rows)][1][: len(t) // 2] for i, (_, t) in enumerate(rows)]
    lanes = plain_lanes(spark, {t for _, t in rows} | set(edits))
    cosine = lambda a, b: 1.0 if a == b else max(0.0, sum(map(float.__mul__, map(float, a), map(float, b))) / (math.hypot(*a) * math.hypot(*b) or 1))
    got = {r["doc_id"]: r for r in fingerprint_edits(docs).collect()}
    for i, (doc, text) in enumerate(rows):
        (own, a), (other, b), (_, c) = lanes[text], lanes[edits[i]], lanes[rows[(i + 1) % len(rows)][1]]
        assert (got[doc]["fingerprint"], got[doc]["edited_fingerprint"]) == (own, other)
        assert got[doc]["near_edited"] == pytest.approx(cosine(a, b)) and got[doc]["near_next"] == pytest.approx(cosine(a, c))


def test_insert_and_delete(spark):
    texts = ["a b\nc d", "e f g", "a b\ne f g\nc d", ""]
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    row = spark.createDataFrame([(got[0], got[1], got[2])], "a string, b string, c string").select(insert(F.col("a"), F.col("b")).alias("more"), delete(F.col("c"), F.col("b")).alias("less")).first()
    assert (row["more"], row["less"]) == (got[2], got[0])
    edited = {r["doc_id"]: r["fingerprint"] for r in fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert edited == got


def test_long_repetitions_do_not_wrap(spark):
    rows = [(1, "a " * 20_000), (2, "a " * 35_000)]
    got = {r["doc_id"]: r for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] > 0.99


def test_rows_without_id_come_first(spark):
    rows = [(None, "u v w x"), (5, "a b c d"), (9, "e f g h")]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((None, "u v a b"), (5, "a b e f"), (9, "e f u v"))}


def successors(rows):
    """Edited texts in plain Python; rows of one id stand in the order of their hashes, which the caller gives."""
    out = []
    for i, (doc, text) in enumerate(rows):
        follows, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        out.append((doc, hashlib.sha256((text[: len(text) - half] + follows[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


def test_ids_and_rows_repeated_thousands_of_times(spark):
    """A third of the rows has no id and one text, a third one id and many texts; none of them is one bucket."""
    rows = [(None, "same words here")] * 1500 + [(None, f"other {i}") for i in range(300)] + [(7, f"text number {i} of one id") for i in range(1500)] + [(i, f"doc {i} and its words") for i in range(100, 1300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).select("doc_id", "text", F.xxhash64("text").alias("hash")).cache()
    ordered = [(r["doc_id"], r["text"]) for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["hash"]))]
    buckets = with_next(docs, 200)
    sizes = {r["bucket"]: r["n"] for r in buckets.where("last = 0").groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) < 600 and len(sizes) > 15
    assert buckets.where("last = 1").count() == len(sizes)
    for per_bucket in (200, 10**9):
        order = Window.partitionBy("bucket").orderBy("last", "doc_id", "hash")
        told = with_next(docs, per_bucket).withColumn("follows", F.lead("text").over(order)).where("last = 0")
        n = F.char_length("text")
        edited = F.concat(F.substr("text", F.lit(1), n - F.floor(n / 2).cast("int")), F.substr("follows", F.lit(1), F.floor(n / 2).cast("int")))
        assert sorted(((r["doc_id"], r["e"]) for r in told.select("doc_id", F.sha2(edited, 256).alias("e")).collect()), key=str) == successors(ordered)


def test_text_over_a_megabyte(spark):
    rows = [(1, "alpha beta " * 120_000), (2, "gamma"), (3, "x" * 1_200_000)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sorted(got.items(), key=str) == successors(rows)

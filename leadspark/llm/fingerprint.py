"""Homomorphic multiset fingerprints of documents.

A paragraph hashes to a wide vector; a document's fingerprint is the sum of its paragraphs'
vectors, lane by lane, modulo a power of two. The order of paragraphs does not matter and a
paragraph is inserted or deleted by adding or subtracting its vector.

A vector has two parts: 8 lanes of 32 random bits of the paragraph's SHA-256 (identity,
modulo 2**32), and 128 lanes that count, over the paragraph's pairs of adjoining words, those whose
hash has that lane's bit set (likeness, modulo 2**32). The deviations of the second part from half
the pairs add up like random signs, so their cosine estimates the share of word pairs in common.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.store import text_or_empty

SEEDS, PACKED = 2, 32
LANES = SEEDS * PACKED * 2
#: Identity lanes, number of pairs, likeness lanes; 32 bits each.
WIDTH = 8 + 1 + LANES
#: The lowest id there can be.
LOWEST = -(1 << 63)
_PAIR_MASK = 0x0000000100000001


def _hex_lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substr(digest, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long") for k in range(8)]


def _identity_lanes(hashes: Column) -> list[Column]:
    """Identity part: 8 sums modulo 2**32 over the words of the paragraphs' SHA-256."""
    def total(k: int) -> Column:
        word = lambda h: F.conv(F.substr(h, F.lit(8 * k + 1), F.lit(8)), 16, 10).cast("long")
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: F.pmod(acc + word(h), F.lit(1 << 32)))

    return [total(k) for k in range(8)]


def paragraph_vectors(df: DataFrame, keys: list[str], text: str, carried: list[str]) -> DataFrame:
    """Sum of the paragraph vectors of every key: pairs, packed lane counts and ``carried`` longs."""
    rest = [*keys, *carried]
    paragraphs = df.select(*rest, F.explode(F.split(F.col(text), "\n", -1)).alias("_p"))
    words = paragraphs.select(*rest, F.split("_p", " ", -1).alias("_w"))
    following = F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0)))
    pairs = words.select(*rest, F.explode(F.arrays_zip(F.col("_w").alias("l"), following.alias("r"))).alias("_x"))
    hashed = pairs.select(*rest, *[F.xxhash64("_x.l", "_x.r", F.lit(s)).alias(f"_h{s}") for s in range(SEEDS)])
    sums = [F.sum(F.shiftrightunsigned(f"_h{s}", k).bitwiseAND(F.lit(_PAIR_MASK))).alias(f"_s{s}_{k}") for s in range(SEEDS) for k in range(PACKED)]
    return hashed.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), *[F.max(c).alias(c) for c in carried], *sums)


def _packed() -> list[Column]:
    return [F.col(f"_s{s}_{k}") for s in range(SEEDS) for k in range(PACKED)]


def _halves() -> Column:
    """The packed counts as one array of LANES counts."""
    low = F.lit(0xFFFFFFFF)
    return F.flatten(F.transform(F.array(*_packed()), lambda c: F.array(F.shiftrightunsigned(c, 32), c.bitwiseAND(low))))


def _hex(lanes: Column, digits: int) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda c: F.lpad(F.hex(F.pmod(c, F.lit(1 << (4 * digits)))), digits, "0")), ""))


def _columns(letter: str) -> Column:
    return F.array(*[F.col(f"_{letter}{k}") for k in range(8)])


def _fingerprint() -> Column:
    """Identity lanes, pair count and likeness lanes as fixed-width hexadecimal."""
    return F.concat(_hex(_columns("i"), 8), _hex(F.array("pairs"), 8), _hex(F.col("halves"), 8))


def _signed() -> Column:
    """Likeness lanes as deviations from the mean, read back modulo 2**32 around zero."""
    wrap = F.lit(1 << 31)
    return F.transform("halves", lambda c: F.pmod(2 * c - F.col("pairs") + wrap, 2 * wrap) - wrap)


def _merged(a: Column, b: Column, sign: int) -> Column:
    lane = lambda text, k: F.conv(F.substr(text, 8 * k + 1, F.lit(8)), 16, 10).cast("long")
    return _hex(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda k: lane(a, k) + sign * lane(b, k)), 8)


def insert(fingerprint: Column, paragraphs: Column) -> Column:
    """Fingerprint of a document once the paragraphs of another fingerprint have joined it, at any place."""
    return _merged(fingerprint, paragraphs, 1)


def delete(fingerprint: Column, paragraphs: Column) -> Column:
    """Fingerprint of a document once the paragraphs of another fingerprint have left it; undoes ``insert``."""
    return _merged(fingerprint, paragraphs, -1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of ``docs`` (doc_id, text); a null text is one empty paragraph."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    hashes = F.transform(F.split("text", "\n", -1), lambda p: F.sha2(p, 256))
    lanes = [c.alias(f"_i{k}") for k, c in enumerate(_identity_lanes(hashes))]
    parts = paragraph_vectors(rows.select("_row", "doc_id", "text", *lanes), ["_row"], "text", ["doc_id", *[f"_i{k}" for k in range(8)]])
    return parts.withColumn("halves", _halves()).select("doc_id", _fingerprint().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two signed lane vectors, 0 to 1; 1 for equal ones, 0 where one is all zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a == b, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(F.lit(0.0))


def _bucket(cuts: list[int], column: str) -> Column:
    """Number of ``cuts`` below a column; coarse edges first, then the fine ones of that stretch."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda edges: F.size(F.filter(edges, lambda e: e < F.col(column)))
    block = below(F.lit(cuts[step - 1 :: step]).cast("array<long>"))
    return block * step + below(F.slice(F.lit(cuts).cast("array<long>"), block * step + 1, F.lit(step)))


def _hash_edges(keyed: DataFrame, ids: dict[int, int]) -> DataFrame:
    """id, edges: as many quantiles of the hashes' leading 48 bits, which they hold exactly, of each id's rows as ``ids`` says."""
    out = []
    for times in sorted(set(ids.values())):
        hot = keyed.sparkSession.createDataFrame([(i,) for i, n in ids.items() if n == times], "id long")
        shares = [k / (times + 1) for k in range(1, times + 1)]
        out.append(keyed.join(F.broadcast(hot), "id").groupBy("id").agg(F.percentile_approx(F.shiftright("hash", 16), shares, 10 * times + 100).alias("edges")))
    return reduce(DataFrame.unionByName, out)


def with_next(docs: DataFrame, rows_per_bucket: int = 500, most_buckets: int = 20_000) -> DataFrame:
    """Rows of ``docs`` (doc_id, hash, text) in buckets that adjoin by (doc_id, hash): bucket, last, doc_id, hash, text.

    Bucket edges are quantiles of the ids, at most ``most_buckets`` of them. An id that two quantiles or more name has that many buckets to
    itself, cut at quantiles of its hashes; rows that share such a hash too are equal and are dealt to the buckets that it cuts. So no id and no
    row, however often it is repeated, is one task. Each bucket also gets one copy of the first row of the next one (after the last, the first
    of all), marked ``last``, so that every row finds its successor inside its bucket. Only edges and first keys reach the driver.
    """
    rows = docs.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    # Rows without an id come before all others, beside the lowest id there can be.
    keyed = docs.withColumn("id", F.coalesce("doc_id", F.lit(LOWEST)))
    wanted = max(1, min(most_buckets, rows // rows_per_bucket))
    quantiles: list[int] = []
    if wanted > 1:
        shares = [i / wanted for i in range(1, wanted)]
        quantiles = keyed.select(F.percentile_approx("id", shares, 10 * wanted + 100).alias("q")).first()["q"] or []
    hot = {i: n for i, n in Counter(quantiles).items() if n > 1}
    cuts = sorted(set(quantiles) | {i - 1 for i in hot if i > LOWEST})
    place = _bucket(cuts, "id").cast("long") * (most_buckets + 1)
    placed = keyed.withColumn("bucket", place)
    if hot:
        below, equal = (F.size(F.filter("edges", f)) for f in (lambda e: e < F.shiftright("hash", 16), lambda e: e == F.shiftright("hash", 16)))
        dealt = F.pmod(F.xxhash64(F.col("deal")), equal + 1)
        edges = F.broadcast(_hash_edges(keyed.select("id", "hash"), hot))
        placed = keyed.withColumn("deal", F.monotonically_increasing_id()).join(edges, "id", "left").withColumn("bucket", place + F.when(F.col("edges").isNotNull(), below + dealt).otherwise(0)).drop("edges", "deal")
    firsts = placed.groupBy("bucket").agg(F.min(F.struct("id", "hash")).alias("f"))
    ring = [(r["bucket"], r["f"]["id"], r["f"]["hash"]) for r in firsts.orderBy("bucket").collect()]
    before = F.broadcast(docs.sparkSession.createDataFrame([(i, h, ring[n - 1][0]) for n, (_, i, h) in enumerate(ring)], "id long, hash long, into long"))
    # Equal rows that are first of a bucket are one row in the bucket before.
    copies = keyed.join(before, ["id", "hash"]).groupBy("id", "hash", "into").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    names = ["bucket", "last", "doc_id", "hash", "text"]
    return placed.withColumn("last", F.lit(0)).select(names).unionByName(copies.withColumnRenamed("into", "bucket").withColumn("last", F.lit(1)).select(names))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, one row per row of ``docs``.

    The edited text replaces the last floor(n/2) code points by the first as many of the next
    document by ascending doc_id (the first after the last); a next text that is shorter is taken whole.
    Null texts are empty; an empty text has one empty paragraph. Rows that repeat a doc_id
    follow one another by a hash of their text; rows without a doc_id come before all others. One shuffle carries the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("bucket").orderBy("last", "doc_id", "hash")
    ring = with_next(rows).withColumn("rn", F.row_number().over(order)).withColumn("follows", F.lead("text").over(order))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("follows", F.lit("")), F.lit(1), half))
    texts = ring.select("bucket", "rn", "last", "doc_id", n.cast("long").alias("n_chars"), F.when(F.col("last") == 1, F.array("text")).otherwise(F.array(F.col("text"), edited)).alias("v"))
    variants = texts.select("bucket", "rn", "last", "doc_id", "n_chars", F.posexplode("v").alias("variant", "text"))
    digests = variants.withColumns({"sha": F.sha2("text", 256), "hashes": F.transform(F.split("text", "\n", -1), lambda p: F.sha2(p, 256))})
    keys, facts = ["bucket", "rn", "variant"], ["last", "doc_id", "n_chars", *[f"_e{k}" for k in range(8)], *[f"_i{k}" for k in range(8)]]
    lanes = [*[c.alias(f"_e{k}") for k, c in enumerate(_hex_lanes(F.col("sha")))], *[c.alias(f"_i{k}") for k, c in enumerate(_identity_lanes(F.col("hashes")))]]
    parts = paragraph_vectors(digests.select(*keys, "last", "doc_id", "n_chars", "text", *lanes), keys, "text", facts)
    prints = parts.withColumn("halves", _halves()).select(*keys, "last", "doc_id", "n_chars", _hex(_columns("e"), 8).alias("sha"), _fingerprint().alias("print"), _signed().alias("lanes"))
    by_row = Window.partitionBy("bucket").orderBy("rn", "variant")
    told = prints.select("*", *[F.lead(c).over(by_row).alias(f"{c}1") for c in ("sha", "print", "lanes")], F.lead("lanes", 2).over(by_row).alias("following"))
    return told.where("variant = 0 AND last = 0").select(
        "doc_id",
        "n_chars",
        F.col("sha1").alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("print1").alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("lanes1")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("following")).alias("near_next"),
    )

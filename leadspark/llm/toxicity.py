"""Toxicity scores from a learned lexicon, misspellings included, and the context of each hit.

The lexicon is learned from training labels: word beginnings and whole words that toxic documents
hold far more often than others, and more often than chance lets them; beginnings that clean documents hold now and then are weak and
tell by their number. A Levenshtein automaton walks its trie over every word of every
whole text, so whole words of five letters or more and beginnings of six or more with one letter changed, added or left out are caught too. A window of tokens around a hit
tells quotation (quotation marks or words of reporting nearby) from abuse. A logistic regression on
counts of the kinds of hit gives the document's score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadspark.llm.labels import apply_logistic, fit_logistic, fold, training_sample
from leadspark.llm.lexicon import EXACT, FIRST, FUZZY_STEM, WEAK, LevenshteinAutomaton, LexiconTrie, WordMatcher

#: Stems, whole terms, weak stems.
Lexicon = tuple[list[str], list[str], list[str]]
FOLDS, HELD_OUT = 3, 1
#: Labelled rows that the lexicon and the weights are fitted on, at most.
FIT_ROWS = 8_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: A term's place in toxic documents is by chance with at most this probability, ten times the share of toxic documents as much if over a tenth hold it.
MOST_CHANCE, LEAST_RATIO = 1e-3, 30.0
#: The same of weak beginnings, which are many more to choose from.
WEAK_CHANCE, WEAK_RATIO = 1e-6, 5.0
#: A beginning whose documents nearly all hold one longer marked term gives way to that.
TAKEN_OVER = 0.9
WINDOW = 6
QUOTES = ('"', "“", "”", "„", "«", "»")
REPORTING = {"said", "says", "wrote", "writes", "quoted", "quote", "called", "according", "dijo", "dit", "sagte"}


def one_of_each_copy(sample: DataFrame) -> DataFrame:
    """One row of every set of near copies, found by two minimum hashes over word triples.

    Copies of one toxic document would otherwise make all of its words look toxic.
    """
    words = F.split(F.lower("text"), r"\s+")
    rows = sample.withColumn("_w", words)
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_w") - 2)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, F.lit(3)), " ")))
    rows = rows.withColumn("_t", triples)
    for salt in (1, 2):
        sign = F.array_min(F.transform("_t", lambda h: F.xxhash64(h, F.lit(salt))))
        rows = rows.groupBy(sign.alias("_s")).agg(F.min_by(F.struct("doc_id", "text", "label", "_t"), "doc_id").alias("r")).select("r.*")
    return rows.drop("_t")


def chance(n: int, hits: int, bad: int, good: int) -> float:
    """Probability that ``n`` documents drawn from ``bad`` + ``good`` hold ``hits`` bad ones or more."""
    log = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    return sum(math.exp(log(bad, k) + log(good, n - k) - log(bad + good, n)) for k in range(max(hits, n - good), min(n, bad) + 1))


def marks(bad_hits: int, good_hits: int, bad: int, good: int) -> bool:
    """Whether a term of so many toxic and clean documents is there by more than chance; one document never tells."""
    return bad_hits > 1 and chance(bad_hits + good_hits, bad_hits, bad, good) <= MOST_CHANCE * max(1, 10 * bad_hits / bad)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Word beginnings that mark toxic documents of the sample, whole words that do, and weak beginnings."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{3,}"), F.lit(0)))
    beginnings = F.transform(words, lambda w: F.array_compact(F.array(F.concat(w, F.lit("$")), *[F.when(F.char_length(w) >= n, F.substring(w, 1, n)) for n in STEM_LENGTHS])))
    sample = one_of_each_copy(sample).cache()
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = total.get(1, 0), total.get(0, 0)
    if not bad or not good:
        return [], [], []
    counts = sample.select("label", F.explode(F.array_distinct(F.flatten(beginnings))).alias("stem"))
    counts = counts.groupBy("stem").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    # Fewer bad documents than these are likely by chance even without a good one; the exact test follows.
    least = next((k for k in range(1, bad + 1) if marks(k, 0, bad, good)), bad + 1)
    ratio = (F.col("bad") / bad) / ((F.col("good") + 0.5) / good)
    rows = counts.where((F.col("bad") >= least) & ((F.col("good") == 0) | (ratio >= WEAK_RATIO))).collect()
    sample.unpersist()
    strong = {r["stem"]: r["bad"] for r in rows if (r["good"] == 0 or r["bad"] / bad >= LEAST_RATIO * (r["good"] + 0.5) / good) and marks(r["bad"], r["good"], bad, good)}
    weak = {r["stem"]: r["bad"] for r in rows if r["stem"] not in strong and r["stem"][-1] != "$" and chance(r["bad"] + r["good"], r["bad"], bad, good) <= WEAK_CHANCE}

    def shortest(found: dict[str, int], known: list[str]) -> list[str]:
        out: list[str] = []
        for stem in sorted((m for m in found if m[-1] != "$"), key=lambda x: (len(x), x)):
            taken_over = any(t.startswith(stem) and t != stem and n >= TAKEN_OVER * found[stem] for t, n in {**strong, **found}.items())
            if not taken_over and not any(stem.startswith(k) for k in [*known, *out]):
                out.append(stem)
        return out

    stems = shortest(strong, [])
    return stems, sorted(m[:-1] for m in strong if m[-1] == "$"), shortest(weak, stems)


def hit_counts(text: str, matcher: WordMatcher) -> tuple[int, int, int, int, int]:
    """Tokens, then exact and misspelled hits meant as abuse, then those in quotation."""
    return all_counts(text, matcher)[:5]


def all_counts(text: str, matcher: WordMatcher) -> tuple[int, ...]:
    """As ``hit_counts``, then how many of the misspelled hits differ in the first letter: abuse, quotation; then weak and misspelled stems."""
    tokens = text.lower().split()
    kinds = [matcher[t] for t in tokens]
    counts = [0] * 8
    if any(kinds):
        for i, kind in enumerate(kinds):
            if kind in (WEAK, FUZZY_STEM):
                counts[6 + (kind == FUZZY_STEM)] += 1
            elif kind:
                near = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                marks = sum(t[:1] in QUOTES for t in near[: WINDOW + 1]) and sum(t.rstrip(".,;:!?")[-1:] in QUOTES for t in near[min(i, WINDOW) :])
                quoted = bool(marks) or any(t.strip(".,;:") in REPORTING for t in near)
                counts[2 * quoted + (kind != EXACT)] += 1
                counts[4 + quoted] += kind == FIRST
    return len(tokens), *counts


def features(counts: np.ndarray) -> np.ndarray:
    """Bounded functions of the hit counts, so that length alone never makes a text toxic.

    First-letter hits count as misspelled; what their own columns add is a correction that
    stays at zero where the training rows have none.
    """
    n, hits, first, stems = (counts[:, a:b].astype(float) for a, b in ((0, 1), (1, 5), (5, 7), (7, 9)))
    density = hits[:, :2].sum(axis=1, keepdims=True) * 100 / np.maximum(n, 20)
    return np.hstack([np.log1p(hits), np.minimum(hits, 1), np.minimum(density, 5), np.log1p(first), np.minimum(first, 1), np.log1p(stems), np.minimum(stems, 1), np.clip(stems - 1, 0, 1), np.minimum(stems * 100 / np.maximum(n, 20), 5)])


def _count_batches(lexicon: Lexicon, weights: np.ndarray | None):
    def run(batches):
        matcher = WordMatcher(LevenshteinAutomaton(LexiconTrie(*lexicon)))
        for batch in batches:
            counts = np.array([all_counts(t.as_py() or "", matcher) for t in batch.column(1)], np.int64).reshape(-1, 9)
            if weights is None:
                columns, names = [pa.array(counts[:, i]) for i in range(9)], COUNT_NAMES
            else:
                columns, names = [pa.array(apply_logistic(features(counts), weights))], ["score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names])

    return run


Model = tuple[Lexicon, np.ndarray]
COUNT_NAMES = ["tokens", "abuse", "abuse_misspelled", "quoted", "quoted_misspelled", "abuse_first", "quoted_first", "weak", "stem_misspelled"]
COUNT_SCHEMA = ", ".join(f"{name} long" for name in ["doc_id", *COUNT_NAMES])


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """(lexicon, weights) from at most ``rows`` labelled training documents; score 0.5 without any."""
    sample = training_sample(docs, labels, "toxic", FOLDS, HELD_OUT, rows).cache()
    lexicon = learn_lexicon(sample)
    counted = sample.select("doc_id", "text").mapInArrow(_count_batches(lexicon, None), COUNT_SCHEMA).join(sample.select("doc_id", "label").distinct(), "doc_id").toPandas()
    sample.unpersist()
    x = features(counted[COUNT_NAMES].to_numpy())
    return lexicon, fit_logistic(x, counted["label"].to_numpy(float))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is empty, a row without doc_id is not held out. Repeated rows get equal scores, a score at the threshold counts as
    toxic, other columns are ignored, an empty table gives an empty one. A text is scored whole, as one block if it is over a megabyte.
    """
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count_batches(*model), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.7) -> DataFrame:
    """Rows of ``docs`` whose text scores below ``limit``, columns unchanged; null and empty texts, repeated rows and rows without a doc_id are judged by their text alone."""
    lexicon, weights = model
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        matcher = WordMatcher(LevenshteinAutomaton(LexiconTrie(*lexicon)))
        for batch in batches:
            counts = np.array([all_counts(t.as_py() or "", matcher) for t in batch.column(at)], np.int64).reshape(-1, 9)
            yield batch.filter(pa.array(apply_logistic(features(counts), weights) < limit))

    return docs.mapInArrow(run, schema)

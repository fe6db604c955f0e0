import math
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadspark.llm.lexicon import EXACT, FIRST, FUZZY, FUZZY_STEM, NO_MATCH, WEAK, LevenshteinAutomaton, LexiconTrie, WordMatcher
from leadspark.llm.labels import apply_logistic
from leadspark.llm.quality import Chains, fit_quality, line_features, score_quality
from leadspark.llm.toxicity import LEAST_RATIO, MOST_CHANCE, TAKEN_OVER, all_counts, features, fit_toxicity, hit_counts, keep_clean, learn_lexicon, score_toxicity
from tests.llm.fixtures import awkward_docs, empty_docs

DIR = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abc", min_size=5, max_size=7), min_size=1, max_size=4), st.lists(st.text("abc", min_size=4, max_size=5), max_size=2))
def test_automaton_equals_edit_distance(word, terms, stems):
    got = LevenshteinAutomaton(LexiconTrie(stems, terms)).match(word)
    exact = any(word.startswith(s) for s in stems) or word in terms
    # Edits leave the first letter of a term alone; stems of under six letters get none.
    near = any(distance(word[1:], t[1:]) <= 1 for t in terms if t[0] == word[0])
    assert got == (EXACT if exact else FUZZY if near else NO_MATCH)


def test_quotation_is_told_from_abuse():
    matcher = WordMatcher(LevenshteinAutomaton(LexiconTrie([], ["idiot", "moron"])))
    assert hit_counts("you idiot, you m0ron!", matcher) == (4, 1, 1, 0, 0)
    assert hit_counts('the report said "idiot" twice', matcher)[3] == 1
    assert hit_counts("", matcher) == (0, 0, 0, 0, 0)


@pytest.mark.parametrize(("label", "fit", "score", "folds", "held"), [("quality", fit_quality, score_quality, 4, 2), ("toxic", fit_toxicity, score_toxicity, 3, 1)])
def test_held_out_accuracy(spark, label, fit, score, folds, held):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    got = score(docs, fit(docs, labels)).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % folds == held)).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    known = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (known.predicted == known[label]).mean() > 0.9


def test_awkward_rows_and_no_labels(spark):
    docs, labels = awkward_docs(spark), spark.read.parquet(f"{DIR}/labels.parquet").limit(0)
    for fit, score in ((fit_quality, score_quality), (fit_toxicity, score_toxicity)):
        model = fit(docs, labels)
        assert {r["score"] for r in score(docs, model).collect()} == {0.5}
        assert score(docs, model).count() == docs.count()
        assert score(empty_docs(spark), model).collect() == []
    assert keep_clean(docs, fit_toxicity(docs, labels)).columns == docs.columns


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    docs = np.repeat([0, 1, 3], [4, 1, 3])
    emit, move = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    p, pairs, log_z = Chains(docs, 4).marginals(emit, move)
    want, want_pairs, total = np.zeros((8, 2)), np.zeros((2, 2)), 0.0
    for d in (0, 1, 3):
        rows = np.flatnonzero(docs == d)
        weight = {}
        for code in range(2 ** len(rows)):
            y = [(code >> i) & 1 for i in range(len(rows))]
            weight[tuple(y)] = np.exp(sum(emit[r, k] for r, k in zip(rows, y, strict=True)) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        z = sum(weight.values())
        total += np.log(z)
        for y, w in weight.items():
            for r, k in zip(rows, y, strict=True):
                want[r, k] += w / z
            for a, b in zip(y, y[1:], strict=False):
                want_pairs[a, b] += w / z
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, total)


def test_line_features_cover_every_document():
    texts = ["", "one\n\nthree", "\n", "", "x"]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t) for t in texts)])
    x, weight, docs = line_features(np.frombuffer(raw, np.uint8), offsets)
    assert np.bincount(docs).tolist() == [1, 3, 1, 1, 1] and len(x) == len(weight)


@pytest.mark.parametrize(("toxic", "clean", "marked"), [(6, 45, 4), (33, 250, 5)])
def test_few_toxic_rows_teach_terms_and_stage_one_drops_them(spark, tmp_path, toxic, clean, marked):
    rnd = random.Random(toxic)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    common = [word() for _ in range(400)]
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows, labels = [], []
    for k, i in enumerate(train[: toxic + clean]):
        text = [rnd.choice(common) for _ in range(30)]
        if k < toxic:
            # Every marker is in few of the toxic documents.
            text += ["vermin"] * (k < marked) + ["wretch"] * (k >= toxic - marked) + ["numskull"] * (marked <= k or k < 2)
        rows.append((i, " ".join(text)))
        labels.append((i, int(k < toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    sample = docs.join(known.withColumnRenamed("toxic", "label"), "doc_id")
    label, counts = dict(labels), {}
    for i, text in rows:
        words = set(re.findall(r"[^\W\d_]{3,}", text))
        for term in {f"{w}$" for w in words} | {w[:n] for w in words for n in range(4, 9) if len(w) >= n}:
            counts.setdefault(term, [0, 0])[label[i]] += 1
    want = set()
    for term, (g, b) in counts.items():
        n = g + b
        p = sum(math.comb(toxic, k) * math.comb(clean, n - k) for k in range(b, min(n, toxic) + 1)) / math.comb(toxic + clean, n)
        if b > 1 and p <= MOST_CHANCE * max(1, 10 * b / toxic) and (g == 0 or (b / toxic) / ((g + 0.5) / clean) >= LEAST_RATIO):
            want.add(term)
    stems, terms, _ = learn_lexicon(sample)
    assert {"vermin", "wretch", "numskull"} <= set(terms) == {t[:-1] for t in want if t[-1] == "$"}
    free = {t for t in want if t[-1] != "$" and not any(u != t and u.startswith(t) and counts[u][1] >= TAKEN_OVER * counts[t][1] for u in want)}
    assert set(stems) == {t for t in free if not any(u != t and t.startswith(u) for u in free)}
    known.write.parquet(f"{tmp_path}/labels.parquet")
    extra = [(5000, rows[-1][1] + " vermin numskull"), (5001, rows[-1][1] + " plain words")]
    table = docs.union(spark.createDataFrame(extra, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, table, str(tmp_path)).collect()}
    bad = {i for i, text in [*rows, *extra] if re.search("vermin|wretch|numskull", text)}
    assert kept == {i for i, _ in [*rows, *extra]} - bad


def kind_of(word, stems, terms, weak=()):
    """The kind of a match by edit distances alone."""
    if any(word.startswith(s) for s in stems) or word in terms:
        return EXACT
    near = [t for t in terms if len(t) >= 5 and distance(word, t) <= 1]
    if any(t[0] == word[:1] and distance(word[1:], t[1:]) <= 1 for t in near):
        return FUZZY
    if any(word.startswith(s) for s in weak):
        return WEAK
    beginnings = [word[:n] for n in range(1, len(word) + 1)]
    if any(len(s) >= 6 and b[0] == s[0] and distance(b[1:], s[1:]) <= 1 for s in stems for b in beginnings):
        return FUZZY_STEM
    return FIRST if near else NO_MATCH


@settings(max_examples=400, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=4), st.lists(st.text("abc", min_size=4, max_size=7), max_size=2), st.lists(st.text("abc", min_size=4, max_size=5), max_size=2))
def test_every_kind_of_match_equals_edit_distance(word, terms, stems, weak):
    assert WordMatcher(LevenshteinAutomaton(LexiconTrie(stems, terms, weak)))[word] == kind_of(word, stems, terms, weak)


def test_scores_equal_plain_python(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    (stems, terms, weak), weights = model = fit_toxicity(docs, labels)
    edges = re.compile(r"^[\W_]+|[\W_]+$")

    class Plain(dict):
        def __missing__(self, token):
            self[token] = kind_of(edges.sub("", token), stems, terms, weak)
            return self[token]

    rows = [r for r in docs.collect() if r["n_chars"] < 2500][:150] + [r for r in docs.join(labels, "doc_id").where("toxic = 1").collect() if r["n_chars"] < 2500]
    plain = Plain()
    want = apply_logistic(features(np.array([all_counts(r["text"] or "", plain) for r in rows])), weights)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert [got[r["doc_id"]] for r in rows] == pytest.approx(list(want))


def test_quality_scores_equal_plain_python(spark):
    """Marginals by summing over all labellings of a short document, then the length-weighted mean and the curve."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = [(i, t) for i, t in enumerate(["", None, "one line", "A good line, I think.\nBUY NOW!!! $$$\n\nanother line here", "x | y | z\n1 2 3\n1 2 3"])]
    got = {r["doc_id"]: r["score"] for r in score_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for i, text in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        x, weight, _ = line_features(raw, np.array([0, len(raw)]))
        good = [float(sum(w * (v - m) / s for w, v, m, s in zip(model["emit"], row, model["mean"], model["spread"], strict=True))) for row in x]
        total, ones = 0.0, [0.0] * len(good)
        for code in range(2 ** len(good)):
            label = [code >> k & 1 for k in range(len(good))]
            mass = math.exp(sum(g for g, y in zip(good, label, strict=True) if y) + sum(model["move"][a, b] for a, b in zip(label, label[1:], strict=False)))
            total += mass
            ones = [o + mass * y for o, y in zip(ones, label, strict=True)]
        share = sum(w * o / total for w, o in zip(weight, ones, strict=True)) / sum(weight)
        lean = sum(w * min(8, max(-8, g)) for w, g in zip(weight, good, strict=True)) / sum(weight)
        want = model["curve"] @ np.array([share, math.log((share + 0.01) / (1.01 - share)), lean, 1])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-want)), rel=1e-6)


def test_abuse_misspelt_in_the_first_letter_is_toxic(spark):
    rnd = random.Random(3)
    train = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1][:200]
    prose = lambda: " ".join("".join(rnd.choice("efghjk") for _ in range(7)) for _ in range(30))
    rows = [(i, prose() + (" " + rnd.choice(["you idiot", "an id1ot", "idiots all"]) if k % 4 == 0 else "")) for k, i in enumerate(train)]
    model = fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(k % 4 == 0)) for k, i in enumerate(train)], "doc_id long, toxic int"))
    assert "idiot" in model[0][1]
    words = ["1diot", "diot", "xidiot", "diary"]
    docs = spark.createDataFrame([(k, f"{prose()} {w}") for k, w in enumerate(words)], "doc_id long, text string")
    assert {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, model).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}

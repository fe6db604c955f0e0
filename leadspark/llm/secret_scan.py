"""Secret spans: three fixed patterns and a randomness battery over token-like runs.

The battery looks at every run of 20 or more token characters that no base span touches. It infers the encoding (the
smallest alphabet that holds the run) and computes, on that alphabet, the chi-squared statistic of the
symbol counts, the number of runs on either side of the alphabet's main split, and the lag-1 serial
correlation. A run whose three statistics are ordinary for random strings is a candidate.

What has to be ruled out is that a candidate is written text. The word model counts neighbouring symbols in all shorter words
of the corpus; under it each of the three tests has a p-value: as few repeated symbols (normal tail), as many runs (Chernoff
bound), as unlikely neighbours (serial test, normal tail). The three are combined by e times their geometric mean, which is a
valid p-value however they depend on each other. Within each band of lengths the Benjamini-Hochberg step-up rule
picks a threshold that keeps the expected share of word-like runs among those reported at ``rate``.

Everything is built-in functions over whole texts; one row a pair of symbols and one threshold a band reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.store import Workspace, text_or_empty

#: Fixed patterns of the contract; the counts in {} only name the shortest match that is kept.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
WORD = r"[A-Za-z0-9+/_=-]{2,}"
KINDS = ("assign", "access", "hex", "random")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = UPPER + LOWER + DIGITS + "+/_=-"
#: (pattern of the whole run, its alphabet, symbols before its main split), smallest alphabet first.
ENCODINGS = [
    ("^[0-9]+$", DIGITS, 5),
    ("^[0-9a-f]+$", DIGITS + "abcdef", 10),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF", 10),
    ("^[a-z]+$", LOWER, 13),
    ("^[A-Z]+$", UPPER, 13),
    ("^[A-Z2-7]+$", UPPER + "234567", 26),
    ("^[0-9a-z]+$", DIGITS + LOWER, 10),
    ("^[0-9A-Z]+$", DIGITS + UPPER, 10),
    ("^[A-Za-z]+$", UPPER + LOWER, 26),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS, 26),
    ("", SYMBOLS, 26),
]
#: Written names and paths change sides at least this often a pair, whatever the corpus' words do.
LEAST_TURNS = 0.1
#: Share of words that stand in capitals too, and the pairs that count as seen of every alphabet.
CAPITALS, PRIOR = 0.05, 10.0
#: Largest deviation, in standard deviations, of the three statistics for a random string.
ORDINARY = 3.5
BANDS, STEP, LOWEST = 14, 0.05, -60.0
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hit:string>>"
#: Matches that one step of a text's scan handles; the steps' ends are added up apart.
BLOCK = 256


class WordModel:
    """Neighbouring symbols of the corpus' words, and what the battery needs of them for every encoding."""

    def __init__(self, pairs: dict[str, int]) -> None:
        size = len(SYMBOLS)
        count = np.zeros((size, size))
        for pair, n in pairs.items():
            count[SYMBOLS.index(pair[0]), SYMBOLS.index(pair[1])] += n
        upper, lower = ([SYMBOLS.index(c) for c in letters] for letters in (UPPER, LOWER))
        count[np.ix_(upper, upper)] += CAPITALS * count[np.ix_(lower, lower)]
        symbol = (count.sum(axis=0) + 1) / (count.sum() + size)
        self.log = np.log((count + 20 * symbol) / (count.sum(axis=1, keepdims=True) + 20))
        weight = count + 1e-6
        common = float((weight * self.log).sum() / weight.sum())
        # Marks join names and paths, so a mark beside a symbol tells nothing.
        marks = [SYMBOLS.index(c) for c in "+/_=-"]
        self.log[marks, :] = self.log[:, marks] = common
        wide = float((weight * (self.log - common) ** 2).sum() / weight.sum())
        rows = []
        for _, alphabet, split in ENCODINGS:
            at = [SYMBOLS.index(c) for c in alphabet]
            inside, log, side = count[np.ix_(at, at)], self.log[np.ix_(at, at)], np.arange(len(at)) < split
            # Alphabets that words hardly use take the whole corpus' values and the least turns.
            total = inside.sum() + PRIOR
            own = symbol[at] / symbol[at].sum()
            turn = (inside[side[:, None] != side].sum() + PRIOR * LEAST_TURNS) / total
            mean = float(((inside * log).sum() + PRIOR * common) / total)
            spread = float(((inside * (log - mean) ** 2).sum() + PRIOR * wide) / total)
            rows.append((len(at), split, float((own**2).sum()), max(LEAST_TURNS, float(turn)), mean, math.sqrt(spread) + 0.1))
        self.size, self.split, self.repeat, self.turn, self.mean, self.spread = map(list, zip(*rows, strict=True))


def word_model(docs: DataFrame) -> WordModel:
    """Counts over the words of 2 to 19 token characters of every whole text."""
    words = docs.select(F.explode(F.regexp_extract_all(text_or_empty(), F.lit(WORD), F.lit(0))).alias("w")).where(F.char_length("w") < 20)
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") - 1), lambda i: F.substr("w", i, F.lit(2)))).alias("p"))
    return WordModel({r["p"]: r["n"] for r in pairs.groupBy("p").agg(F.sum("n").alias("n")).collect()})


def _constants(values) -> Column:
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def _spans(text: Column, pattern: str, order: int, keep=None) -> Column:
    """Spans of the matches in code points: array of (start, kind order, end, match)."""
    empty = F.array().cast(SPAN)
    steps = [F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    if keep:
        steps.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
    parts = F.arrays_zip(*steps)
    width = lambda x: (F.char_length(x["before"]) + F.coalesce(F.char_length(x["hit"]), F.lit(0))).cast("long")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["before"])
        end = acc["at"] + width(x)
        good = x["hit"].isNotNull() & (keep(x["value"]) if keep else F.lit(True))
        one = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["spans"], F.array(one).cast(SPAN))).otherwise(acc["spans"]).alias("spans"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda j: F.slice(parts, j * BLOCK + 1, F.lit(BLOCK)))
    ends = lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(b, F.lit(0).cast("long"), lambda n, x: n + width(x)))
    starts = F.aggregate(blocks, F.array(F.lit(0).cast("long")), ends)
    each = F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(starts) - 1), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"]))
    return F.when(text.rlike(pattern), F.flatten(each)).otherwise(empty)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def _lower_tail(z: Column) -> Column:
    """Logarithm of a bound of the normal distribution's lower tail."""
    return F.when(z < 0, -z * z / 2 - math.log(2)).otherwise(F.lit(0.0))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _battery(token: Column, model: WordModel) -> Column:
    """(band, logarithm of the combined p-value, ordinary) of one run of token characters."""
    # The last entry takes every run that no smaller alphabet holds.
    encoding = F.lit(len(ENCODINGS))
    for k in range(len(ENCODINGS) - 2, -1, -1):
        encoding = F.when(token.rlike(ENCODINGS[k][0]), F.lit(k + 1)).otherwise(encoding)
    symbols = F.split(token, "")

    def coded(encoding: Column) -> Column:
        alphabet = F.element_at(F.array(*[F.lit(a) for _, a, _ in ENCODINGS]), encoding)
        codes = F.transform(symbols, lambda c: F.instr(alphabet, c).cast("double"))
        squares = F.transform(F.split(alphabet, ""), lambda s: F.pow(F.char_length(token) - F.char_length(F.replace(token, s, F.lit(""))), F.lit(2.0)))
        places = F.transform(symbols, lambda c: F.instr(F.lit(SYMBOLS), c))
        return _let(F.struct(encoding.alias("encoding"), codes.alias("codes"), places.alias("places"), _total(squares).alias("squares")), lambda v: _tests(v, model))

    return _let(encoding, coded)


def _tests(v: Column, model: WordModel) -> Column:
    codes, n = v["codes"], F.size(v["codes"]).cast("double")
    of = lambda values: F.element_at(_constants(values), v["encoding"])
    size, split, repeat, rate = of(model.size), of(model.split), of(model.repeat), of(model.turn)
    earlier, later = (lambda a: F.slice(a, F.lit(1), (n - 1).cast("int"))), (lambda a: F.slice(a, F.lit(2), (n - 1).cast("int")))
    pairs = n * (n - 1) / 2

    # Chi-squared: as the number of equal pairs of symbols that it stands for.
    chi2 = size / n * v["squares"] - n
    equal = ((chi2 + n) * n / size - n) / 2
    few_repeats = _lower_tail((equal - pairs * repeat) / F.sqrt(pairs * repeat * (1 - repeat) * (1 + 2 * repeat * n / 10)))
    plain = equal <= pairs / size + ORDINARY * F.sqrt(pairs / size) + 1

    # Runs on the two sides of the split.
    ones = _total(F.transform(codes, lambda c: (c <= split).cast("double")))
    turns = _total(F.zip_with(earlier(codes), later(codes), lambda a, b: ((a <= split) != (b <= split)).cast("double")))

    def runs(t: Column) -> Column:
        mean = 2 * t["ones"] * (n - t["ones"]) / n
        z = (t["turns"] - mean) / F.sqrt(F.greatest(F.lit(0.25), mean * (mean - 1) / (n - 1)))
        seen = t["turns"] / (n - 1)
        gain = F.when(seen > 0, seen * F.ln(seen / rate)).otherwise(F.lit(0.0)) + F.when(seen < 1, (1 - seen) * F.ln((1 - seen) / (1 - rate))).otherwise(F.lit(0.0))
        return F.struct(F.when(seen > rate, -(n - 1) * gain).otherwise(F.lit(0.0)).alias("p"), z.alias("z"))

    # Serial correlation of the codes, and the likelihood of neighbours in words.
    middle = F.transform(codes, lambda c: c - (size + 1) / 2)

    def serial(m: Column) -> Column:
        drift = F.pow(_total(m), F.lit(2.0)) / n
        power = _total(F.transform(m, lambda x: x * x)) - drift
        lagged = _total(F.zip_with(earlier(m), later(m), lambda a, b: a * b)) - drift
        return F.when(power > 0, lagged / power).otherwise(F.lit(1.0)) * F.sqrt(n)

    likely = _total(F.zip_with(earlier(v["places"]), later(v["places"]), lambda a, b: F.element_at(_constants(model.log.ravel()), (a - 1) * len(SYMBOLS) + b)))
    odd_neighbours = _lower_tail((likely - (n - 1) * of(model.mean)) / (of(model.spread) * F.sqrt(2 * (n - 1))))

    def combined(r: Column) -> Column:
        p = F.greatest(F.lit(LOWEST), F.least(F.lit(0.0), 1 + (few_repeats + r["p"] + odd_neighbours) / 3))
        ordinary = plain & (F.abs(r["z"]) <= ORDINARY) & (F.abs(_let(middle, serial)) <= ORDINARY)
        band = F.least(F.lit(BANDS - 1), F.floor(2 * F.log2(n / 20))).cast("int")
        return F.struct(band.alias("band"), F.round(p, 6).alias("p"), ordinary.alias("ordinary"))

    return _let(_let(F.struct(ones.alias("ones"), turns.alias("turns")), runs), combined)


def _touches(token: Column, spans: Column) -> Column:
    """Whether a span of one kind, sorted and apart from each other, overlaps the token; by binary search."""
    powers = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    further = lambda lo, p: F.when((lo + p <= F.size(spans)) & (F.get(spans, lo + p - 1)["start"] < token["end"]), lo + p).otherwise(lo)
    before = F.aggregate(powers, F.lit(0), further)
    return (before > 0) & (F.get(spans, before - 1)["end"] > token["start"])


def _found(texts: DataFrame, carried: list[str], model: WordModel) -> DataFrame:
    """``carried`` columns, base spans and tested tokens of the texts in column _t."""
    kinds = [_spans(F.col("_t"), ASSIGN, 0, lambda v: F.char_length(v) >= 8), _spans(F.col("_t"), ACCESS, 1), _spans(F.col("_t"), HEX, 2), _spans(F.col("_t"), TOKEN, 3)]
    spotted = texts.select(*carried, *[k.alias(f"_k{i}") for i, k in enumerate(kinds)])
    free = F.filter("_k3", lambda t: ~(_touches(t, F.col("_k0")) | _touches(t, F.col("_k1")) | _touches(t, F.col("_k2"))))
    tested = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _battery(s["hit"], model).alias("test")))
    bare = F.array_sort(F.transform(F.concat("_k0", "_k1", "_k2"), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return spotted.select(*carried, bare.alias("base"), tested.alias("tested"))


def _step(p: Column) -> Column:
    return F.ceil(p / STEP) * STEP


def thresholds(found: DataFrame, rate: float) -> dict[int, float]:
    """Per length band the largest logarithm of a p-value that the step-up rule accepts, from all tokens of the corpus.

    Tokens count in steps, so the table that is ordered has at most bands times steps rows.
    """
    bins = found.select(F.explode("tested.test").alias("t")).select("t.band", F.when(F.col("t.ordinary"), _step(F.col("t.p"))).otherwise(F.lit(99.0)).alias("p"))
    bins = bins.groupBy("band", "p").agg(F.count(F.lit(1)).alias("n"))
    band = Window.partitionBy("band")
    upto = bins.withColumn("below", F.sum("n").over(band.orderBy("p"))).withColumn("all", F.sum("n").over(band))
    passed = upto.where((F.col("p") < 90) & (F.exp("p") * F.col("all") <= rate * F.col("below")))
    return {r["band"]: r["p"] for r in passed.groupBy("band").agg(F.max("p").alias("p")).collect()}


def _accepted(base: Column, tested: Column, limit: dict[int, float]) -> Column:
    """All spans: base ones and accepted tokens."""
    by_band = _constants([limit.get(b, -1e9) + STEP / 2 for b in range(BANDS)])
    good = F.filter(tested, lambda s: s["test"]["ordinary"] & (_step(s["test"]["p"]) <= F.element_at(by_band, s["test"]["band"] + 1)))
    return F.array_sort(F.concat(base, F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scanned(docs: DataFrame, carried: list[Column], work: Workspace, rate: float) -> DataFrame:
    """Written table of the ``carried`` columns with base and all spans of every row's text."""
    found = _found(docs.select(*carried, text_or_empty().alias("_t")), ["row"], word_model(docs))
    found = work.write(found, "found")
    return found.select("row", "base", _accepted(F.col("base"), F.col("tested"), thresholds(found, rate)).alias("spans"))


def scan_secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base spans, their digest, and all spans.

    A null text is empty and has no spans; a null doc_id stays; repeated rows give repeated results; an empty table none.
    """
    found = _scanned(docs, [F.col("doc_id").alias("row")], Workspace(docs.sparkSession, "secrets"), rate)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("row").alias("doc_id"),
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, rate: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark`` and n_chars brought up to date.

    The texts are scanned once and written with their spans; other columns stay, whatever their names. A null text stays null.
    """
    found = _scanned(docs, [F.struct(*docs.columns).alias("row")], Workspace(docs.sparkSession, "secrets"), rate)
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array(F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), (s["start"] - acc["at"]).cast("int"))), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"].cast("int")).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["parts"], fresh)).otherwise(acc["parts"]).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    clean = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, acc["at"] + 1, F.greatest(F.lit(0), F.char_length(text) - acc["at"]))))
    told = {"text": F.when(F.size("spans") > 0, clean).otherwise(text)}
    if "n_chars" in docs.columns:
        told["n_chars"] = F.when(F.size("spans") > 0, F.char_length(clean).cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[told.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])

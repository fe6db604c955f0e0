"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The chain's weights on features of the line and of its two neighbours,
and on the four pairs of adjoining labels, are fitted by gradient ascent of the conditional likelihood on
a bounded sample of labelled documents whose lines all carry the document's label. Forward-backward
marginals, averaged by line length, give the document's share of good text, and a logistic curve
turns it into the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.llm.labels import apply_logistic, fit_logistic, fold, training_sample
from leadspark.llm.textops import RollingHash, blocks, lower_ascii, utf8_parts, words

FOLDS, HELD_OUT = 4, 2
#: Labelled documents and lines of them that the chain is fitted on, at most; documents of over a tenth of the lines are left out of the fit.
FIT_ROWS, FIT_LINES = 4_000, 200_000
STEPS, RATE, RIDGE = 120, 0.08, 1e-3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, byte length and document index of every line of a block; an empty text is one line."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    start = start[start < n] if n else start[:0]
    docs = np.searchsorted(offsets, start, side="right") - 1
    empty = np.setdiff1d(np.arange(len(offsets) - 1), docs)
    end = np.append(start[1:], n)
    length = (end - start).astype(float)

    def share(mask: np.ndarray) -> np.ndarray:
        return (np.add.reduceat(mask.astype(np.int32), start) if len(start) else np.zeros(0)) / np.maximum(length, 1)

    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, wide, blank = (data >= 48) & (data <= 57), data >= 128, (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~(upper | lower | digit | wide | blank)
    plain = symbol & np.isin(data, np.frombuffer(b".,;:'\"-()?!", np.uint8))
    w_start, w_end, _ = words(data, offsets)
    value = RollingHash(lower_ascii(data)).ranges(w_start, w_end)
    line = np.searchsorted(start, w_start, side="right") - 1
    n_words = np.bincount(line, minlength=len(start)).astype(float)
    same = np.zeros(len(value), bool)
    same[1:] = (value[1:] == value[:-1]) & (line[1:] == line[:-1])
    near = same.copy()
    near[2:] |= (value[2:] == value[:-2]) & (line[2:] == line[:-2])
    repeats = np.bincount(line, weights=same, minlength=len(start)) / np.maximum(n_words, 1)
    close = np.bincount(line, weights=near, minlength=len(start)) / np.maximum(n_words, 1)
    whole = RollingHash(data).ranges(start, end) if len(start) else np.zeros(0, np.uint64)
    again = np.zeros(len(start))
    if len(start) > 1:
        again[1:] = (whole[1:] == whole[:-1]) & (docs[1:] == docs[:-1])
    last = data[np.maximum(end - 2, start)] if len(start) else data[:0]
    stop = np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(float)
    own = np.column_stack(
        [
            np.log1p(length), np.log1p(n_words), np.minimum(length / np.maximum(n_words, 1), 40) / 10, share(upper), share(digit), share(wide), share(symbol),
            share(symbol & ~plain), share(data == 124) * 10, share(data == 33) * 10, repeats, close, again, stop, np.minimum(share(symbol & ~plain) * 20, 1), np.minimum(repeats * 4, 1), np.minimum(share(upper) * 4, 1),
        ]
    )
    if len(empty):
        own, length = np.vstack([own, np.zeros((len(empty), own.shape[1]))]), np.append(length, np.zeros(len(empty)))
        docs = np.append(docs, empty)
        order = np.argsort(docs, kind="stable")
        own, length, docs = own[order], length[order], docs[order]
    first = np.ones(len(docs), bool)
    first[1:] = docs[1:] != docs[:-1]
    final = np.append(first[1:], True) if len(docs) else first
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first] = 0
    after[final] = 0
    return np.hstack([own, before, after, np.ones((len(docs), 1))]), length + 1, docs


class Chains:
    """Lines of many documents, laid out so that one numpy step moves every chain by one line."""

    def __init__(self, docs: np.ndarray, n_docs: int) -> None:
        self.count = np.bincount(docs, minlength=n_docs)
        first = np.concatenate(([0], np.cumsum(self.count)[:-1])).astype(np.int64)
        order = np.argsort(-self.count, kind="stable")
        alive = np.searchsorted(-self.count[order], -np.arange(1, self.count.max(initial=0) + 1), side="right")
        self.steps = [first[order[:k]] + t for t, k in enumerate(alive)]

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(label) of every line, the expected label pairs, and the log of the normaliser.

        ``emit`` has a row of two scores a line, ``move`` two times two scores.
        """
        ahead, back = emit.copy(), np.zeros_like(emit)
        for earlier, now in zip(self.steps, self.steps[1:], strict=False):
            s = ahead[earlier[: len(now)]][:, :, None] + move
            top = s.max(axis=1)
            ahead[now] += top + np.log(np.exp(s - top[:, None]).sum(axis=1))
        for now, later in zip(self.steps[-2::-1], self.steps[:0:-1], strict=False):
            s = (back[later] + emit[later])[:, None, :] + move
            top = s.max(axis=2)
            back[now[: len(later)]] = top + np.log(np.exp(s - top[:, :, None]).sum(axis=2))
        both = ahead + back
        top = both.max(axis=1, keepdims=True)
        log_z = (top[:, 0] + np.log(np.exp(both - top).sum(axis=1))) if len(both) else np.zeros(0)
        pairs = np.zeros((2, 2))
        for earlier, now in zip(self.steps, self.steps[1:], strict=False):
            e = earlier[: len(now)]
            pairs += np.exp(ahead[e][:, :, None] + move + (emit[now] + back[now])[:, None, :] - log_z[now][:, None, None]).sum(axis=0)
        total = float(log_z[self.steps[0]].sum()) if self.steps else 0.0
        return np.exp(both - log_z[:, None]), pairs, total


def fit_chain(x: np.ndarray, docs: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the chain by full-batch gradient ascent with adaptive steps."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[-1], spread[-1] = 0, 1
    spread[spread < 1e-6] = 1
    x = (x - mean) / spread
    chains, y, n = Chains(docs, len(label)), label[docs].astype(float), len(x)
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = np.maximum(chains.count[label == k] - 1, 0).sum()
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good = x @ theta[:-4]
        p, pairs, _ = chains.marginals(np.column_stack([np.zeros(n), good]), theta[-4:].reshape(2, 2))
        gradient = np.append(x.T @ (y - p[:, 1]), (seen - pairs).ravel()) / n - RIDGE * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return {"mean": mean, "spread": spread, "emit": theta[:-4], "move": theta[-4:].reshape(2, 2)}


def document_share(x: np.ndarray, weight: np.ndarray, docs: np.ndarray, n_docs: int, model: dict[str, np.ndarray]) -> np.ndarray:
    """Length-weighted mean marginal of the good label, and the same of its log-odds, per document."""
    good = ((x - model["mean"]) / model["spread"]) @ model["emit"]
    p, _, _ = Chains(docs, n_docs).marginals(np.column_stack([np.zeros(len(x)), good]), model["move"])
    total = np.maximum(np.bincount(docs, weights=weight, minlength=n_docs), 1e-9)
    share = np.bincount(docs, weights=weight * p[:, 1], minlength=n_docs) / total
    lean = np.bincount(docs, weights=weight * np.clip(good, -8, 8), minlength=n_docs) / total
    return np.column_stack([share, np.log((share + 0.01) / (1.01 - share)), lean])


def _feature_batches(batches):
    for batch in batches:
        data, offsets = utf8_parts(batch.column(1))
        for lo, hi in blocks(offsets):
            x, weight, docs = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cut = np.flatnonzero(np.diff(docs)) + 1
            parts = zip(np.split(x, cut), np.split(weight, cut), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([np.column_stack([a, b]).astype("<f4").tobytes() for a, b in parts], pa.binary())],
                ["doc_id", "label", "lines"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, lines: int = FIT_LINES) -> dict[str, np.ndarray]:
    """The chain and the final curve from at most ``rows`` labelled training documents and ``lines`` of their lines."""
    sample = training_sample(docs, labels, "quality", FOLDS, HELD_OUT, rows)
    n = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sample = sample.withColumn("_hash", F.xxhash64("text")).withColumn("_n", n).where(F.col("_n") <= lines / 10)
    # Only ids, hashes and line counts are ordered in one task, and two bounds hold them: ``rows`` ids, ``lines`` lines.
    upto = F.sum("_n").over(Window.orderBy(F.xxhash64("doc_id"), "_hash").rowsBetween(Window.unboundedPreceding, 0))
    within = sample.select("doc_id", "_hash", "_n").orderBy(F.xxhash64("doc_id"), "_hash").limit(lines).withColumn("_upto", upto).where(F.col("_upto") <= lines)
    sample = sample.join(F.broadcast(within.select("doc_id", "_hash")), ["doc_id", "_hash"]).select("doc_id", "text", "label")
    got = sample.mapInArrow(_feature_batches, "doc_id long, label int, lines binary").toPandas().sort_values("doc_id")
    width = line_features(np.zeros(0, np.uint8), np.zeros(2, np.int64))[0].shape[1] + 1
    if got.empty or got["label"].nunique() < 2:
        return {"mean": np.zeros(width - 1), "spread": np.ones(width - 1), "emit": np.zeros(width - 1), "move": np.zeros((2, 2)), "curve": np.zeros(4)}
    each = [np.frombuffer(b, "<f4").reshape(-1, width).astype(float) for b in got["lines"]]
    table, at = np.vstack(each), np.repeat(np.arange(len(each)), [len(e) for e in each])
    label = got["label"].to_numpy(int)
    model = fit_chain(table[:, :-1], at, label)
    model["curve"] = fit_logistic(document_share(table[:, :-1], table[:, -1], at, len(each), model), label.astype(float), ridge=0.05)
    return model


def score_quality(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is empty, one blank line; a row without doc_id is not held out. Repeated rows get equal scores, a score at the threshold
    counts as good, other columns are ignored, an empty table gives an empty one. A text is scored whole, as one block if it is over a megabyte.
    """

    def run(batches):
        for batch in batches:
            data, offsets = utf8_parts(batch.column(1))
            for lo, hi in blocks(offsets):
                x, weight, at = line_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                score = apply_logistic(document_share(x, weight, at, hi - lo, model), model["curve"])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(score)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))

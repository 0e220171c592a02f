"""Quality scores from a generalised additive model with pairwise interactions.

Every feature of a text is cut into bins; shallow trees, boosted one feature
at a time in turn, add up to one lookup table per feature and one per chosen
pair. A score is a sum of looked-up values.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fold, whole_text

# Byte classes: white space, line end, lower, upper, digit, sentence marks, other marks, beyond ASCII.
SPACE, LINE, LOWER, UPPER, DIGIT, STOP, MARK, WIDE = range(8)
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[9, 11, 12, 32]] = SPACE
_CLASS[[10, 13]] = LINE
_CLASS[97:123] = LOWER
_CLASS[65:91] = UPPER
_CLASS[48:58] = DIGIT
_CLASS[[ord(c) for c in ".,;:'\"-"]] = STOP
_CLASS[128:] = WIDE
_BLOCK = 1 << 22

FEATURES = (
    "chars", "words", "word_length", "distinct_words", "lines", "line_words", "distinct_lines", "upper", "digits",
    "stops", "marks", "wide", "mark_after_letter", "mark_after_mark", "stop_after_letter", "upper_after_space",
    "upper_after_upper", "mark_after_space", "digit_after_letter", "most_common_word", "stopped_lines",
)


def features(text: str) -> list[float]:
    """Measures of one text, in the order of ``FEATURES``; all of an empty text are zero."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    counts, pairs = np.zeros(8, np.int64), np.zeros(64, np.int64)
    for at in range(0, len(raw), _BLOCK):
        kinds = _CLASS[np.frombuffer(raw[max(0, at - 1) : at + _BLOCK], np.uint8)]
        counts += np.bincount(kinds[at > 0 :], minlength=8)
        pairs += np.bincount(kinds[:-1] * 8 + kinds[1:], minlength=64)
    pairs = pairs.reshape(8, 8)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n = len(raw)
    w, rows = max(1, len(words)), max(1, len(lines))
    often = Counter(words)
    letters = pairs[LOWER] + pairs[UPPER] + pairs[WIDE]
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        (n - counts[SPACE] - counts[LINE]) / w,
        len(often) / w,
        float(np.log1p(len(lines))),
        len(words) / rows,
        len(set(lines)) / rows,
        *(counts[k] / n for k in (UPPER, DIGIT, STOP, MARK, WIDE)),
        letters[MARK] / w,
        pairs[MARK, MARK] / w,
        letters[STOP] / w,
        (pairs[SPACE, UPPER] + pairs[LINE, UPPER]) / w,
        pairs[UPPER, UPPER] / n,
        (pairs[SPACE, MARK] + pairs[LINE, MARK]) / w,
        letters[DIGIT] / w,
        max(often.values(), default=0) / w,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / rows,
    ]


@dataclass
class Model:
    """Cuts and tables of every feature, tables of pairs over coarser cuts."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables)):
            total += values[np.searchsorted(cuts, x[:, j], side="right")]
        for a, b, values in self.pairs:
            i = np.searchsorted(self.pair_cuts[a], x[:, a], side="right")
            total += values[i, np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Cut points between quantiles of the distinct values."""
    levels = np.unique(values)
    if len(levels) < 2:
        return np.empty(0)
    middle = (levels[1:] + levels[:-1]) / 2
    return middle if len(middle) < bins else np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, splits: int = 2) -> np.ndarray:
    """Values per bin of a tree with up to ``splits`` splits, grown best first."""
    leaves, out = [(0, len(g))], np.empty(len(g))
    for _ in range(splits):
        best = (1e-9, None, None)
        for lo, hi in leaves:
            if hi - lo < 2:
                continue
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gt, ht = g[lo:hi].sum(), h[lo:hi].sum()
            gains = _gain(gl, hl, ridge) + _gain(gt - gl, ht - hl, ridge) - _gain(gt, ht, ridge)
            at = int(np.argmax(gains))
            if gains[at] > best[0]:
                best = (gains[at], (lo, hi), lo + at + 1)
        if best[1] is None:
            break
        leaves.remove(best[1])
        leaves += [(best[1][0], best[2]), (best[2], best[1][1])]
    for lo, hi in leaves:
        out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and values of a tree that cuts the first feature, then the second on either side."""
    best, out = -np.inf, np.zeros_like(g)
    if min(g.shape) < 2:
        return 0.0, out
    whole = _gain(g.sum(), h.sum(), ridge)
    for i in range(1, g.shape[0]):
        gain, parts = -whole, []
        for rows in (slice(0, i), slice(i, None)):
            gr, hr = g[rows].sum(axis=0), h[rows].sum(axis=0)
            gl, hl = np.cumsum(gr)[:-1], np.cumsum(hr)[:-1]
            gains = _gain(gl, hl, ridge) + _gain(gr.sum() - gl, hr.sum() - hl, ridge)
            j = int(np.argmax(gains))
            gain += gains[j]
            parts += [(rows, slice(0, j + 1)), (rows, slice(j + 1, None))]
        if gain > best:
            best = gain
            for rows, columns in parts:
                out[rows, columns] = -g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
    return float(best), out


def train(
    x: np.ndarray,
    y: np.ndarray,
    bins: int = 48,
    pair_bins: int = 10,
    pairs: int = 6,
    rounds: int = 120,
    rate: float = 0.15,
    ridge: float = 5.0,
) -> Model:
    """Fit a model to rows of features and 0/1 labels; the prior alone if they hold one class or none."""
    positive = float(y.sum())
    model = Model(base=float(np.log((positive + 1) / (len(y) - positive + 1))))
    if len(y) == 0 or positive in (0.0, float(len(y))):
        return model
    count = x.shape[1]
    model.cuts = [_cuts(x[:, j], bins) for j in range(count)]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(count):
            size = len(model.tables[j])
            if size < 2:
                continue
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[j], g, size), np.bincount(binned[j], h, size), ridge)
            model.tables[j] += step
            total += step[binned[j]]
    model.pair_cuts = [_cuts(x[:, j], pair_bins) for j in range(count)]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.pair_cuts)]

    def histogram(a, b, weights):
        shape = (len(model.pair_cuts[a]) + 1, len(model.pair_cuts[b]) + 1)
        return np.bincount(coarse[a] * shape[1] + coarse[b], weights, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(
        ((_pair_tree(histogram(a, b, g), histogram(a, b, h), ridge)[0], a, b) for a in range(count) for b in range(a)),
        reverse=True,
    )
    model.pairs = [(a, b, np.zeros_like(histogram(a, b, g))) for gain, a, b in ranked[:pairs] if gain > 0]
    for _ in range(rounds // 4):
        for a, b, values in model.pairs:
            g, h = slopes()
            step = rate * _pair_tree(histogram(a, b, g), histogram(a, b, h), ridge)[1]
            values += step
            total += step[coarse[a], coarse[b]]
    return model


def _measures(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def _features_column():
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(_measures(texts)))

    return run


def _score_column(model: Model):
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_measures(texts)) if len(texts) else [], dtype="float64")

    return run


def fit_quality(documents: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = 20_000) -> Model:
    """Learn ``labels.quality`` from about ``max_rows`` labelled documents at most.

    The bound is the sample the driver fits on: of the labels where ``usable``
    (an expression over doc_id) holds, the share, by hash of the id, that makes
    up so many rows; all if there are fewer. Null ids or labels are left out; labels of one id are averaged, of
    texts of one id the one with the least features is taken.
    """
    bound_batches(documents.sparkSession)
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    labelled = rows.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    share = min(1.0, max_rows / max(1, labelled.count()))
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sample = (
        documents.select("doc_id", whole_text().alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "label", _features_column()("text").alias("x"))
        .groupBy("doc_id", "label")
        .agg(F.min("x").alias("x"))
    )
    got = sorted((r.doc_id, r.label, r.x) for r in sample.collect())
    x = np.array([r[2] for r in got]).reshape(len(got), len(FEATURES))
    return train(x, np.array([r[1] for r in got], dtype=float))


def score_quality(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the probability of label 1 in column ``name``, which
    is replaced if there is one. Null and empty texts are scored as empty."""
    bound_batches(documents.sparkSession)
    return documents.withColumn(name, _score_column(model)(whole_text()))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts (score of 0.5 or more), columns unchanged."""
    model = fit_quality(documents, labels, fold(3) != 1)
    accepted = _score_column(model)(whole_text()) >= 0.5
    bound_batches(documents.sparkSession)
    return documents.filter(accepted)

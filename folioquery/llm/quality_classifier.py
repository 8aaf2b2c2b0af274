"""Quality classifier: an additive model of lookup tables with pairwise interactions.

Every feature is cut into quantile bins. Cyclic boosting visits the features in turn;
each visit fits one shallow tree (a few cuts of that feature's bins) to the gradient and
adds its steps to the feature's table. Then the pairs of features whose joint residuals
gain most get a small two-dimensional table, boosted the same way. A score is the
logistic of the intercept plus one table entry per feature and pair: bin lookups and
additions over whole Arrow batches.

Labels are learned only from rows outside the held-out fold; id, language, source and
label are never features. Defined results: a null or empty text has all-zero features and
gets the score of those bins; repeated rows get equal scores; without usable labels of
both kinds every score is 0.5. Of several labels of one id the lower counts, and of several
texts of one labelled id the one with the least hash is learned from. Other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import HashCache, held_out, read, shingle_hashes, slices

#: At most so many labelled rows (the lowest id hashes) are learned from.
TRAIN_ROWS = 20_000
BINS = 32
ROUNDS = 150
PAIR_ROUNDS = 60
MAX_PAIRS = 8
PAIR_BINS = 8
RATE = 0.1
L2 = 2.0

FEATURES = (
    "log_words", "mean_word", "upper", "digits", "symbols", "bars", "bangs", "stops", "commas", "other_punct",
    "lines_per_word", "distinct_words", "one_letter_words", "long_words", "repeat_lines", "repeat_windows",
    "top_word", "capital_words", "non_ascii", "words_with_symbol",
)
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>", "|", "!", ".", ",", "?;:'\"()[]{}-_=+/\\~^@`")
_CLASS_TABLE = np.zeros((256, len(_CLASSES) + 2))
for _i, _chars in enumerate(_CLASSES):
    _CLASS_TABLE[[ord(c) for c in _chars], _i] = 1
_CLASS_TABLE[9:14, -2] = _CLASS_TABLE[32, -2] = 1
_CLASS_TABLE[128:, -1] = 1


def features(text: str | None, cache: HashCache) -> list[float]:
    """FEATURES of a whole text; all zero without words."""
    raw = (text or "").encode("utf-8", "replace")
    w = raw.split()
    if not w:
        return [0.0] * len(FEATURES)
    n = len(w)
    upper, digit, symbol, bar, bang, stop, comma, punct, blank, high = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_TABLE
    )
    ink = max(1.0, len(raw) - blank)
    lengths = np.fromiter(map(len, w), np.int64, n)
    h = cache.of(w)
    _, times = np.unique(h, return_counts=True)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = shingle_hashes(h, 5)
    return [
        float(np.log1p(n)), ink / n, upper / ink, digit / ink, symbol / ink, bar / n, bang / n, stop / n, comma / n,
        punct / ink, len(lines) / n, len(times) / n, float((lengths == 1).mean()), float((lengths > 14).mean()),
        1 - len(set(lines)) / len(lines), 1 - len(np.unique(windows)) / len(windows), float(times.max()) / n,
        sum(map(bytes.isupper, w)) / n, high / ink, min(1.0, symbol / n / 2),
    ]


@dataclass
class AdditiveModel:
    """Lookup tables over bins: one per feature and one per chosen pair."""

    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 per row."""
        z = np.full(len(x), self.intercept)
        if self.cuts and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                z += t[b[:, j]]
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[coarse(b[:, i]), coarse(b[:, j])]
        return 1 / (1 + np.exp(-z))


def coarse(b: np.ndarray) -> np.ndarray:
    return b * PAIR_BINS // BINS


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins, one value per bin."""
    value = np.full(len(grad), grad.sum() / (hess.sum() + L2))
    if depth and len(grad) > 1:
        g, h = np.cumsum(grad)[:-1], np.cumsum(hess)[:-1]
        gain = g**2 / (h + L2) + (grad.sum() - g) ** 2 / (hess.sum() - h + L2)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > grad.sum() ** 2 / (hess.sum() + L2) + 1e-9:
            value[:cut] = _tree(grad[:cut], hess[:cut], depth - 1)
            value[cut:] = _tree(grad[cut:], hess[cut:], depth - 1)
    return value


def train(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Fit on a bounded sample; constant 0.5 unless both labels occur."""
    model = AdditiveModel()
    if len(y) == 0 or y.min() == y.max():
        return model
    model.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.cuts]
    model.intercept = float(np.log(y.mean() / (1 - y.mean())))
    z = np.full(len(y), model.intercept)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(
                np.bincount(b[:, j], y - p, BINS), np.bincount(b[:, j], p * (1 - p), BINS)
            )
            table += step
            z += step[b[:, j]]

    p = 1 / (1 + np.exp(-z))
    cells = PAIR_BINS * PAIR_BINS
    c = coarse(b)
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            at = c[:, i] * PAIR_BINS + c[:, j]
            g, h = np.bincount(at, y - p, cells), np.bincount(at, p * (1 - p), cells)
            gains.append(((g**2 / (h + L2)).sum(), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:MAX_PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            at = c[:, i] * PAIR_BINS + c[:, j]
            g, h = np.bincount(at, y - p, cells), np.bincount(at, p * (1 - p), cells)
            step = RATE * g / (h + L2)
            table += step.reshape(PAIR_BINS, PAIR_BINS)
            z += step[at]
    return model


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def extract(array: pa.Array) -> pa.Array:
        cache = HashCache()
        return pa.array([features(t, cache) for part in slices(array) for t in part], pa.list_(pa.float64()))

    return extract(text)


def labelled_sample(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, quality of at most TRAIN_ROWS labelled rows outside the held-out fold."""
    return (
        read(spark, folder, "labels").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    )


def fit(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """Train on the documents of ``labels`` (doc_id, quality; bounded by the caller, so it is broadcast).

    Of rows that share a labelled id the one whose text has the least hash counts, so no more rows than labels are gathered.
    """
    got: pd.DataFrame = (
        docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
        .select("doc_id", "quality", feature_column(F.col("text")).alias("x"), F.xxhash64("text").alias("h"))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min(F.struct("h", "x"))["x"].alias("x"))
        .orderBy("doc_id").toPandas()
    )
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(FEATURES))
    return train(x, got["quality"].to_numpy(float))


def score_column(text: Column, model: AdditiveModel) -> Column:
    """Probability of good quality per text."""

    @F.arrow_udf("double")
    def score(array: pa.Array) -> pa.Array:
        cache, out = HashCache(), []
        for part in slices(array):
            x = np.array([features(t, cache) for t in part], float).reshape(len(part), len(FEATURES))
            out.append(model.score(x))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return score(text)


def classify(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, held_out, score and predicted label of every document."""
    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(F.col("text"), model).alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

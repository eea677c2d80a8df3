"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, and so have a few
pairs of features.  Cyclic boosting learns them: round after round, each
feature in turn gets a shallow tree over its own bins, fitted to what is left
to explain; the pairs that explain most of the rest follow.  A score is a sum
of looked-up values, added up for a whole batch of texts at once.

The model is fitted on at most ``SAMPLE_ROWS`` labelled rows, the first in the
order of a hash of their id, so the driver gets a matrix of that size at most.
Scoring reads every whole text.

Defined results: a null text counts as empty; every text, also an empty one,
gets a score; labels that are null or contradict each other (mean one half)
are not learnt from; repeated rows are scored each and learnt from once;
without labels of both classes every score is the share of ones, or 0.5 with
none; a null id is not held out, and never learnt from; an empty table gives an
empty result; further columns, also ones named like the results, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import non_null_text

#: Bound of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 20_000

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~", b"|<>{}[]\\/_=+", b"!?", b",.;:", b"\"'()-`", b"aeiouAEIOU", b" ", b"\n", bytes([*range(9), 11, 12, *range(14, 32), 127]), bytes(range(0xC0, 0x100)))
_MEMBERS = np.stack([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in _CLASSES], axis=1).astype(np.float64)
FEATURES = ("log_bytes", "log_words", "word_bytes", "lower", "upper", "digits", "symbols", "markup", "shouts", "stops", "quotes", "vowels", "spaces", "newlines", "controls", "leads", "upper_of_letters", "distinct_words", "distinct_lines", "line_words", "entropy", "stops_per_word", "repeats")


def features(text: str | None) -> np.ndarray:
    """The features of one whole text, in the order of ``FEATURES``."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    n = max(1, len(raw))
    words = text.split()
    lines = text.split("\n")
    k = max(1, len(words))
    shares = counts @ _MEMBERS / n
    p = counts[counts > 0] / n
    out = np.empty(len(FEATURES))
    out[0], out[1], out[2] = np.log1p(len(raw)), np.log1p(len(words)), n / k
    out[3:16] = shares
    out[16] = shares[1] / max(shares[0] + shares[1], 1e-9)
    out[17], out[18], out[19] = len(set(words)) / k, len(set(lines)) / len(lines), np.log1p(k / len(lines))
    out[20] = -(p * np.log2(p)).sum() if len(p) else 0.0
    out[21] = shares[6] * n / k
    out[22] = sum(map(eq, words, islice(words, 1, None))) / k
    return out


@dataclass
class Model:
    """Bin edges, the table of each feature and of each pair, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def decision(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for j, t in enumerate(self.tables):
                total += t[b[:, j]]
            for (j, k), t in zip(self.pairs, self.pair_tables, strict=True):
                total += t[b[:, j], b[:, k]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.decision(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, low: int, high: int, reg: float) -> tuple[float, int]:
    """The gain and place of the best cut of bins low to high (exclusive)."""
    if high - low < 2:
        return 0.0, low
    gl, hl = np.cumsum(g[low : high - 1]), np.cumsum(h[low : high - 1])
    gt, ht = g[low:high].sum(), h[low:high].sum()
    gain = gl**2 / (hl + reg) + (gt - gl) ** 2 / (ht - hl + reg) - gt**2 / (ht + reg)
    at = int(np.argmax(gain))
    return float(gain[at]), low + at + 1


def _shallow(g: np.ndarray, h: np.ndarray, reg: float, leaves: int = 3) -> np.ndarray:
    """The values over the bins of a tree with that many leaves, grown best cut first."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        (gain, at), i = max((_split(g, h, *p, reg), i) for i, p in enumerate(parts))
        if gain <= 1e-9:
            break
        low, high = parts.pop(i)
        parts += [(low, at), (at, high)]
    out = np.empty(len(g))
    for low, high in parts:
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + reg)
    return out


def _square(g: np.ndarray, h: np.ndarray, reg: float) -> tuple[float, np.ndarray]:
    """A tree over two features: one cut of the first, and one of the second on either side."""
    out, total = np.zeros_like(g), 0.0
    _, cut = _split(g.sum(1), h.sum(1), 0, len(g), reg)
    for rows in (slice(0, cut), slice(cut, len(g))):
        a, b = g[rows].sum(0), h[rows].sum(0)
        gain, at = _split(a, b, 0, len(a), reg)
        total += gain
        for cols in (slice(0, at), slice(at, len(a))):
            if b[cols].size:
                out[rows, cols] = a[cols].sum() / (b[cols].sum() + reg)
    return total, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 100, n_pairs: int = 6, n_bins: int = 64, rate: float = 0.15, reg: float = 2.0) -> Model:
    """Fits the tables to labels ``y`` (0 or 1) of the rows of ``x``."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model([], [], intercept=float(np.log(share / (1 - share))))
    cuts = np.linspace(0, 1, n_bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], cuts)) for j in range(x.shape[1])]
    m = Model(edges, [np.zeros(len(e) + 1) for e in edges], intercept=float(np.log(y.mean() / (1 - y.mean()))))
    b = m.bins(x)
    f = np.full(len(y), m.intercept)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            g, h = left()
            size = len(t)
            step = rate * _shallow(np.bincount(b[:, j], g, size), np.bincount(b[:, j], h, size), reg)
            t += step
            f += step[b[:, j]]
    g, h = left()

    def grid(j: int, k: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(b[:, j] * len(m.tables[k]) + b[:, k], w, len(m.tables[j]) * len(m.tables[k])).reshape(len(m.tables[j]), -1)

    ranked = sorted(((_square(grid(j, k, g), grid(j, k, h), reg)[0], j, k) for j in range(x.shape[1]) for k in range(j)), reverse=True)
    m.pairs = [(j, k) for gain, j, k in ranked[:n_pairs] if gain > 0]
    m.pair_tables = [np.zeros((len(m.tables[j]), len(m.tables[k]))) for j, k in m.pairs]
    for _ in range(pair_rounds):
        for (j, k), t in zip(m.pairs, m.pair_tables, strict=True):
            g, h = left()
            step = rate * _square(grid(j, k, g), grid(j, k, h), reg)[1]
            t += step
            f += step[b[:, j], b[:, k]]
    return m


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _feature_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([features(x) for x in t])


def fold(doc_id: str = "doc_id"):
    """The remainder by 3 of the CRC-32 of the id as text; 1 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Fits a model of ``labels.quality`` on documents that are not held out."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where(fold() != 1).groupBy("doc_id").agg(F.avg("y").alias("y")).where("y is not null and y <> 0.5")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", non_null_text().alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", _feature_column("text").alias("x"))
    got = rows.groupBy("doc_id").agg(F.max("x").alias("x"), F.first("y").alias("y")).orderBy("doc_id").toPandas()
    if got.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    return fit(np.stack(got["x"].to_list()), (got["y"].to_numpy() > 0.5).astype(float))


def score(docs: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds the score (0 to 1, higher: likelier of quality) of each whole text."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series(model.score(np.stack([features(x) for x in t])) if len(t) else np.empty(0))

    return docs.withColumn(out, scored(non_null_text(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: doc_id, held_out, score, predicted."""
    scored = score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

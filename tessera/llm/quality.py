"""Quality classifier: naive Bayes support vectors.

A text becomes a set of n-gram indicators. Each is scaled by the log of the ratio of its frequencies in the two classes,
and a linear hinge-loss model over these is fitted by dual coordinate descent. The margin becomes a probability by a
logistic curve fitted on rows kept out of the descent.

n-grams: one and two words in lower case; one to three word shapes, where a shape keeps a word's punctuation and the kind of its
letters and says whether it repeats the word before; and single shapes with their share of the text, in powers of two.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import WORD, bounded_batches

BUCKETS = 1 << 20
_words = re.compile(WORD).findall
_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a"), (re.compile(r"\d+"), "0"))


class _WordCodes(dict):
    """A word's 32-bit code and, in the upper half, its shape's; the codes of at most ``most`` words are remembered."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        shape = word
        for pattern, put in _SHAPES:
            shape = pattern.sub(put, shape)
        code = xxhash.xxh32_intdigest(shape) << 32 | xxhash.xxh32_intdigest(word.lower())
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 40:
            self[word] = code
        return code


_codes = _WordCodes()


def _mix(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(29))


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending; none for an empty text."""
    words = _words(text or "")
    if not words:
        return np.empty(0, np.int32)
    code = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words))
    word, shape = code & np.uint64(0xFFFFFFFF), code >> np.uint64(32)
    shape[1:] = shape[1:] * np.uint64(2) + (word[1:] == word[:-1])
    step = np.uint64(0x9FB21C651E98DF25)
    pair, triple = shape[:-1] * step + shape[1:], (shape[:-2] * step + shape[1:-1]) * step + shape[2:]
    kinds, n = np.unique(shape, return_counts=True)
    share = np.log2(len(words) / n).astype(np.uint64)
    found = [_mix(word, 1), _mix(word[:-1] * step + word[1:], 2), _mix(kinds, 3), _mix(np.unique(pair), 4), _mix(np.unique(triple), 5), _mix(kinds * step + share, 6)]
    return np.unique(np.concatenate(found) % np.uint64(BUCKETS)).astype(np.int32)


class Model:
    """Weights over buckets (scaled by the log-count ratios), the bias, and the two numbers of the logistic curve."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def margin(self, at: np.ndarray) -> float:
        return float(self.weights[at].sum() / np.sqrt(len(at))) + self.bias if len(at) else self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) with p and q the smoothed counts of each n-gram in the classes."""
    counts = np.full((2, BUCKETS), smooth)
    for r, t in zip(rows, y):
        counts[t, r] += 1  # a row's buckets are distinct
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; both classes weigh the same. Returns weights times ratios, and the bias.

    A row's scaled vector is made anew each time it is visited, so that the driver holds the buckets alone.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    most = np.where(y == 1, cost * len(y) / max(1, 2 * (y == 1).sum()), cost * len(y) / max(1, 2 * (y == 0).sum()))

    def vector(i: int) -> np.ndarray:
        return ratio[rows[i]] / np.sqrt(max(1, len(rows[i])))

    norm = np.array([v @ v + 1.0 for v in map(vector, range(len(y)))])
    w, bias, alpha, order = np.zeros(BUCKETS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        change = 0.0
        for i in order.permutation(len(y)):
            r, v = rows[i], vector(i)
            g = sign[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), most[i])
            if step := (new - alpha[i]) * sign[i]:
                w[r] += step * v
                bias += step
                alpha[i], change = new, max(change, abs(step))
        if change < 1e-3:
            break
    return (w * ratio).astype(np.float32), float(bias)


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton's method on smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, h = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()]), p * (1 - p) + 1e-9
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """A model from rows of buckets: the curve from a fit without every fifth row, the weights from all."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0)
    out = np.arange(len(y)) % 5 == 4
    slope, shift = 1.0, 0.0
    if out.any() and len(set(y[~out])) == 2:
        part = [r for r, o in zip(rows, out) if not o]
        ratio = log_ratios(part, y[~out])
        probe = Model(*descend(part, y[~out], ratio), 1.0, 0.0)
        slope, shift = _curve(np.array([probe.margin(r) for r, o in zip(rows, out) if o]), y[out])
    return Model(*descend(rows, y, log_ratios(rows, y)), slope, shift)


def fit(df: DataFrame, labels: DataFrame, train: Column, label: str = "quality", text: str = "text", key: str = "doc_id", most: int = 12_000) -> Model:
    """Learns from documents of ``df`` whose label is 0 or 1 and whose key satisfies ``train`` (an expression over ``key``).

    ``most`` bounds the labelled rows that it learns from, the ones whose keys hash lowest; their n-gram buckets, not their texts, reach the driver.
    Of rows that repeat a key one teaches, by the text that hashes lowest. Keys with contradicting labels, or null ones, are left out.
    Without both classes every score is the smoothed share of ones.
    """
    bounded_batches(df.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z")
    known = usable.where(train).join(df.where(F.col(key).isNotNull()).select(F.col(key)).distinct(), key, "left_semi")
    known = known.select(F.col(key).alias("k"), F.col("y").cast("int").alias("y")).orderBy(F.xxhash64("k"), "k").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], names=["k", "y", "at"])

    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), "k")  # ``most`` rows at most
    rows = rows.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    table = rows.mapInArrow(run, f"k {df.schema[key].dataType.simpleString()}, y int, at array<int>").toArrow()
    buckets = [c.values.to_numpy()[x:y] for c in table["at"].chunks for x, y in zip(c.offsets.to_numpy()[:-1], c.offsets.to_numpy()[1:])]
    y, order = table["y"].to_numpy(), np.argsort(table["k"].to_numpy(), kind="stable")
    model = fit_rows([buckets[i] for i in order], y[order])
    del table, buckets
    pa.default_memory_pool().release_unused()
    return model


def quality_scores(df: DataFrame, model: Model, text: str = "text", least: float = 0.3) -> DataFrame:
    """Every row of ``df`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``least``).

    Null and empty texts get the bias's score; whole texts are read, and only they: no other column has a part in a score. Columns of
    ``df`` with the result's names are replaced. The model, of a fixed size, is broadcast; there is no shuffle.
    """
    bounded_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.drop(*[c for c in df.columns if c in ("score", "predicted")])
    at = rows.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([held.score(t) for t in b.column(at).to_pylist()], pa.float64())], names=[*b.schema.names, "score"])

    out = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))

"""Quality by histogram gradient-boosted trees over document statistics.

Statistics come from a text alone: its byte histogram, its words and its lines.
Training takes a bounded sample of labelled rows (see labelled_sample); each
feature is cut into at most ``BINS`` bins at sample quantiles, and trees grow level
by level from gradient histograms. The trees are flattened into arrays, complete
to a fixed depth, so a batch walks all trees with one vectorised step per level.

Defined cases: null texts and texts without words score 0; unlabelled rows are not learned from; with no labelled rows the score
is 0.5 throughout, with labels of one kind it leans to that kind; repeated rows
are scored alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled_sample

BINS = 48
DEPTH = 4
TREES = 80
RATE = 0.15
RIDGE = 2.0
LEAST_ROWS = 8
SAMPLE = 20_000

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_LOWER = (_B >= 97) & (_B <= 122)
_DIGIT = (_B >= 48) & (_B <= 57)
_HIGH = _B >= 128
_TAIL = (_B >= 128) & (_B < 192)
_SPACE = np.isin(_B, [9, 10, 11, 12, 13, 32])
_STOP = np.isin(_B, [ord(c) for c in ".,;:?'"])
_ODD = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE | _STOP)
_GROUPS = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, _SPACE, _STOP, _ODD, _TAIL]).astype(np.float64).T
_SINGLES = [ord(c) for c in "!|$%&#*=<>{}@/_-\".,\n"]

FEATURES = 8 + len(_SINGLES) + 13
WORDS = 8 + len(_SINGLES) + 1


def statistics(text: str | None) -> np.ndarray:
    """The features of one text."""
    out = np.zeros(FEATURES)
    if not text:
        return out
    data = text.encode()
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    out[:8] = hist @ _GROUPS / size
    out[8 : 8 + len(_SINGLES)] = hist[_SINGLES] / size
    words = text.split()
    n = len(words)
    counts = Counter(words)
    most = max(counts.values(), default=0)
    lines = text.split("\n")
    own = len(set(lines))
    mean = sum(map(len, words)) / n if n else 0.0
    pairs = len(set(zip(words, words[1:])))
    out[8 + len(_SINGLES) :] = (
        np.log1p(size), np.log1p(n), mean, len(counts) / n if n else 0.0, most / n if n else 0.0,
        sum(map(eq, words, words[1:])) / n if n else 0.0, pairs / (n - 1) if n > 1 else 0.0, np.log1p(len(lines)),
        own / len(lines), size / len(lines), max(map(len, words), default=0), sum(map(str.istitle, words)) / n if n else 0.0,
        sum(map(str.isupper, words)) / n if n else 0.0,
    )
    return out


@dataclass
class Trees:
    """trees x nodes arrays; node k has children 2k + 1 and 2k + 2. The last level holds values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        at = np.zeros((n, t), np.int64)
        rows, trees = np.arange(n)[:, None], np.arange(t)[None, :]
        for _ in range(DEPTH):
            right = x[rows, self.feature[trees, at]] > self.threshold[trees, at]
            at = 2 * at + 1 + right
        return self.base + self.value[trees, at - (2**DEPTH - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Boost on the logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if not len(y):
        return Trees(feature, threshold, value, 0.0)
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    n, f = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # bin b: x <= cuts[b]
    flat = bins + np.arange(f) * BINS
    z = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)  # place within the level
        for level in range(DEPTH):
            k, first = 2**level, 2**level - 1
            where = (flat + (node * (f * BINS))[:, None]).ravel()
            total = lambda w: np.bincount(where, np.repeat(w, f), minlength=k * f * BINS).reshape(k, f, BINS)  # noqa: B023, E731
            g, h, c = (np.cumsum(total(w), axis=2) for w in (grad, hess, np.ones(n)))
            ga, ha, ca = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + RIDGE) + (ga - g) ** 2 / (ha - h + RIDGE) - ga**2 / (ha + RIDGE)
            gain[(c < LEAST_ROWS) | (ca - c < LEAST_ROWS)] = 0.0
            best = gain.reshape(k, -1).argmax(axis=1)
            fs, bs = best // BINS, best % BINS
            good = gain.reshape(k, -1)[np.arange(k), best] > 1e-6
            for j in range(k):
                if good[j] and bs[j] < len(cuts[fs[j]]):
                    feature[t, first + j], threshold[t, first + j] = fs[j], cuts[fs[j]][bs[j]]
            node = 2 * node + (x[np.arange(n), feature[t, first + node]] > threshold[t, first + node])
        gl, hl = np.bincount(node, grad, minlength=leaves), np.bincount(node, hess, minlength=leaves)
        value[t] = RATE * gl / (hl + RIDGE)
        z += value[t][node]
    return Trees(feature, threshold, value, base)


@dataclass
class QualityModel:
    trees: Trees


def learn_from(
    docs: DataFrame, labels: DataFrame, label: str = "quality", learnable: Column | None = None, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text",
) -> QualityModel:
    """Statistics are taken where the texts are; only these reach the driver, for at most sample rows."""
    learnable = F.lit(True) if learnable is None else learnable
    rows = labelled_sample(docs, labels, label, learnable, sample, id_col, text_col).drop(id_col)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [statistics(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    at = rows.mapInArrow(taken, "x array<double>, y int").toPandas()
    x = np.stack(at["x"].tolist()) if len(at) else np.zeros((0, FEATURES))
    return QualityModel(fit(x, at["y"].to_numpy(dtype=np.float64)))


def score_texts(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs[id_col] and score, in one pass; each batch walks the trees at once."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([statistics(t.as_py()) for t in b.column(1)]) if b.num_rows else np.zeros((0, FEATURES))
            score = np.where(x[:, WORDS] > 0, model.trees.score(x), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["id", "score"])

    out = rows.mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.withColumnRenamed("id", id_col)

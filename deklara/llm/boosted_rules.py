"""Operator 2: quality rules as gradient-boosted trees over document statistics.

Trees are grown on histograms of the features and flattened into arrays of nodes (feature, border,
left, right, value); a batch of documents descends all of them with array indexing.  Features
listed in ``FALLING`` may only lower the verdict as they rise and those in ``RISING`` only raise
it: a split that would break this is not taken, and the children's values are kept on their side
of the split's middle, so the constraint holds over the whole tree.

The fixed base rules come first: a document of fewer than 10 words, or with over a fifth of its
words in repeated windows, fails whatever the trees say.

The trees learn ``labels.quality`` from a sample of at most ``bound`` labelled documents outside
the held-out fold; everything else covers all rows.

Defined results: null and empty texts have zero counts and fail.  Repeated rows each have their
row.  Without any labels of both kinds the trees accept what the base rules accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.llm.docstats import BASE, FEATURES, batch_statistics, labelled_sample

FALLING = ("symbol_share", "dup_line_share", "repeat_share", "pipe_share", "top_word_share")
RISING = ("stopped_lines",)


@dataclass
class Forest:
    """Flattened trees: node i of all trees in one numbering; a leaf has feature -1."""

    start: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    border: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for rows of features."""
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root, np.int32)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                goes = x[row, np.maximum(f, 0)] <= self.border[node]
                node = np.where(inner, np.where(goes, self.left[node], self.right[node]), node)
            total += self.value[node]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def bin_borders(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Borders between at most ``bins`` bins of each feature, at its quantiles."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.empty(0) for c in x.T]


def train(
    x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0
) -> Forest:
    """``signs`` has -1, 0 or 1 for each feature: how the score may move as the feature rises."""
    if not len(y) or y.min() == y.max():
        return Forest(start=30.0 if not len(y) else 30.0 * (2 * y[0] - 1))
    borders = bin_borders(x, bins)
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T, strict=True)])
    p = y.mean()
    forest = Forest(start=float(np.log(p / (1 - p))), depth=depth)
    total = np.full(len(y), forest.start)
    nodes: list[list[float]] = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + ridge), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        at = len(nodes)
        own = leaf(g[rows].sum(), h[rows].sum(), low, high)
        nodes.append([-1, 0.0, at, at, rate * own])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and len(rows) >= 20:
            base = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
            for f, b in enumerate(borders):
                if not len(b):
                    continue
                gs = np.cumsum(np.bincount(binned[f, rows], g[rows], len(b) + 1))
                hs = np.cumsum(np.bincount(binned[f, rows], h[rows], len(b) + 1))
                ns = np.cumsum(np.bincount(binned[f, rows], minlength=len(b) + 1))
                gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
                gr, hr, nr = gs[-1] - gl, hs[-1] - hl, ns[-1] - nl
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = gl * vl - 0.5 * (hl + ridge) * vl**2 + gr * vr - 0.5 * (hr + ridge) * vr**2 - 0.5 * base
                gain[(nl < 5) | (nr < 5) | (signs[f] * (vr - vl) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k, float(vl[k]), float(vr[k]))
        if best[1] >= 0:
            _, f, k, vl, vr = best
            middle = (vl + vr) / 2
            goes = binned[f, rows] <= k
            bounds = {-1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}.get(int(signs[f]), ((low, high),) * 2)
            left = grow(rows[goes], g, h, level + 1, *bounds[0])
            right = grow(rows[~goes], g, h, level + 1, *bounds[1])
            nodes[at] = [f, borders[f][k], left, right, 0.0]
        return at

    every = np.arange(len(y))
    for _ in range(trees):
        q = 1.0 / (1.0 + np.exp(-total))
        first = len(nodes)
        forest.roots.append(grow(every, y - q, np.maximum(q * (1 - q), 1e-6), 0, -8.0, 8.0))
        one = _flattened(Forest(0.0, [0], depth=depth), [[r[0], r[1], r[2] - first, r[3] - first, r[4]] for r in nodes[first:]])
        q = one.score(x)
        total += np.log(q / (1 - q))
    return _flattened(forest, nodes)


def _flattened(forest: Forest, nodes: list[list[float]]) -> Forest:
    table = np.array(nodes)
    forest.feature, forest.left, forest.right = (table[:, i].astype(np.int32) for i in (0, 2, 3))
    forest.border, forest.value = table[:, 1], table[:, 4]
    return forest


VERDICTS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"


def _judge(forest: Forest, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, x = batch_statistics(batch.column(1))
        score = forest.score(x)
        failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)],
            names=["doc_id", *BASE, "base_failed", "kept", "score"],
        )


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> Forest:
    x, y = labelled_sample(docs, labels, "quality", bound)
    signs = np.array([-1 if f in FALLING else 1 if f in RISING else 0 for f in FEATURES])
    return train(x, y, signs)


def judge(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The base counts and the verdict on every document."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        partial(_judge, forest, least), VERDICTS
    )

"""Operator 9: quality by a generalised additive model with pairwise interactions.

The features of the document statistics are cut into bins.  Cyclic boosting visits one feature
after the other; each visit fits a shallow tree of at most three leaves to what the others leave
unexplained, adds a small step of it to that feature's lookup table, and goes on.  After the single
features, the pairs whose coarse two-way table would explain most of the rest are boosted the same
way with trees of four quadrants.  What remains of all trees are tables: a document's score is the
start value plus one table entry for each feature and each pair.

The model learns ``labels.quality`` from at most ``bound`` labelled documents outside the held-out
fold; scoring covers all rows.

Defined results: a null text counts as empty, and empty texts are scored like any other (all
features zero).  Repeated rows each have their row.  Without labels every score is 0.5; with labels
of one kind only it is that kind's side of the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.llm.boosted_rules import bin_borders
from deklara.llm.common import crc_fold, row_of, row_schema, texts_of
from deklara.llm.docstats import batch_statistics, labelled_sample

COARSE = 12


@dataclass
class Additive:
    start: float = 0.0
    borders: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for borders, table, column in zip(self.borders, self.tables, x.T, strict=False):
            total += table[np.searchsorted(borders, column, side="left")]
        if self.pairs:
            at = [np.searchsorted(b, c, side="left") for b, c in zip(self.coarse, x.T, strict=True)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[at[i], at[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _cuts(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values by bin of a tree grown best split first on one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, -1, -1)
        for k, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (float(gain[cut]), k, a + cut + 1)
        if best[1] < 0:
            break
        a, b = parts[best[1]]
        parts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four quadrants: its gain, and the leaf values by cell."""
    def corner(t: np.ndarray) -> np.ndarray:
        return t.cumsum(0).cumsum(1)

    gc, hc = corner(g), corner(h)
    gain = np.full(g.shape, -np.inf)
    parts = []
    for c in (gc, hc):
        a = c[:-1, :-1]
        b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
        parts.append((a, b, d, c[-1, -1] - a - b - d))
    if not parts[0][0].size:
        return 0.0, np.zeros(g.shape)
    gain = sum(p**2 / (q + ridge) for p, q in zip(*parts, strict=True)) - gc[-1, -1] ** 2 / (hc[-1, -1] + ridge)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(g.shape)
    values = [p[i, j] / (q[i, j] + ridge) for p, q in zip(*parts, strict=True)]
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(gain[i, j]), out


def train(x: np.ndarray, y: np.ndarray, cycles: int = 120, pair_cycles: int = 40, n_pairs: int = 6, bins: int = 48, rate: float = 0.08, ridge: float = 2.0) -> Additive:
    if not len(y):
        return Additive()
    p = np.clip(y.mean(), 1 / (len(y) + 2), 1 - 1 / (len(y) + 2))
    model = Additive(float(np.log(p / (1 - p))))
    if y.min() == y.max():
        return model
    model.borders = bin_borders(x, bins)
    model.coarse = bin_borders(x, COARSE)
    fine = [np.searchsorted(b, c, side="left") for b, c in zip(model.borders, x.T, strict=True)]
    coarse = [np.searchsorted(b, c, side="left") for b, c in zip(model.coarse, x.T, strict=True)]
    model.tables = [np.zeros(len(b) + 1) for b in model.borders]
    total = np.full(len(y), model.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1.0 / (1.0 + np.exp(-total))
        return y - q, np.maximum(q * (1 - q), 1e-6)

    for _ in range(cycles):
        for f, at in enumerate(fine):
            g, h = slopes()
            n = len(model.tables[f])
            step = rate * np.clip(_cuts(np.bincount(at, g, n), np.bincount(at, h, n), 3, ridge), -4, 4)
            model.tables[f] += step
            total += step[at]

    def two_way(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = [(-_quadrants(*two_way(i, j, g, h), ridge)[0], i, j) for i in range(len(fine)) for j in range(i)]
    model.pairs = [(i, j) for gain, i, j in sorted(gains)[:n_pairs] if gain < 0]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_cycles):
        for k, (i, j) in enumerate(model.pairs):
            step = rate * np.clip(_quadrants(*two_way(i, j, *slopes()), ridge)[1], -4, 4)
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def _scores(model: Additive, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.score(batch_statistics(texts_of(batch))[1])
        own = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(score), pa.array((score >= least).astype(np.int32))],
            names=[*batch.schema.names, "score", "predicted"],
        )


def fit(docs: DataFrame, labels: DataFrame, bound: int = 20_000) -> Additive:
    return train(*labelled_sample(docs, labels, "quality", bound))


def score(docs: DataFrame, model: Additive, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = own.mapInArrow(partial(_scores, model, least), "doc_id bigint, text string, score double, predicted int")
    return scored.select(
        "doc_id", (F.coalesce(crc_fold(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"), "score", "predicted"
    )


def accepted(docs: DataFrame, model: Additive, least: float = 0.3) -> DataFrame:
    """The documents that score ``least`` or more, with their own columns."""
    own = docs.select(row_of(docs))
    kept = own.mapInArrow(partial(_scores, model, least), row_schema(docs, score="double", predicted="int"))
    return kept.where("predicted = 1").select("row.*")

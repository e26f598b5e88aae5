"""Operator 5: toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples and unlabelled text are learned from.  With the class prior ``p`` the
risk of a scorer is ``p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives))``: the loss of
unlabelled text counted as clean holds the loss of its hidden toxic part, which the middle term takes
away; when the difference falls under zero the scorer has begun to learn the unlabelled rows by
heart, and the step goes up that term instead of down (Kiryo and others, 2017).

A text is the set of its lower-cased words and of their beginnings of 3 to 8 letters, which finds the
stem of an inflected word.  Of these the model sees at most ``features``: those whose share among
the positives, times the prior, over their share in unlabelled text is at least ``surest``, which is
the chance that a text that holds one is toxic, and whose count among the positives lies at least
``deviations`` standard deviations over what unlabelled text lets expect.  Near copies in the sample
count once, or a copied text would make its rare words look like signs.  Presence counts once, so length alone moves
nothing, and whole texts are read.

Bounds (parameters): ``positives`` confirmed examples, taken by a hash of the id, and about
``unlabelled`` rows by the same hash.  The prior is the share of toxic rows among all labelled rows
outside the held-out fold, unless given.

Defined results: null and empty texts have no features and get the score of the intercept.
Repeated rows each have their row.  Without any confirmed toxic example every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.llm.common import crc_fold, hash_share, materialise, remove, row_of, row_schema, texts_of
from deklara.llm.minhash import shingle_set

_WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8
#: Features counted at once; each further text adds its own.
MOST = 50_000


@dataclass
class Scorer:
    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = -30.0

    def __post_init__(self) -> None:
        self.heads = {f[:SHORTEST] for f in self.index}

    def features(self, text: str | None) -> list[int]:
        """Which of the model's features a whole text holds."""
        index, heads, found = self.index, self.heads, set()
        for word in set(_WORD.findall((text or "").lower())):
            if word[:SHORTEST] in heads:
                found.update(i for f in parts(word) if (i := index.get(f)) is not None)
        return sorted(found)

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.features(text)].sum())
        return 1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0)))


def parts(word: str) -> list[str]:
    """A word, marked as whole, and its beginnings."""
    return [word + "$", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature, the texts of a batch that hold it, by kind; a feature may come in several rows."""
    for batch in batches:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for positive, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            found[positive].update({f for w in words for f in parts(w)})
            if len(found[True]) + len(found[False]) >= MOST:
                yield _counted(found)
                found = {True: Counter(), False: Counter()}
        yield _counted(found)


def _counted(found: dict[bool, Counter]) -> pa.RecordBatch:
    both = list(found[True])
    rest = [f for f in found[False] if f not in found[True]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(both + rest, pa.string()),
            pa.array([found[True][f] for f in both] + [0] * len(rest), pa.int64()),
            pa.array([found[False][f] for f in both + rest], pa.int64()),
        ],
        names=["feature", "p", "u"],
    )


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a text's smallest shingle hash, which most near copies share and other texts do not."""
    for batch in batches:
        marks = pa.array((int(s[0].view(np.int64)) if len(s) else 0 for s in (shingle_set(t.as_py()) for t in batch.column(1))), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), marks, batch.column(1)], names=["positive", "mark", "text"])


def _rows(model: Scorer, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [model.features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["positive", "found"])


def minimise(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4, floor: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear scorer at the least non-negative risk, by Adam."""
    d = xp.shape[1]
    w = np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))

    def slope(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.append(by.astype(np.float32) @ x, by.sum()) / len(x)

    for step in range(1, steps + 1):
        single = w[:d].astype(np.float32)  # as the rows are, or they would be copied
        zp, zu = (xp @ single).astype(np.float64) + w[d], (xu @ single).astype(np.float64) + w[d]
        clean = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_clean = slope(xu, sigmoid(zu)) - prior * slope(xp, sigmoid(zp))
        g = prior * slope(xp, sigmoid(zp) - 1) + g_clean if clean >= floor else -g_clean
        g = g + ridge * np.append(w[:d], 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:d], float(w[d])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = 3000,
    unlabelled: int = 9000,
    features: int = 1024,
    prior: float | None = None,
    surest: float = 0.5,
    deviations: float = 4.0,
    folds: int = 5,
) -> Scorer:
    known = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & (crc_fold(F.col("doc_id").cast("bigint"), folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    seen = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not seen["toxic"]:
        return Scorer()
    prior = min(max(seen["toxic"] / seen["n"] if prior is None else prior, 1e-4), 0.9)
    ids = known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id")
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    share = min(1.0, unlabelled / max(1, docs.count()))
    rows = (
        own.join(F.broadcast(ids), "doc_id").select(F.lit(True).alias("positive"), "text").unionAll(
            own.where((crc_fold(F.col("doc_id"), folds) != 0) & (hash_share(F.col("doc_id"), 5) < share)).select(
                F.lit(False).alias("positive"), "text"
            )
        )
    )
    kind = "positive boolean, mark bigint, text string"
    # Of near copies one is taken by a hash of its text, so that the model does not depend on the order of tasks.
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    rows, path = materialise(rows.mapInArrow(_marked, kind).groupBy("positive", "mark").agg(one), "toxicity-sample")
    rows = rows.select("positive", "text")
    sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(True, 0), sizes.get(False, 0)
    if not n_p or not n_u:
        return Scorer()
    by_chance = F.col("u") * (n_p / n_u)
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    chosen = (
        rows.mapInArrow(_counts, "feature string, p bigint, u bigint")
        .groupBy("feature")
        .agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where(((F.col("p") - by_chance) / F.sqrt(by_chance + 1) >= deviations) & (prior * rate_p > surest * rate_u))
        .orderBy(F.desc((rate_p - rate_u) * F.log(rate_p / rate_u)), "feature")
        .limit(features)
        .collect()
    )
    model = Scorer({r["feature"]: i for i, r in enumerate(chosen)}, np.zeros(len(chosen)))
    found = rows.mapInArrow(partial(_rows, model), "positive boolean, found array<int>").toPandas()
    x = np.zeros((len(found), len(chosen)), np.float32)
    for row, at in zip(x, found["found"], strict=True):
        row[np.asarray(at, np.int64)] = 1
    remove(docs.sparkSession, path)
    x = x[np.lexsort([x @ np.arange(1, len(chosen) + 1, dtype=np.float32), found["positive"].to_numpy()])]
    n_u = int((~found["positive"].to_numpy()).sum())
    model.weights, model.intercept = minimise(x[n_u:], x[:n_u], prior)
    return model


def _scores(model: Scorer, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.array([model.score(t.as_py()) for t in texts_of(batch)], np.float64)
        own = [batch.column(i) for i in range(batch.num_columns)]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(score), pa.array((score >= least).astype(np.int32))],
            names=[*batch.schema.names, "score", "predicted"],
        )


def score(docs: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = own.mapInArrow(partial(_scores, model, least), "doc_id bigint, text string, score double, predicted int")
    return scored.select(
        "doc_id", (F.coalesce(crc_fold(F.col("doc_id"), 5), F.lit(-1)) == 0).alias("held_out"), "score", "predicted"
    )


def accepted(docs: DataFrame, model: Scorer, least: float = 0.5) -> DataFrame:
    """The documents that score under ``least``, with their own columns."""
    own = docs.select(row_of(docs))
    kept = own.mapInArrow(partial(_scores, model, least), row_schema(docs, score="double", predicted="int"))
    return kept.where("predicted = 0").select("row.*")

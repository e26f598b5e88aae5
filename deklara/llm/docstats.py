"""Statistics of whole texts, shared by the quality operators.

``BASE`` are the five counts of the quality rules' contract; ``FEATURES`` are the numbers that the
models see, all ratios or logarithms, so that very long texts need no special treatment.  A null
text counts as empty; an empty text has zero everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
_FACTORS = np.array([xxhash.xxh64_intdigest(b"window", i) | 1 for i in range(WINDOW)], dtype=np.uint64)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words",
    "mean_word",
    "symbol_share",
    "dup_line_share",
    "repeat_share",
    "distinct_share",
    "digit_share",
    "upper_share",
    "punct_share",
    "pipe_share",
    "stopped_lines",
    "words_per_line",
    "short_words",
    "top_word_share",
]
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\r\x0b\x0c"
_DIGITS = "0123456789"
_STOPS = ".,;:!?"


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the model features of one text."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    if not n:
        return [0, 0, sum(map(text.count, _SYMBOLS)), 0, 0], [0.0] * len(FEATURES)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    repeated = _covered(hashes)
    lines, seen, doubled, filled, stopped = text.split("\n"), set(), 0, 0, 0
    for line in lines:
        bare = line.strip(_SPACES)
        if bare:
            filled += 1
            doubled += line in seen
            stopped += bare[-1] in ".!?"
        seen.add(line)
    _, counts = np.unique(hashes, return_counts=True)
    features = [
        float(np.log2(n + 1)),
        chars / n,
        symbols / chars,
        doubled / filled,
        repeated / n,
        len(counts) / n,
        sum(map(text.count, _DIGITS)) / chars,
        sum(1 for w in words if 65 <= w[0] <= 90) / n,
        sum(map(text.count, _STOPS)) / chars,
        text.count("|") / n,
        stopped / filled,
        float(np.log2(n / filled)),
        sum(1 for w in words if len(w) <= 3) / n,
        float(counts.max()) / n,
    ]
    return [n, chars, symbols, doubled, repeated], features


def _covered(hashes: np.ndarray) -> int:
    """Words that lie in a window of five words found twice or more."""
    n = len(hashes)
    m = n - WINDOW + 1
    if m < 2:
        return 0
    windows = np.zeros(m, np.uint64)
    for i in range(WINDOW):
        windows += hashes[i : i + m] * _FACTORS[i]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if len(counts) == m:
        return 0
    before = np.concatenate(([0], np.cumsum(counts[inverse] > 1)))
    word = np.arange(n)
    return int((before[np.minimum(word + 1, m)] > before[np.maximum(word - WINDOW + 1, 0)]).sum())


def batch_statistics(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """[texts, 5] counts and [texts, features] of an Arrow column."""
    rows = [statistics(t.as_py()) for t in texts]
    base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
    return base, np.array([r[1] for r in rows], np.float64).reshape(-1, len(FEATURES))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, bound: int, folds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Features and 0/1 labels of at most ``bound`` labelled rows, taken by a hash of the id.

    Rows whose crc32(doc_id) modulo ``folds`` is 0 are held out and never learned from.  The
    bound makes the sample's ids small enough to broadcast and its features small enough for the
    driver, whatever the size of the corpus.  Of rows that repeat an id one is taken, by a hash of its text.
    """
    ids = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where(f"doc_id is not null and label in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % {folds} <> 0")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    rows = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
        .select("label", "text")
        .mapInArrow(_features, "label int, features array<double>")
        .toPandas()
    )
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    order = np.lexsort([*x.T, rows["label"].to_numpy()])  # the model must not depend on the order of arrival
    return x[order], rows["label"].to_numpy()[order].astype(np.float64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features = batch_statistics(batch.column(1))[1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(features.tolist(), pa.list_(pa.float64()))], names=["label", "features"]
        )

"""Operator 4: language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound from its letters' vectors, the
first rotated twice and the second once; a text is the bundle (sum) of its trigrams; a language's
prototype is the bundle of its documents, each scaled to length one.  A text is given the language
whose prototype has the largest cosine with it.

Texts are lower-cased; anything that is no letter is one blank, runs of blanks are one.  Every letter of
every script has a vector of its own, drawn by a hash from its code point, so that none is stored.  The
distinct trigrams of a block of texts are counted per text and bundled by one matrix product; a long
text is bundled block by block.

Learned from the texts and non-null languages of documents whose crc32(doc_id) modulo ``folds`` is
not ``held``: about ``per_language`` documents of each language, by a hash of the id, or all if there
are fewer.  The number of languages is bounded by ``max_languages``.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every
text if no language was learned.  Equal cosines go to the first language in alphabetical order.
Repeated rows each have their row.  An empty table gives an empty result.  Further columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deklara.llm.common import crc_fold, hash_share
from deklara.llm.hashing import BASE, mixed

#: Texts and trigrams that are counted at once.
_BLOCK_TEXTS, _BLOCK_TRIGRAMS = 64, 200_000
#: Up to so many possible trigrams of a block their places are looked up in a table; beyond it they are sorted.
_TABLE = 1 << 22


@cache
def _is_letter() -> np.ndarray:
    """Of every code point, whether it is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """[codes, dimensions]: the vector of +1 and -1 of each code point, 0 standing for the blank."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64) * np.uint64(BASE)
    bits = mixed(mixed(codes.astype(np.uint64) + np.uint64(1))[:, None] + words)
    return (np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1)[:, :dimensions].astype(np.int8) << 1) - np.int8(1)


def letters(text: str | None) -> np.ndarray:
    """The code points of a text's letters in lower case, 0 for what stands between them and at both ends."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    codes = np.concatenate(([0], np.where(_is_letter()[codes], codes, 0), [0])).astype(np.int32)
    return codes[(codes > 0) | (np.concatenate(([1], codes[:-1])) > 0)]


def _bundle(parts: list[np.ndarray], dimensions: int) -> np.ndarray:
    """The sums of the trigram vectors of each part, a run of letters."""
    joined = np.concatenate(parts)
    seen = np.zeros(0x110000, bool)
    seen[joined] = True
    codes = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[codes] = np.arange(len(codes))
    n = len(codes)
    runs = [place[p] for p in parts]
    numbers = np.concatenate([(r[:-2] * n + r[1:-1]) * n + r[2:] for r in runs])
    if n**3 <= _TABLE:
        used = np.zeros(n**3, bool)
        used[numbers] = True
        distinct = np.flatnonzero(used)
        at = np.empty(n**3, np.int32)
        at[distinct] = np.arange(len(distinct))
        at = at[numbers]
    else:
        distinct, at = np.unique(numbers, return_inverse=True)
    cells = np.repeat(np.arange(len(parts)), [len(p) - 2 for p in parts]) * len(distinct) + at
    counts = np.bincount(cells, minlength=len(parts) * len(distinct)).astype(np.float32).reshape(len(parts), -1)
    vectors = letter_vectors(codes, dimensions)
    first, second, out = np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), np.zeros((len(parts), dimensions), np.float32)
    for k in range(0, len(distinct), 4096):
        some = distinct[k : k + 4096]
        bound = first[some // n**2] * second[some // n % n] * vectors[some % n]
        out += counts[:, k : k + 4096] @ bound.astype(np.float32)
    return out


def bundles(texts: list[str | None], dimensions: int) -> np.ndarray:
    """[texts, dimensions]: the sum of each text's trigram vectors."""
    out = np.zeros((len(texts), dimensions), np.float32)
    rows: list[int] = []
    parts: list[np.ndarray] = []
    size = 0

    def close() -> None:
        nonlocal size
        if parts:
            np.add.at(out, rows, _bundle(parts, dimensions))
        rows.clear()
        parts.clear()
        size = 0

    for row, text in enumerate(texts):
        own = letters(text)
        for at in range(0, len(own) - 2, _BLOCK_TRIGRAMS):
            rows.append(row)
            parts.append(own[at : at + _BLOCK_TRIGRAMS + 2])
            size += len(parts[-1])
            if len(parts) >= _BLOCK_TEXTS or size >= _BLOCK_TRIGRAMS:
                close()
    close()
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _profiles(dimensions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang, row in zip(langs, _unit(bundles(batch.column("text").to_pylist(), dimensions)), strict=True):
            total[lang] = total.get(lang, 0) + row.astype(np.float64)
    langs = sorted(total)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.array(langs, object), dimensions), pa.string()),
            pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(langs))),
            pa.array(np.concatenate([total[lang] for lang in langs]) if langs else np.empty(0)),
        ],
        names=["lang", "dimension", "value"],
    )


def fit(
    docs: DataFrame, per_language: int = 2000, dimensions: int = 1024, folds: int = 3, held: int = 1, max_languages: int = 1000
) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their prototypes, one row each."""
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_fold(F.col("doc_id").cast("bigint"), folds) != held)
    )
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return [], np.empty((0, dimensions))
    share = F.element_at(
        F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n)))), F.col("lang")
    )
    rows = (
        known.where(hash_share(F.col("doc_id"), 4) < share)
        .mapInArrow(partial(_profiles, dimensions), "lang string, dimension int, value double")
        .groupBy("lang", "dimension")
        .agg(F.sum("value").alias("value"))
        .toPandas()
    )
    langs = sorted(rows["lang"].unique())
    table = np.zeros((len(langs), dimensions))
    table[np.searchsorted(langs, rows["lang"]), rows["dimension"]] = rows["value"].round(6)
    return langs, _unit(table)


def _predict(langs: list[str], prototypes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = bundles(batch.column("text").to_pylist(), prototypes.shape[1])
        some = (np.abs(rows).sum(axis=1) > 0) & (len(langs) > 0)
        found, score = np.full(len(rows), "und", object), np.zeros(len(rows))
        if some.any():
            cosine = _unit(rows[some]) @ prototypes.T
            best = cosine.argmax(axis=1)
            found[some] = np.array(langs, object)[best]
            score[some] = np.clip(cosine[np.arange(len(best)), best], 0, 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"]
        )


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the cosine) for every document."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(partial(_predict, langs, prototypes), "doc_id bigint, lang_pred string, score double").select(
        "doc_id", (F.coalesce(crc_fold(F.col("doc_id"), folds), F.lit(-1)) == held).alias("held_out"), "lang_pred", "score"
    )

"""Operator 1: near-duplicate documents by HyperMinHash.

A document is the set of its distinct shingles of five words (lower-cased A-Z; with fewer words
the whole sequence is one shingle).  The sketch has ``bands * rows`` buckets, an equal share of them for each
of ``REPLICAS`` permutations of the shingles' 64-bit hashes, so that sets of some twenty shingles fill most of
them.  Of a bucket's smallest hash the register keeps the number of leading zeros and 26 bits of mantissa.
Registers are read in bands of ``rows``; two documents that agree in a band are candidates.  Folded to a byte
each, the registers estimate a pair: the share of equal ones among those filled on either side, less the share
that agrees by chance.  Unless the estimate lies more than 6 standard errors under the threshold, the
pair is verified on full sets.

With 64 bands of 5, a pair at a similarity of exactly 0.75 is missed by the bands with a
probability of 3e-8, at 0.8 of 6e-12.  Sets of very few shingles leave registers empty; an empty register
equals an empty register, and a band of empty registers proposes nothing, so small sets that share
most shingles still meet.

Candidates are first held against one leader each (``linkage``).  Between what is then left in different groups
a pair is looked at only if it can reach the threshold at all: in one order of all shingles, rarest
first, two sets that share ``n`` of their ``a`` and ``b`` shingles have one in common among the first ``a - n + 1``
and ``b - n + 1``.  The much changed members of a large group of copies, whose rare shingles are their own, so
meet none of it, and nothing that could be linked is left out.

Texts with equal sets are one class and one node, whatever their ids; copies are never expanded into pairs.
Nodes are numbered when the classes are written, so that no two can be taken for one another.

Defined results: null, empty and blank texts have an empty set, no link, and stand alone.  Rows are linked by
their own texts: of different texts under one doc_id each takes part, and rows without a doc_id like
others.  A group is named by its smallest doc_id; one of rows without any has a null component_id, and its
rows count as kept (``near_duplicate_stage`` of the pipeline keeps one).  Two groups may have one name if a doc_id
has unlike texts.  An empty table gives an empty result.  Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deklara.llm import linkage
from deklara.llm.common import materialise, remove
from deklara.llm.hashing import FACTORS, mixed, spans_hashed

WIDTH = 5
MANTISSA = 26
#: Permutations, a power of two; ``bands * rows`` must be a multiple of it.
REPLICAS = 16
#: Chance that two different registers fold to one byte, and how far an estimate may err.
CHANCE = 1 / 255
DEVIATIONS = 6
#: Characters whose words are hashed at once.
CHUNK = 1 << 19


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Of every byte: a 64-bit value, and whether it belongs to a word."""
    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    return mixed(np.arange(1, 257, dtype=np.uint64)), ~blank


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK or i + 1 == len(texts):
            yield from _shingle_sets([t or "" for t in texts[first : i + 1]], width)
            first, size = i + 1, 0


def _shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    encoded = [t.encode() for t in texts]
    codes = np.frombuffer(b"\n".join(encoded).lower(), np.uint8)
    value, of_word = _bytes()
    on = np.zeros(len(codes) + 2, bool)
    np.take(of_word, codes, out=on[1:-1])
    edges = np.flatnonzero(on[1:] != on[:-1])
    words = spans_hashed(np.take(value, codes), edges[::2], edges[1::2])
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for i in range(width):
        whole += words[i : i + len(whole)] * FACTORS[i]
    whole = mixed(whole + np.uint64(width))
    bounds = np.searchsorted(edges[::2], np.cumsum([0, *(len(e) + 1 for e in encoded)]))
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if last - first >= width:
            yield np.unique(whole[first : last - width + 1])
        else:  # the whole sequence is one shingle
            few = words[first:last]
            yield mixed((few * FACTORS[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))[: len(few)]


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets([text], width))


def registers(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """One 32-bit register per bucket: 1 + leading zeros, and the mantissa; 0 for an empty bucket.

    Buckets are equal slices of the hash range, so in a sorted set the first hash of a slice is
    its smallest.
    """
    first = np.searchsorted(shingles, _borders(buckets))
    filled = first < np.append(first[1:], len(shingles))
    out = np.zeros(buckets, np.uint64)
    place = shingles[first[filled]] * np.uint64(buckets)  # place within the slice, over 2**64
    zeros = (53 - np.frexp((place >> np.uint64(11)).astype(np.float64))[1]).astype(np.uint64)
    mantissa = (place << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out[filled] = ((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa
    return out


def replicated(shingles: np.ndarray) -> Iterator[np.ndarray]:
    """The set under each of ``REPLICAS`` permutations, each in its own equal slice of the hash range, sorted: some
    permutations at a time, so that long texts need little memory."""
    bits = REPLICAS.bit_length() - 1
    each = max(1, min(REPLICAS, (1 << 20) // max(1, len(shingles))))
    for first in range(0, REPLICAS, each):
        number = np.arange(first, min(first + each, REPLICAS), dtype=np.uint64)[:, None]
        values = (shingles[None, :] ^ mixed(number + np.uint64(1))) * FACTORS[1]
        values = (values ^ (values >> np.uint64(29))) * FACTORS[2]
        values = (values ^ (values >> np.uint64(32))) >> np.uint64(bits)
        values |= number << np.uint64(64 - bits)
        values.sort(axis=1)
        yield values.ravel()


def sketch_of(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """The registers of a set: those of its replicas."""
    out = np.zeros(buckets, np.uint64)
    for values in replicated(shingles):
        out = np.maximum(out, registers(values, buckets))  # each fills buckets of its own
    return out


@cache
def _borders(buckets: int) -> np.ndarray:
    return np.array([-(-(i << 64) // buckets) for i in range(buckets)], dtype=np.uint64)


def folded(register: np.ndarray) -> np.ndarray:
    """Registers as one byte each, 0 for an empty one: what pairs are estimated from."""
    return np.where(register > 0, 1 + mixed(register) % np.uint64(255), 0).astype(np.uint8)


def band_keys(register: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every sketch (a row of registers) a 64-bit key for each band, and whether the band is not empty."""
    bands = register.reshape(len(register), -1, rows)
    total = np.broadcast_to(mixed(np.arange(1, bands.shape[1] + 1, dtype=np.uint64)), bands.shape[:2])
    for j in range(rows):
        total = mixed(total + bands[:, :, j] * FACTORS[j % WIDTH])
    return total, bands.any(axis=2)


def _listed(values: np.ndarray, chosen: np.ndarray) -> pa.ListArray:
    """The chosen values of each row as a list of 64-bit numbers."""
    offsets = np.concatenate(([0], np.cumsum(chosen.sum(axis=1)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[chosen].view(np.int64)))


def _sketches(buckets: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            sizes, digests, register = [], [], np.zeros((part.num_rows, buckets), np.uint64)
            for i, shingles in enumerate(shingle_sets(part.column(2).to_pylist())):
                register[i] = sketch_of(shingles, buckets)
                sizes.append(len(shingles))
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
            sketches = folded(register).view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    _listed(sketches, np.ones(sketches.shape, bool)),
                    _listed(*band_keys(register, rows)),
                ],
                names=["doc_id", "mark", "n_shingles", "digest", "sketch", "keys"],
            )


def _empty_bytes(words: Column) -> Column:
    """How many bytes of an array of 64-bit words are zero."""

    def count(total: Column, v: Column) -> Column:
        for k in (4, 2, 1):
            v = v.bitwiseOR(F.shiftrightunsigned(v, k))
        return total + 8 - F.bit_count(v.bitwiseAND(F.lit(0x0101010101010101)))

    return F.aggregate(words, F.lit(0), count)


def estimate(sketch: Column, other: Column) -> tuple[Column, Column]:
    """Collision-corrected Jaccard estimate of two folded sketches, and the registers it rests on."""
    neither = _empty_bytes(F.zip_with(sketch, other, lambda a, b: a.bitwiseOR(b)))
    equal = _empty_bytes(F.zip_with(sketch, other, lambda a, b: a.bitwiseXOR(b))) - neither
    used = F.greatest(8 * F.size(sketch) - neither, F.lit(1))
    return (equal / used - CHANCE) / (1 - CHANCE), used


def alike(percent: int, sketch: Column, other: Column) -> Column:
    """Whether the estimate lies at most ``DEVIATIONS`` standard errors under the threshold."""
    least = percent / 100
    guess, used = estimate(sketch, other)
    return guess >= least - DEVIATIONS * F.sqrt(least * (1 - least) / used) - 1 / used


def _linked(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recent: dict[int, np.ndarray] = {}

    def of(node: int, text: pa.Scalar) -> np.ndarray:
        found = recent.get(node)
        if found is None:
            if len(recent) >= 256:
                recent.clear()
            found = shingle_set(text.as_py())
            if len(found) < 20_000:
                recent[node] = found
        return found

    for batch in batches:
        keep = []
        for a, b, text_a, text_b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
            one, two = of(a, text_a), of(b, text_b)
            both = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(100 * both >= percent * (len(one) + len(two) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, texts = batch.column(0).to_pylist(), batch.column(1)
        for first in range(0, len(nodes), 256):
            sets = [s.view(np.int64) for s in shingle_sets(texts[first : first + 256].to_pylist())]
            counts = [len(s) for s in sets]
            columns = [np.repeat(np.array(nodes[first : first + 256], np.int64), counts), np.repeat(np.array(counts, np.int32), counts), np.concatenate(sets)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "size", "shingle"])


def possible_pairs(shingles: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, list[str]]:
    """Every pair (a, b) of ``nodes`` (node, component, main) in two groups, one at least not ``main``, that can
    reach the threshold by the order of their ``shingles`` (node, size, shingle), rarest first; and the
    scratch tables that it reads."""
    shingles, path = materialise(shingles, "shingles")
    counts, counts_path = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingle-counts")
    shared = shingles.join(counts, "shingle")
    # Shingles of one node alone come first of all, and need not be looked at.
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("n", "shingle")) + F.col("size") - F.count("*").over(own)

    def needed(size: Column, other: Column) -> Column:
        return F.ceil(percent * (size + other) / (100 + percent) - 1e-9)

    size = F.col("size")
    least_other = F.ceil(size * percent / 100 - 1e-9)
    first = shared.withColumn("rank", rank).where(F.col("rank") <= size - needed(size, least_other) + 1)
    first, first_path = materialise(first.select("node", "size", "shingle", "rank").join(nodes, "node"), "rare-shingles")
    other = first.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("node", "size", "rank", "component", "main")))
    both = needed(size, F.col("other_size"))
    apart = (F.col("component") != F.col("other_component")) & (F.col("other_main") | (F.col("node") < F.col("other_node")))
    within = (F.col("rank") <= size - both + 1) & (F.col("other_rank") <= F.col("other_size") - both + 1)
    pairs = first.where("not main").join(other, "shingle").where(apart & within)
    return pairs.select(F.col("node").alias("a"), F.col("other_node").alias("b")), [path, counts_path, first_path]


def near_duplicates(docs: DataFrame, percent: int = 75, bands: int = 64, rows: int = 5, marks: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and with ``marks`` the
    hash of the text, ``mark``, and the number of the row's group, ``group`` (null for an empty set).

    ``component_id`` is the smallest doc_id that links reach; ``kept`` says that it is the row's own.
    ``bands * rows`` must divide by 8.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    sketches, sketches_path = materialise(
        docs.mapInArrow(
            partial(_sketches, bands * rows, rows),
            "doc_id bigint, mark bigint, n_shingles bigint, digest binary, sketch array<bigint>, keys array<bigint>",
        ),
        "sketches",
    )
    # One row stands for its class: where there is one with an id, the one with the smallest.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")).alias("first")
    classes = sketches.where("digest is not null").groupBy("digest").agg(first)
    classes = classes.select("digest", "first.doc_id", "first.mark", F.monotonically_increasing_id().alias("node"))
    classes, classes_path = materialise(classes, "classes")
    chosen = (sketches["digest"] == classes["digest"]) & sketches["doc_id"].eqNullSafe(classes["doc_id"]) & (sketches["mark"] == classes["mark"])
    nodes = sketches.join(classes, chosen).select("node", classes["doc_id"], classes["mark"], "sketch", "keys")
    nodes, nodes_path = materialise(nodes.dropDuplicates(["node"]), "nodes")
    paths = [classes_path, nodes_path]

    def rule_for(candidates: DataFrame) -> linkage.Rule:
        own, own_path = materialise(nodes.join(candidates, "node", "left_semi").select("node", "doc_id", "mark", "sketch"), "candidates")
        wanted = own.select("node", F.col("doc_id").alias("at"), F.col("mark").alias("marked"))
        found = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["at"]) & (docs["mark"] == wanted["marked"]))
        texts, texts_path = materialise(found.select("node", "text").dropDuplicates(["node"]), "texts")
        paths.extend([own_path, texts_path])

        def verify(pairs: DataFrame) -> DataFrame:
            def side(table: DataFrame, what: str, s: str) -> DataFrame:
                return table.select(F.col("node").alias(s), F.col(what).alias(f"{what}_{s}"))

            likely = pairs.join(side(own, "sketch", "a"), "a").join(side(own, "sketch", "b"), "b")
            likely = likely.where(alike(percent, F.col("sketch_a"), F.col("sketch_b"))).select("a", "b")
            both = likely.join(side(texts, "text", "a"), "a").join(side(texts, "text", "b"), "b").select("a", "b", "text_a", "text_b")
            return both.mapInArrow(partial(_linked, percent), "a bigint, b bigint")

        def rest(undecided: DataFrame) -> DataFrame:
            # min() of a boolean: whether a node is in the largest group of each of its keys.
            left, left_path = materialise(undecided.groupBy("node").agg(F.min("component").alias("component"), F.min("main").alias("main")), "left-nodes")
            shingles = texts.join(left, "node", "left_semi").select("node", "text").mapInArrow(_shingles, "node bigint, size int, shingle bigint")
            pairs, more = possible_pairs(shingles, left, percent)
            paths.extend([left_path, *more])
            return pairs

        return linkage.Rule(verify, rest)

    members = linkage.groups(nodes.select("node", F.explode("keys").alias("key")), rule_for)
    joined = classes.join(members, "node", "left").select("digest", "doc_id", F.coalesce("component", "node").alias("group"))
    joined, joined_path = materialise(joined, "grouped")
    smallest, smallest_path = materialise(joined.groupBy("group").agg(F.min("doc_id").alias("component")), "smallest")
    named, _ = materialise(joined.join(smallest, "group").select("digest", "group", "component"), "components")
    result = (
        sketches.select("doc_id", "n_shingles", "mark", "digest")
        .join(named, "digest", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *(["mark", "group"] if marks else []))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    remove(spark, *paths, joined_path, smallest_path)
    return result

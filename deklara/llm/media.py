"""Operator 3: media columns as content-defined chunks.

A text's bytes, with spaces up to a positive multiple of ``UNIT``, are its payload.  Its media file, which is what is
stored, holds the payload as samples of 8 bits, and behind them their number (64 bits, little-endian) and ``SMP8``.  A gear hash
rolls over the file and cuts where its top bits are zero, so equal passages give equal chunks
wherever they stand.  Three tables hold the corpus:

* ``recipes``: one row per document with the ordered digests and lengths of its chunks, and the
  bodies of those chunks that no other place shares, compressed in one piece;
* ``shared``: one row per chunk digest found in two places or more, with its body;
* what tells the two kinds apart is a Bloom filter over the shared digests, of a fixed number of
  bits, the only thing that is broadcast.  A digest that it takes for shared by mistake is stored
  like a shared one: the filter decides where a body lies, never whether it does.  So bodies of
  unique chunks are never shuffled, and a body that many documents hold is stored once.

Reading back joins the shared chunks to the recipes by digest, puts the chunks in order, verifies
each against its digest, and yields the file as it was stored, whose samples are the payload.

Defined results: a null text is an empty one, and an empty payload is one unit of spaces.  Repeated
rows each have their row.  An empty table gives an empty result.  A chunk whose bytes do not match
its digest raises an error, and so does a file whose end does not tell the number of its samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = 192
MARK = b"SMP8"
LEAST, MOST, TOP_BITS = 256, 8192, 10
PROBES = 4
_GEAR = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    body = (text or "").encode()
    return body + b" " * (-len(body) % UNIT if body else UNIT)


def media_file(payload: bytes) -> bytes:
    """The stored form of a payload."""
    return payload + struct.pack("<Q", len(payload)) + MARK


def samples_of(media: bytes) -> bytes:
    """The payload of a media file."""
    payload = media[: -8 - len(MARK)]
    if media != media_file(payload):
        raise ValueError("not a media file of 8-bit samples")
    return payload


def cuts(payload: bytes) -> list[int]:
    """Ends of the chunks: after a byte whose 32-byte window hashes to ``TOP_BITS`` zeros, not
    under ``LEAST`` bytes and at ``MOST`` bytes at the latest."""
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    ends, start, n = [], 0, len(payload)
    for end in (np.flatnonzero(h >> np.uint32(32 - TOP_BITS) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(payload: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, body) of each chunk in order."""
    ends = cuts(payload)
    bodies = [payload[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return [(hashlib.sha256(b).digest(), b) for b in bodies]


def _digest_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(d for text in batch.column(0) for d, _ in chunks(media_file(payload_of(text.as_py()))))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["digest", "n"]
        )


def _probes(digests: list[bytes], bits: int) -> np.ndarray:
    """[digests, PROBES] bit numbers."""
    return np.frombuffer(b"".join(d[: 4 * PROBES] for d in digests), "<u4").reshape(-1, PROBES) % np.uint32(bits)


def _filter_words(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = np.zeros(bits // 64, np.int64)
        at = _probes(batch.column(0).to_pylist(), bits).ravel()
        np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63).astype(np.int64))
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(words[some])], names=["word", "mask"])


def shared_filter(docs: DataFrame, bits: int) -> bytes:
    """A Bloom filter of ``bits`` bits over the digests that occur more than once."""
    shared = (
        docs.select("text").mapInArrow(_digest_counts, "digest binary, n bigint").groupBy("digest").agg(F.sum("n").alias("n"))
    )
    rows = (
        shared.where("n > 1").select("digest").mapInArrow(partial(_filter_words, bits), "word bigint, mask bigint")
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    )
    words = np.zeros(bits // 64, np.int64)
    for r in rows:
        words[r["word"]] = r["mask"]
    return words.tobytes()


def _is_shared(digests: list[bytes], words: np.ndarray) -> np.ndarray:
    at = _probes(digests, 64 * len(words))
    return ((words[at >> 6] >> (at & 63).astype(np.int64)) & 1).all(axis=1)


def _recipes(filter_: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, press = np.frombuffer(filter_.value, np.int64), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        digests, lengths, flags, own, sizes = [], [], [], [], []
        for text in batch.column(1):
            parts = chunks(media_file(payload_of(text.as_py())))
            shared = _is_shared([d for d, _ in parts], words)
            digests.append(b"".join(d for d, _ in parts))
            lengths.append([len(b) for _, b in parts])
            flags.append(shared.tolist())
            own.append(press.compress(b"".join(b for (_, b), s in zip(parts, shared, strict=True) if not s)))
            sizes.append(len((text.as_py() or "").encode()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(lengths, pa.list_(pa.int32())),
                pa.array(flags, pa.list_(pa.bool_())),
                pa.array(own, pa.binary()),
            ],
            names=["doc_id", "n_bytes", "digests", "lengths", "shared", "own"],
        )


def _shared_bodies(filter_: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, press = np.frombuffer(filter_.value, np.int64), zstandard.ZstdCompressor(level=3)
    for batch in batches:
        found: dict[bytes, bytes] = {}
        for text in batch.column(0):
            parts = chunks(media_file(payload_of(text.as_py())))
            for (d, b), s in zip(parts, _is_shared([d for d, _ in parts], words), strict=True):
                if s and d not in found:
                    found[d] = press.compress(b)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["digest", "body"]
        )


RECIPES = "doc_id bigint, n_bytes bigint, digests binary, lengths array<int>, shared array<boolean>, own binary"


def store(docs: DataFrame, root: str, filter_bits: int = 1 << 24) -> None:
    """Write the recipes and the shared chunks of ``docs`` (doc_id, text) below ``root``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    filter_ = spark.sparkContext.broadcast(shared_filter(docs, filter_bits))
    docs.mapInArrow(partial(_recipes, filter_), RECIPES).withColumn("row", F.monotonically_increasing_id()).write.parquet(
        f"{root}/recipes"
    )
    (
        docs.select("text").mapInArrow(partial(_shared_bodies, filter_), "digest binary, body binary")
        .groupBy("digest").agg(F.first("body").alias("body"))
        .write.parquet(f"{root}/shared")
    )


def restored(recipes: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes with the bodies of their shared chunks: ``bodies``, in order; null if it has none."""
    n = F.size("lengths")
    some = recipes.where(F.exists("shared", lambda s: s))
    places = some.select("row", "digests", F.explode(F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("shared", i))).alias("place"))
    bodies = (
        places.select("row", "place", F.expr("substring(digests, 32 * place + 1, 32)").alias("digest"))
        .join(shared, "digest")
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("bodies"))
        .select("row", F.col("bodies.body").alias("bodies"))
    )
    whole = recipes.where(~F.exists("shared", lambda s: s)).withColumn("bodies", F.lit(None).cast("array<binary>"))
    return some.join(bodies, "row").unionByName(whole)


def assemble(digests: bytes, lengths: list[int], shared: list[bool], own: bytes, bodies: list[bytes]) -> bytes:
    """The file of one recipe; raises if a chunk is not what its digest says."""
    rest, at, others, parts = own, 0, iter(bodies), []
    for i, (length, other) in enumerate(zip(lengths, shared, strict=True)):
        if other:
            body = next(others)
        else:
            body, at = rest[at : at + length], at + length
        if len(body) != length or hashlib.sha256(body).digest() != digests[32 * i : 32 * i + 32]:
            raise ValueError(f"chunk {i} does not match its digest")
        parts.append(body)
    return b"".join(parts)


def feature(payload: bytes, lengths: list[int]) -> str:
    """Chunks, sum of the samples, largest sample, and the samples by their top three bits."""
    samples = np.frombuffer(payload, np.uint8)
    bands = np.bincount(samples >> 5, minlength=8)
    return f"chunks={len(lengths)};sum={int(samples.sum(dtype=np.int64))};max={samples.max()};bands={','.join(map(str, bands))}"


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[int]]]:
    """(media file, lengths of its chunks) of each row of a batch of ``restored``."""
    press = zstandard.ZstdDecompressor()
    for digests, lengths, shared, own, bodies in zip(*(batch.column(c) for c in ("digests", "lengths", "shared", "own", "bodies")), strict=True):
        digests, lengths = digests.as_py(), lengths.as_py()
        others = [press.decompress(b) for b in bodies.as_py() or []]
        yield assemble(digests, lengths, shared.as_py(), press.decompress(own.as_py()), others), lengths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for media, lengths in _unpacked(batch):
            payload = samples_of(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, lengths)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def _tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{root}/recipes"), spark.read.schema("digest binary, body binary").parquet(f"{root}/shared")


def digests(spark: SparkSession, root: str) -> DataFrame:
    """Per stored document: sizes, digests and feature, all from the bytes read back."""
    return restored(*_tables(spark, root)).select("doc_id", "n_bytes", "digests", "lengths", "shared", "own", "bodies").mapInArrow(
        _digests, DIGESTS
    )


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(samples_of(m), m) for m, _ in _unpacked(batch)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_bytes"), pa.array([p for p, _ in found], pa.binary()), pa.array([m for _, m in found], pa.binary())],
            names=["doc_id", "n_bytes", "payload", "media"],
        )


def read(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, n_bytes, payload and media file of every stored document."""
    return restored(*_tables(spark, root)).select("doc_id", "n_bytes", "digests", "lengths", "shared", "own", "bodies").mapInArrow(
        _payloads, "doc_id bigint, n_bytes bigint, payload binary, media binary"
    )

"""Operator 12: sequences that never cross documents, by power-of-two decomposition.

A document of n tokens is cut along the binary digits of n: as many pieces of ``capacity`` tokens as fit (a power of two),
then one piece for each digit 1 of what is left, longest first.  Each piece is a sequence of its own, so no
attention crosses documents, and its length is a power of two, so nothing is padded.  Sequences of
equal length make a bucket, and a bucket is a folder of the table: a batch of equal lengths is read
from one folder.

Tasks cut the documents of their own splits; there is no shuffle.  A sequence's number is its task's number and its
place in the task.  Numbers are fixed when the table is written, and every task that is done again after a loss
replaces its whole output, so they are unique whatever was repeated.

Defined results: a null or empty text is one sequence of the end id alone.  Repeated rows are cut each on
their own.  An empty table gives an empty table.  A null doc_id is kept as null.  A very long text gives as
many full sequences as it needs, handed on in batches of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deklara.llm.common import column
from deklara.llm.subwords import WordIds

SEQUENCES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_NAMES = ["doc_id", "start", "length", "doc_tokens", "ids"]
#: Bytes of ids after which a task hands its rows on.
_BATCH = 8 << 20


def binary_lengths(tokens: int, capacity: int) -> list[int]:
    """``capacity`` as often as it fits, then the powers of two that make up the rest, falling."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, end = WordIds(path, stems=True), np.array([end_id], dtype="<u4").tobytes()
    rows: list[tuple] = []
    held = 0

    def handed_on() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.of(text.as_py()) + end
            total = len(ids) // 4
            start = 0
            for length in binary_lengths(total, capacity):
                rows.append((doc_id, start, length, total, ids[4 * start : 4 * (start + length)]))
                start += length
                held += 4 * length
                if held >= _BATCH:
                    yield handed_on()
                    rows, held = [], 0
    if rows:
        yield handed_on()


def decompose(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per sequence: its document, place and length there, the document's tokens, its ids (little-endian, 32 bits
    each), its number and its bucket, the logarithm of its length."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    texts = docs.select(column(id_column).cast("bigint").alias("doc_id"), column(text_column).alias("text"))
    cut = texts.mapInArrow(partial(_cut, tokenizer_path, capacity, end_id), SEQUENCES)
    return cut.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("bucket", F.log2("length").cast("int"))


def store(sequences: DataFrame, path: str) -> None:
    """Write the sequences, one folder for each bucket."""
    sequences.write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The stored sequences, or those of one length: only that bucket's files are opened."""
    stored = spark.read.schema(f"{SEQUENCES}, sequence_id bigint, bucket int").parquet(path)
    return stored if length is None else stored.where(F.col("bucket") == length.bit_length() - 1)


def placed(sequences: DataFrame) -> DataFrame:
    """The table of pieces: each is a whole sequence, so it starts at its beginning."""
    return sequences.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"), "bucket"
    )

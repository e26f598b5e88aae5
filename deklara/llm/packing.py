"""Operator 7: pack documents into as few sequences as possible.

Method: Martello-Toth dominance reduction, then best-fit decreasing.  Sizes are whole numbers up
to the capacity, so an instance of any number of pieces is a histogram of at most ``capacity``
counts.  Only that histogram reaches the driver.  The plan it returns is a list of *runs*:
"pieces of this size with ranks a..b go, one each, to sequences s..s+b-a at this offset"; tasks
look their own pieces up in it by binary search.

Reduction.  Take the largest size ``w`` and the room ``r = capacity - w`` it leaves.  Let ``k`` be
the largest size present that fits into ``r``.  The set {w, k} dominates every other set with w
if no two or more pieces that fit into ``r`` together exceed ``k`` (``k = r`` included): in any
packing those pieces and k can change places.  Where no three pieces fit into ``r``, let ``b`` be the
largest size that fits beside ``k``: {w, k, b} dominates if two pieces that both exceed ``b`` and fit into
``r`` never exceed ``k`` together, as of any other two the smaller takes b's place and the larger
k's.  Such sets are fixed for good, as often as their sizes last, and the instance shrinks.  What sums
pieces can have is decided on bit sets of reachable sums with unlimited copies, supersets of the true
sums, so what it proves holds.

Ranks.  The task that cuts a document numbers its pieces of each size, and its pieces are written with
these numbers and the task's.  Counts by task and size, added up along the tasks, make them ranks among
all pieces of a size.  So no size, however frequent, is ever gathered or sorted.

Defined results: a null or empty text is one piece of the end id alone.  Repeated rows are packed
each on their own.  An empty table gives an empty result.  A null doc_id is kept as null.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deklara.llm.common import materialise, remove
from deklara.llm.subwords import WordIds

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: the document's ids and the end id, cut only where over ``capacity``.  ``part`` is the
    number of the task and ``own`` the piece's among those of its size there: write them once, and read them."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        partial(_cut, tokenizer_path, capacity, end_id), f"{PIECES}, part bigint, own bigint"
    )


def _cut(path: str, capacity: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, end, width = WordIds(path, stems=True, once=False), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = words.of(text.as_py()) + end
            for piece, at in enumerate(range(0, len(ids), width)):
                own = ids[at : at + width]
                size = len(own) // 4
                rows.append((doc_id, piece, at // 4, size, zlib.crc32(own), part, seen[size]))
                seen[size] += 1
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 5)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "own"],
        )


def _sums_of_several(sizes: list[int], capacity: int) -> int:
    """Bit s is set if s is a sum of two or more of ``sizes``, each as often as one likes."""
    mask, any_sum = (1 << (capacity + 1)) - 1, 0
    for s in sizes:
        any_sum |= 1 << s
    single, reach = any_sum, any_sum
    for s in sizes:
        step = s
        while step <= capacity:
            reach |= (reach << step) & mask
            step *= 2
    several = 0
    for s in sizes:
        several |= (reach << s) & mask
    del single
    return several


def _largest(bits: int, limit: int) -> int:
    """The largest set bit at or under ``limit``; 0 if none."""
    return max(0, (bits & ((1 << (limit + 1)) - 1)).bit_length() - 1) if limit > 0 else 0


def _third(left: dict[int, int], w: int, k: int, room: int) -> int:
    """The size that with ``w`` and ``k`` dominates all sets with ``w``, of which no other piece leaves more than
    ``room``; 0 if none is proved to."""
    if 3 * min(left) <= room:
        return 0
    used = Counter((w, k))
    b = max((s for s, n in left.items() if s <= room - k and n > used[s]), default=0)
    over = [s for s in left if b < s <= room]
    present, pairs = sum(1 << s for s in over), 0
    for s in over:
        pairs |= present << s
    return b if _largest(pairs, room) <= k else 0


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed for good, each with how often, and what remains of ``counts``."""
    left, fixed, changed = {s: n for s, n in counts.items() if n > 0}, [], True
    while changed and left:
        changed = False
        several = _sums_of_several(sorted(left), capacity)
        present = sum(1 << s for s in left)
        for w in sorted(left, reverse=True):
            while left.get(w):
                others = present if left[w] > 1 else present & ~(1 << w)
                k = _largest(others, capacity - w)
                content = (w, k) if k else (w,)
                if k and _largest(several, capacity - w) > k:
                    b = _third(left, w, k, capacity - w)
                    if not b:
                        break
                    content = (w, k, b)
                needed = Counter(content)
                times = min(left[s] // n for s, n in needed.items())
                fixed.append((content, times))
                for s, n in needed.items():
                    left[s] -= times * n
                    if not left[s]:
                        del left[s]
                        present &= ~(1 << s)
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over whole groups of equal bins: bin contents, and how many such bins."""
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms = 0
    closed: list[tuple[tuple[int, ...], int]] = []

    def put(content: tuple[int, ...], room: int, number: int) -> None:
        nonlocal rooms
        if room:
            groups[room].append((content, number))
            rooms |= 1 << room
        else:
            closed.append((content, number))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            fitting = rooms >> w
            if not fitting:
                per = capacity // w
                if n // per:
                    put((w,) * per, capacity - per * w, n // per)
                if n % per:
                    put((w,) * (n % per), capacity - (n % per) * w, 1)
                break
            room = w + (fitting & -fitting).bit_length() - 1
            content, number = groups[room].pop()
            if not groups[room]:
                rooms &= ~(1 << room)
            times = min(n, number)
            if number > times:
                put(content, room, number - times)
            put((*content, w), room - w, times)
            n -= times
    return closed + [g for own in groups.values() for g in own]


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Size -> runs (first rank, first sequence, offset), ordered by first rank."""
    fixed, rest = dominance_reduction(counts, capacity)
    runs, used, sequence = defaultdict(list), defaultdict(int), 0
    for content, number in fixed + best_fit(rest, capacity):
        offset = 0
        for size in content:
            runs[size].append((used[size], sequence, offset))
            used[size] += number
            offset += size
        sequence += number
    return {s: np.array(r, dtype=np.int64) for s, r in runs.items()}


def _place(runs: dict[int, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        sequence, offset = np.empty_like(size), np.empty_like(size)
        for s in np.unique(size):
            at, own = size == s, runs[int(s)]
            run = own[np.searchsorted(own[:, 0], rank[at], side="right") - 1]
            sequence[at], offset[at] = run[:, 1] + rank[at] - run[:, 0], run[:, 2]
        kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the place each one gets.

    What goes to the driver are counts by size, at most ``capacity`` numbers for any input.  Counts by task and
    size are joined; Spark broadcasts them if their table is small.
    """
    spark = docs.sparkSession
    pieces, _ = materialise(cut_documents(docs, tokenizer_path, capacity), "pieces")
    counts, path = materialise(pieces.groupBy("part", "length").count(), "piece-counts")
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts, _ = materialise(counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")), "first-ranks")
    remove(spark, path)
    ranked = pieces.join(firsts, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank")
    )
    return ranked.mapInArrow(partial(_place, runs), f"{PIECES}, sequence_id bigint, offset bigint")

"""Operator 13: token ids of one tokenizer aligned with those of another, over a whole corpus.

Both tokenizers are run over the whole text.  An anchor is a byte offset at which tokens of both end (verified on
the running byte lengths) and the next token of both begins with a space.  Anchors split a document into windows, mostly one word
each; a window's alignment depends on its ids alone, so it is made once by a worker and remembered by
the two tuples of ids.  A document's groups and links are its windows' in order.

A link is a pair of token occurrences whose byte ranges end together, so every group has one: the last
tokens of its two sides.  How often a pair is linked in the corpus is counted from blocks: a task sums up
the links of some two million distinct (document, pair) entries and hands on one row for each pair of the block,
however often the pair occurs.  So the most frequent pair has one row for each block, not for each document,
in the shuffles, and documents refer to pairs by their place in their block's list.  A block with its list and its
documents is what one call of the last step sees; its size is the same for any corpus.

Defined results: null and empty texts, and texts whose tokens' bytes are not the text's (a text with the
piece model's own space mark), have zeros and an empty digest.  Strings of special tokens are text.  Repeated rows each have
their row and each count.  doc_id may be null.  An empty table gives an empty result.  Ties: every first
tokenizer's id that shares the highest count of a second's id is best.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deklara.llm.common import column, materialise
from deklara.llm.hashing import BASE, mixed, spans_hashed
from deklara.llm.pieces import MARK

#: How byte-level vocabularies split text before their merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no white space stands beside other white space; without the look ahead it is matched in one pass.
_PLAIN_SPLIT = _SPLIT.replace(r"\s+(?!\S)|", "")
_RUNS = re.compile(r"\s\s")
#: A special token, of which a tokenizer must have one to give its ids as an array; it is never allowed, so it is text like other text.
_UNUSED = "\0\0unused\0\0"
#: Texts beyond this many characters go to the library of the vocabulary file, whose matching never gives up.
_LONG = 200_000
#: Characters whose windows are looked at together.
_PART = 400_000
_SIDE = 32  # bits of a pair's second id


def _shown_bytes() -> dict[str, int]:
    """Character -> byte in byte-level vocabularies: bytes without a Latin-1 form of their own are shown as U+0100 and on."""
    hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
    return {chr(b): b for b in range(256) if b not in hidden} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligned(NamedTuple):
    """A document's alignment: numbers of tokens and groups, links as packed pairs, groups as text."""

    n_a: int
    n_b: int
    n_groups: int
    links: bytes
    groups: bytes


_NOTHING = Aligned(0, 0, 0, b"", b"")


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


#: A window's alignment: its bytes (None if the sides differ), links as packed pairs, groups as text, their number.  A plain
#: tuple of these is nothing that the garbage collector goes through again and again.
Span = tuple[bytes | None, bytes, bytes, int]


class Aligner:
    """Two tokenizers and the windows met so far; both what is remembered of windows and their length are bounded."""

    def __init__(self, byte_path: str, piece_path: str, max_windows: int = 300_000, max_window: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(byte_path)
        self._whole.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, byte_of = model["vocab"], _shown_bytes()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
            raise ValueError("the merges are not in the order of their ids")
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        special = {_UNUSED: max(ranks.values()) + 1}
        self._fast, self._plain = (tiktoken.Encoding("byte-level", pat_str=p, mergeable_ranks=ranks, special_tokens=special) for p in (_SPLIT, _PLAIN_SPLIT))
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            a[i] = t
        b = [self._piece_bytes(i) for i in range(self._pieces.get_piece_size())]
        self._bytes = tuple(_objects(side) for side in (a, b))
        self._lengths = tuple(np.array([len(t) for t in side], np.int64) for side in (a, b))
        self._spaced = tuple(np.array([t[:1] == b" " for t in side]) for side in (a, b))
        self._texts = tuple(tuple(_objects([b"%d%s" % (i, mark) for i in range(len(side))]) for mark in marks) for side, marks in ((a, (b",", b"|")), (b, (b",", b";"))))
        self._text_sizes = tuple(np.array([len(t) for t in texts[0]], np.int64) for texts in self._texts)
        self._marks = tuple(mixed(np.arange(1, len(side) + 1, dtype=np.uint64)) for side in (a, b))
        self._windows: dict[tuple[bytes, bytes], Span] = {}
        self._older: dict[tuple[bytes, bytes], Span] = {}
        self._max_windows, self._max_bytes = max_windows, 4 * max_window

    def _piece_bytes(self, i: int) -> bytes:
        piece = self._pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._pieces.is_byte(i) else piece.replace(MARK, " ").encode()

    def first_ids(self, text: str) -> np.ndarray:
        text = " " + text
        if len(text) > _LONG:
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return (self._fast if _RUNS.search(text) else self._plain).encode_to_numpy(text, disallowed_special=())

    def second_ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self._pieces.encode(texts, num_threads=1)]

    def _align(self, keys: list[tuple[bytes, bytes]]) -> list[Span]:
        """The alignments of windows.  Their ids are put one after another: the two sides of a window have equally many bytes, so
        ends that both sides share in the whole are those that they share in their windows."""
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.uint32) for side in (0, 1))
        ends, others = np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b])
        second = np.searchsorted(others, ends)
        shared = others[second] == ends
        last, other = np.flatnonzero(shared), second[shared]  # the last tokens of each group
        links = (a[last].astype(np.int64) << _SIDE) | b[other]
        # Ids as text in the order of the groups: the first side's, a bar, the second side's, a semicolon.
        text = np.empty(len(a) + len(b), object)
        size = np.empty(len(text), np.int64)
        before = np.concatenate(([0], other[:-1] + 1))[np.searchsorted(last, np.arange(len(a)))]
        behind = (last + 1)[np.searchsorted(other, np.arange(len(b)))]
        for ids, ends_of, place, (inner, final), sizes in ((a, last, np.arange(len(a)) + before, self._texts[0], self._text_sizes[0]), (b, other, np.arange(len(b)) + behind, self._texts[1], self._text_sizes[1])):
            own = inner[ids]
            own[ends_of] = final[ids[ends_of]]
            text[place], size[place] = own, sizes[ids]
        told, stops = b"".join(text.tolist()), np.cumsum(size)
        tokens = [np.cumsum([len(k[side]) // 4 for k in keys]) for side in (0, 1)]
        groups = np.searchsorted(last, tokens[0] - 1) + 1
        surfaces = [b"".join(x.tolist()) for x in (self._bytes[0][a], self._bytes[1][b])]
        bounds = zip(ends[tokens[0] - 1].tolist(), stops[tokens[0] + tokens[1] - 1].tolist(), groups.tolist(), strict=True)
        packed, same, spans = links.tobytes(), surfaces[0] == surfaces[1], []
        at, shown, n = 0, 0, 0
        for end, stop, upto in bounds:
            surface = surfaces[0][at:end]
            fits = same or surface == surfaces[1][at:end]
            spans.append((surface if fits else None, packed[8 * n : 8 * upto], told[shown : stop - 1], upto - n))
            at, shown, n = end, stop, upto
        return spans

    def _meet(self, keys: list[tuple[bytes, bytes]]) -> list[Span]:
        """Windows that are not among the latest: they are remembered with them.  When these are many they become the
        older ones, and what were the older ones are forgotten, so windows that come again and again stay."""
        found = list(map(self._older.get, keys))
        fresh = [k for k, w in zip(keys, found, strict=True) if w is None]
        if fresh:
            made = iter(self._align(fresh))
            found = [next(made) if w is None else w for w in found]
        if len(self._windows) + len(keys) > self._max_windows:
            self._older, self._windows = self._windows, {}
        if len(keys) <= self._max_windows:
            self._windows.update(zip(keys, found, strict=True))
            for key in [k for k in keys if len(k[0]) > self._max_bytes or len(k[1]) > self._max_bytes]:
                del self._windows[key]
        return found

    def documents(self, texts: list[str | None]) -> Iterator[Aligned]:
        """The alignments of texts; zeros and nothing as defined."""
        first, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= _PART or i + 1 == len(texts):
                yield from self._part(texts[first : i + 1])
                first, size = i + 1, 0

    def _part(self, texts: list[str | None]) -> Iterator[Aligned]:
        wholes = [b" " + t.encode() if t else b"" for t in texts]
        second = self.second_ids([t or "" for t in texts])
        sides = [(self.first_ids(t), b) if t else (b, b) for t, b in zip(texts, second, strict=True)]
        sized = [i for i, ((a, b), w) in enumerate(zip(sides, wholes, strict=True)) if w and all(int(x[ids].sum()) == len(w) for x, ids in zip(self._lengths, (a, b), strict=True))]
        rows: dict[int, Aligned] = {}
        if sized:
            spans, of, bounds = self._windowed([sides[i] for i in sized])
            surfaces, links, groups = (_objects([s[k] for s in spans]) for k in range(3))
            fits, numbers = np.array([s[0] is not None for s in spans]), np.array([s[3] for s in spans])
            for i, first, last in zip(sized, bounds[:-1], bounds[1:], strict=True):
                own = of[first:last]
                if fits[own].all() and b"".join(surfaces[own].tolist()) == wholes[i]:
                    rows[i] = Aligned(len(sides[i][0]), len(sides[i][1]), int(numbers[own].sum()), b"".join(links[own].tolist()), b";".join(groups[own].tolist()))
        for i in range(len(texts)):
            yield rows.get(i, _NOTHING)

    def _windowed(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[Span], np.ndarray, list[int]]:
        """The different windows of documents whose two sides have equally many bytes; of each window in order which of them it is;
        and the number of windows before each document, and in all."""
        a, b = (np.concatenate([s[k] for s in sides]) for k in (0, 1))
        ends, others = np.cumsum(self._lengths[0][a]), np.cumsum(self._lengths[1][b])
        begins = [np.cumsum([0, *(len(s[k]) for s in sides)]) for k in (0, 1)]
        first, second = np.flatnonzero(self._spaced[0][a[1:]]), np.flatnonzero(self._spaced[1][b[1:]])
        at = np.minimum(np.searchsorted(others[second], ends[first]), max(0, len(second) - 1))
        hit = others[second][at] == ends[first] if len(second) else np.zeros(len(first), bool)
        starts, other_starts = (_places(len(x), cuts + 1, bounds) for x, cuts, bounds in ((a, first[hit], begins[0]), (b, second[at[hit]], begins[1])))
        one, two = (starts[:-1], starts[1:]), (other_starts[:-1], other_starts[1:])
        # Windows of one hash are taken for one another only if their ids are the same.
        marks = mixed(spans_hashed(self._marks[0][a], *one) * np.uint64(BASE) + spans_hashed(self._marks[1][b], *two))
        _, like, of = np.unique(marks, return_index=True, return_inverse=True)
        same = _alike(a, *one, like[of]) & _alike(b, *two, like[of])
        if not same.all():
            odd = np.flatnonzero(~same)
            of[odd] = len(like) + np.arange(len(odd))
            like = np.concatenate((like, odd))
        packed, other = a.tobytes(), b.tobytes()
        keys = [(packed[4 * i : 4 * m], other[4 * j : 4 * n]) for i, m, j, n in zip(*(x[like].tolist() for x in (*one, *two)), strict=True)]
        spans = list(map(self._windows.get, keys))
        lost = [k for k, s in zip(keys, spans, strict=True) if s is None]
        if lost:
            met = iter(self._meet(lost))
            spans = [next(met) if s is None else s for s in spans]
        return spans, of, np.searchsorted(starts, begins[0]).tolist()


def _places(size: int, *places: np.ndarray) -> np.ndarray:
    """The places named, each once, in order."""
    there = np.zeros(size + 1, bool)
    for p in places:
        there[p] = True
    return np.flatnonzero(there)


def _alike(ids: np.ndarray, first: np.ndarray, last: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each span of ids is the same as the one that ``like`` names."""
    sizes = last - first
    same = sizes == sizes[like]
    sizes = np.where(same, sizes, 0)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    equal = ids[np.repeat(first, sizes) + at] == ids[np.repeat(first[like], sizes) + at]
    odd = np.repeat(np.arange(len(first)), sizes)[~equal]
    same[odd] = False
    return same


@cache
def aligner_of(byte_path: str, piece_path: str) -> Aligner:
    """The aligner of a worker, which serves all its tasks and remembers their windows."""
    return Aligner(byte_path, piece_path)


def _groups(byte_path: str, piece_path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = aligner_of(byte_path, piece_path)
    for batch in batches:
        texts = [found.groups.decode() for found in aligner.documents(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "groups"])


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(column(id_column).cast("bigint").alias("doc_id"), column(text_column).alias("text"))


def groups(docs: DataFrame, byte_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the aligned groups of its tokens, as ``a1,a2|b1;a3|b2,b3``."""
    return _texts(docs, id_column, text_column).mapInArrow(partial(_groups, byte_path, piece_path), "doc_id bigint, groups string")


#: A row is a document (``places`` in its block's list of pairs, and how often each) or, with ``pairs``, a block's list.
BLOCKS = (
    "block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "places binary, times binary, pairs array<bigint>, linked array<bigint>"
)
_KINDS = (*[pa.int64()] * 6, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _block(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """A block's documents and its list of pairs."""
    codes = np.concatenate([h[-2] for h in held])
    times = np.concatenate([h[-1] for h in held])
    pairs, places = np.unique(codes, return_inverse=True)
    linked = np.bincount(places, weights=times, minlength=len(pairs)).astype(np.int64)
    yield _rows([(number, *[None] * 8, pairs, linked)])
    bounds = np.cumsum([0, *(len(h[-1]) for h in held)])
    places = places.astype("<u4")
    for first in range(0, len(held), 4096):
        part = range(first, min(first + 4096, len(held)))
        yield _rows([(number, *held[k][:-2], places[bounds[k] : bounds[k + 1]].tobytes(), held[k][-1].astype("<u4").tobytes(), None, None) for k in part])


def _blocks(byte_path: str, piece_path: str, entries: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    aligner = aligner_of(byte_path, piece_path)
    number = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    size = 0
    for batch in batches:
        found = aligner.documents(batch.column(1).to_pylist())
        for doc_id, own in zip(batch.column(0).to_pylist(), found, strict=True):
            links = np.frombuffer(own.links, np.int64)
            digest = hashlib.sha256(own.groups).hexdigest() if own.n_a else ""
            codes, times = np.unique(links, return_counts=True)
            held.append((doc_id, own.n_a, own.n_b, own.n_groups, len(links), digest, codes, times))
            size += len(codes) + 1
            if size >= entries:
                yield from _block(number, held)
                held, size, number = [], 0, number + 1
    if held:
        yield from _block(number, held)


def blocks(docs: DataFrame, byte_path: str, piece_path: str, entries: int = 1 << 21, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents aligned, in blocks of about ``entries`` distinct pairs of all their documents."""
    return _texts(docs, id_column, text_column).mapInArrow(partial(_blocks, byte_path, piece_path, entries), BLOCKS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b and how many links of the corpus hold the two; ``best`` where no other a has more links with b.  The rows
    of one b are at most as many as the first tokenizer has ids."""
    counts = _lists(aligned).groupBy("pair").agg(F.sum("linked").alias("links"))
    b = F.col("pair").bitwiseAND(F.lit((1 << _SIDE) - 1))
    sides = counts.select("pair", F.shiftright("pair", _SIDE).alias("a"), b.alias("b"), "links")
    return sides.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def _lists(aligned: DataFrame) -> DataFrame:
    lists = aligned.where("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "linked")).alias("place", "p"))
    return lists.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.linked").alias("linked"))


SCORED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    size = pairs.num_rows
    links, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    place = pairs.column("place").to_numpy()
    links[place], best[place] = pairs.column("links").to_numpy(), pairs.column("best").to_numpy()
    n_best, count_sum = [], []
    for places, times in zip(docs.column("places"), docs.column("times"), strict=True):
        p, t = np.frombuffer(places.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<u4").astype(np.int64)
        n_best.append(int((t * best[p]).sum()))
        count_sum.append(int((t * links[p]).sum()))
    out = {c: docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
    return pa.table(out | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": docs.column("groups_sha256")})


def align(docs: DataFrame, byte_path: str, piece_path: str, entries: int = 1 << 21, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document its tokens, groups and links, and what the corpus says of the links."""
    aligned, _ = materialise(blocks(docs, byte_path, piece_path, entries, id_column, text_column), "aligned")
    known = pair_counts(aligned).select("pair", "links", F.col("best").cast("int").alias("best"))
    scored = _lists(aligned).join(known, "pair").select(F.col("block").alias("of_block"), "place", "links", "best")
    own = aligned.where("pairs is null").drop("pairs", "linked")
    return own.groupBy("block").cogroup(scored.groupBy("of_block")).applyInArrow(_score, SCORED)

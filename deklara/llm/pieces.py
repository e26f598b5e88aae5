"""Operator 10: SentencePiece (merge type) encoding and decoding.

Encoding is exact and does not replay merges over a text.  A sequence of pieces is what merging
gives if and only if every two neighbours are compatible, that is, if merging their joined text
gives just these two.  So a word is read left to right: an Aho-Corasick automaton names the pieces
that start at each position, the longest is tried first, compatibility of neighbours is checked by
re-merging the two (and remembered), and a position from which no continuation works is marked in
a bit field of failed positions and never entered again.

Words can be encoded apart: of the pieces only runs of the space mark hold that mark after their
first character, and these have the lowest score, so they form last.  Characters that no piece
holds become byte pieces and separate what stands on both sides.  ``Model`` checks these
properties when it reads a file and refuses others.

Defined results: null and empty texts have the end id alone and decode to the empty text; repeated
rows each have their row; an empty table gives an empty result; doc_id may be null.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Letters, and signs behind them.
_SIGNS = re.compile(r"(▁?[^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")


class _Words(dict):
    """Word -> what ``encode`` makes of it, filled on demand; bounded like ``subwords.WordIds``."""

    def __init__(self, encode: Callable[[str], object], max_words: int, max_word: int):
        super().__init__()
        self._encode, self._max_words, self._max_word = encode, max_words, max_word

    def __missing__(self, word: str) -> object:
        ids = self._encode(word)
        if len(word) <= self._max_word:
            if len(self) >= self._max_words:
                self.clear()
            self[word] = ids
        return ids


class Model:
    """A model file's vocabulary, with encoding by backtracking and decoding.

    ``max_words`` and ``max_pairs`` bound what is remembered.
    """

    def __init__(self, path: str, max_words: int = 600_000, max_pairs: int = 500_000, max_word: int = 48):
        import ahocorasick
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(file.get_piece_size())
        self.end_id = file.eos_id()
        self.byte_ids = [file.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        plain = [i for i in ids if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
        text = {i: file.id_to_piece(i) for i in plain}
        runs = {i: t for i, t in text.items() if len(t) > 1 and not t.strip(MARK)}
        self.run_ids = {len(t): i for i, t in runs.items()}
        self.ids = {t: i for i, t in text.items() if i not in runs}
        self.score = {t: file.get_score(i) for t, i in self.ids.items()}
        longer = [t for t in self.ids if len(t) > 1]
        if not all(file.is_byte(i) for i in self.byte_ids) or MARK not in self.ids:
            raise ValueError("the model has no byte pieces, or no piece for the space mark")
        if any(MARK in t[1:] for t in longer) or len({self.score[t] for t in longer}) < len(longer):
            raise ValueError("pieces across words, or of equal score: not a model this encoder reads exactly")
        if runs and max(map(file.get_score, runs)) >= min(self.score[t] for t in longer):
            raise ValueError("runs of the space mark must form last")
        self._run_scores = {n: file.get_score(i) for n, i in self.run_ids.items()}
        order = sorted(longer, key=lambda t: -self.score[t])
        self._rank, self._no_rank = {t: i for i, t in enumerate(order)}, len(order)
        self._known_chars = {c for t in self.ids for c in t}
        self._automaton = ahocorasick.Automaton()
        for t in self.ids:
            self._automaton.add_word(t, len(t))
        self._automaton.make_automaton()
        self._surface = {i: t.replace(MARK, " ").encode() for i, t in text.items()}
        self._controls = {i for i in ids if file.is_control(i)}
        self._marked = {i for i, t in text.items() if t[0] == MARK}
        for i in ids:
            if file.is_control(i):
                self._surface[i] = b""
            elif file.is_unknown(i):
                self._surface[i] = " ⁇ ".encode()
        self._surface |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self._piece_of = {i: t for t, i in self.ids.items()}
        self._words = _Words(self._word, max_words, max_word)
        self._shown = _Words(self.shown, max_words, max_word)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        self._alone: dict[str, bool] = {}
        self._max_pairs = max_pairs
        # Where words are cut: before the mark, and around characters that no piece holds.
        cuts = "".join(re.escape(c) for c in "\t\n\r\x0b\x0c" if c not in self._known_chars)
        self._cut = re.compile(f"{MARK}+[^{MARK}{cuts}]*|[^{MARK}{cuts}]+" + (f"|[{cuts}]+" if cuts else ""))

    def _merge(self, text: str, stop: int = 1) -> list[str]:
        """Pieces of a short text by its merges, best score first, the leftmost of equals first, down to
        ``stop`` pieces."""
        parts, score = list(text), self.score
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge made this one; None for a single character."""
        if len(piece) == 1:
            return None
        found = self._halves.get(piece)
        if found is None:
            parts = self._merge(piece, 2)
            found = self._halves[piece] = (parts[0], parts[1])
        return found

    def _compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: undo the later merge of the two sides again and
        again, and see whether what then meets at the border would have merged before it."""
        key = (a, b)
        found = self._pairs.get(key)
        if found is not None:
            return found
        rank, limit, found = self._rank, self._no_rank, True
        while True:
            joined = rank.get(a + b)
            if joined is not None and joined < limit:
                found = False
                break
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x < 0 and y < 0:
                break
            if x > y:
                limit, a = x, self._split(a)[1]
            else:  # at equal scores the left merge comes first
                limit, b = y + 1, self._split(b)[0]
        if len(self._pairs) >= self._max_pairs:
            self._pairs.clear()
        self._pairs[key] = found
        return found

    def _stands(self, a: str) -> bool:
        """Whether merging gives this piece at all."""
        found = self._alone.get(a)
        if found is None:
            found = self._alone[a] = self._merge(a) == [a]
        return found

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a text of known characters."""
        n, known, pairs = len(text), self.ids, self._pairs
        longest = [0] * (n + 1)
        for end, length in self._automaton.iter(text):
            longest[end - length + 1] = length  # lengths at one start come in rising order
        failed = bytearray(n // 8 + 1)
        tokens: list[str] = []
        last, pos, length = "", 0, longest[0]
        while pos < n:
            while length:
                end = pos + length
                piece = text[pos:end]
                if not failed[end >> 3] >> (end & 7) & 1 and piece in known:
                    if last:
                        fits = pairs.get((last, piece))
                        if fits is None:
                            fits = self._compatible(last, piece)
                    else:
                        fits = self._stands(piece)
                    if fits:
                        tokens.append(piece)
                        last, pos, length = piece, end, longest[end]
                        break
                length -= 1  # the next shorter piece that starts here
            else:
                failed[pos >> 3] |= 1 << (pos & 7)
                if not tokens:
                    raise ValueError(f"no encoding of {text[:40]!r}")
                tokens.pop()
                pos -= len(last)
                length = len(last)  # fails at once: where it ends is marked
                last = tokens[-1] if tokens else ""
        return tokens

    def _run(self, n: int) -> list[int]:
        """Ids of n space marks in a row: best score first, the leftmost of equals first."""
        if n < 2 or not self.run_ids:
            return [self.ids[MARK]] * n
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (s := self._run_scores.get(size[i] + size[j])) is not None:
                heapq.heappush(heap, (-s, i, size[i], size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if size[i] != a or j >= n or size[j] != b:
                continue
            size[i], size[j] = a + b, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.run_ids.get(s, self.ids[MARK]) for s in size if s]

    def _word(self, word: str) -> bytes:
        """Packed ids of what is encoded apart.  Neighbours that are compatible need no more, so a word and the
        signs behind it, which come again and again, are put together from what is known of the two."""
        parts = _SIGNS.match(word)
        if parts:
            stem, signs = self._words[parts[1]], self._words[parts[2]]
            last, first = self._piece_of.get(int.from_bytes(stem[-4:], sys.byteorder)), self._piece_of.get(int.from_bytes(signs[:4], sys.byteorder))
            if last is not None and first is not None:
                fits = self._pairs.get((last, first))
                if fits or fits is None and self._compatible(last, first):
                    return stem + signs
        marks = len(word) - len(word.lstrip(MARK))
        rest = word[marks - 1 :] if marks else word
        ids: list[int] = []
        known, start = self._known_chars, 0
        strange = [] if known.issuperset(rest) else [k for k, c in enumerate(rest) if c not in known]
        for i in [*strange, len(rest)]:
            if i > start:
                ids += map(self.ids.__getitem__, self.backtrack(rest[start:i] if strange else rest))
            if i < len(rest):
                ids += [self.byte_ids[b] for b in rest[i].encode()]
            start = i + 1
        if marks > 1:
            alone = ids[0] == self.ids[MARK]
            ids = self._run(marks - 1 + alone) + ids[alone:]
        return array("I", ids).tobytes()

    def words(self, text: str | None) -> list[str]:
        """What of a text is encoded apart."""
        return self._cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def shown(self, word: str) -> tuple[bytes, bytes | None, bool]:
        """Of a word its ids in decimal, each with a blank behind it; the bytes that they decode to, None if those
        are no UTF-8 by themselves; and whether it begins with a blank that is no part of the text when it
        stands first."""
        ids = memoryview(self._words[word] if _SIGNS.match(word) is None else self._word(word)).cast("I").tolist()
        surface = b"".join(map(self._surface.__getitem__, ids))
        try:
            surface.decode()
        except UnicodeDecodeError:
            surface = None
        return b"".join([b"%d " % i for i in ids]), surface, bool(ids) and ids[0] in self._marked

    def encode(self, text: str | None) -> bytes:
        """Packed little-endian 32-bit ids of a whole text, without the end id."""
        return b"".join(map(self._words.__getitem__, self.words(text)))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 each give U+FFFD; one leading space goes."""
        try:  # a control piece within the text parts the bytes on its sides
            joined = b"".join(map(self._surface.__getitem__, ids))
            text = joined.decode() if self._controls.isdisjoint(ids[:-1]) else self._decode_parts(ids)
        except UnicodeDecodeError:
            text = self._decode_parts(ids)
        first = next((i for i in ids if self._surface[i]), None)
        return text[1:] if first in self._marked else text

    def _decode_parts(self, ids: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in range(1, 5):
                    try:
                        out.append(run[i : i + n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                i += n
            run.clear()

        for i in ids:
            if i in self._byte_of:
                run.append(self._byte_of[i])
            else:
                flush()
                out.append(self._surface[i].decode())
        flush()
        return "".join(out)


@cache
def model_of(path: str) -> Model:
    """The model of a worker, which serves all its tasks and remembers their words."""
    return Model(path)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    end = str(model.end_id).encode()
    for batch in batches:
        counts, digests, texts = [], [], []
        for text in batch.column(1):
            parts = list(map(model._shown.__getitem__, model.words(text.as_py())))
            numbers = b"".join([p[0] for p in parts]) + end
            # Bytes that are no UTF-8, and they alone, have no bytes of their own here.
            whole = None if any(p[1] is None for p in parts) else b"".join([p[1] for p in parts])
            if whole is None:
                whole = model.decode(list(map(int, numbers.split()))).encode()
            elif parts and parts[0][2]:
                whole = whole[1:]
            counts.append(numbers.count(b" ") + 1)
            digests.append(hashlib.sha256(numbers).hexdigest())
            texts.append(hashlib.sha256(whole).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: number of ids with the end id, digest of the ids, digest of the decoded text."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        partial(_digests, model_path), DIGESTS
    )


def _ids(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        ids = [[*memoryview(model.encode(t.as_py())).cast("I").tolist(), model.end_id] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of its text with the end id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        partial(_ids, model_path), "doc_id bigint, ids array<int>"
    )


def _texts(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        texts = [model.decode(i.as_py() or []) for i in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(ids: DataFrame, model_path: str) -> DataFrame:
    """The way back from ``encode``."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_texts, model_path), "doc_id bigint, text string")

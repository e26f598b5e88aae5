"""SimHash blocks of lines, computed for many texts at once.

A line's normal form is its letters and digits in lower case, the digits 1-9 as 0, every other run of
characters as one blank.  Its features are its distinct words.  The SimHash has ``B`` blocks of 32 bits, and
each feature votes in one block only, chosen by its hash.  So a changed feature disturbs its own block and no
other, and the pigeonhole principle holds for features: a change that touches c features (a replaced word: two)
leaves at least B - c blocks as they are, and two neighbours if c is under B / 2.  ``B`` grows with the line,
so that at every length about the same share of changed characters is survived, and about as many words stand
behind a block.

A key is a block with the next one (of forms under 100 characters, which have few words, every choice of two
or three blocks; under 60 characters also the blocks of the runs of two characters), if the two rest on enough
features.  Two lines that agree in a key are candidates.  Lines whose length lies just above a border between
two levels have the keys of both.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

from deklara.llm.hashing import BASE as _BASE
from deklara.llm.hashing import mixed, spans_hashed

_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile("[1-9]")
_U = np.uint64
#: From this length of the form on: blocks, blocks in a key, and distinct features that a key must rest on (one of
#: fewer is shared by lines that have nothing else in common).  Above the last level blocks double with the length.
LEVELS = ((0, 5, 3, 3), (60, 5, 2, 4), (100, 6, 2, 5), (140, 8, 2, 6), (200, 12, 2, 6))
#: Of more blocks only neighbours are put together, each with the next.
ALL = 5
#: Forms of fewer characters also have the blocks of their runs of two characters.
SHORT, RUN_BLOCKS, RUN_LEAST = 60, 4, 5
#: Characters that are read at once.
CHUNK = 1 << 18


def forms(text: str | None) -> list[list[str]]:
    """The words of the normal form of each line of a text."""
    return [_WORD.findall(line) for line in _DIGIT.sub("0", (text or "").lower()).split("\n")]


def count(text: str | None) -> int:
    """Lines with a normal form."""
    return sum(_WORD.search(line) is not None for line in (text or "").split("\n"))


def level_of(size: np.ndarray) -> np.ndarray:
    """The level of forms of so many characters."""
    top = len(LEVELS) - 1
    long = top + np.floor(np.log2(np.maximum(size, LEVELS[top][0]) / LEVELS[top][0])).astype(np.int64)
    return np.where(size >= LEVELS[top][0], long, np.searchsorted([first for first, *_ in LEVELS], size, "right") - 1)


def shape_of(level: int) -> tuple[int, int, int]:
    """Blocks, blocks in a key, and the features that a key must rest on."""
    top = len(LEVELS) - 1
    blocks, chosen, least = LEVELS[min(level, top)][1:]
    return blocks << max(0, level - top), chosen, least


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: a 64-bit value, and whether it belongs to a word."""
    code = np.arange(0x110000, dtype=_U)
    code[ord("1") : ord("9") + 1] = ord("0")
    return mixed(code + _U(1)), np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


@dataclass
class Lines:
    """Lines with a normal form: number among all lines, hash and length of the form, and its words
    (from ``first`` to ``last`` of ``words``)."""

    number: np.ndarray
    node: np.ndarray
    chars: np.ndarray
    first: np.ndarray
    last: np.ndarray
    words: np.ndarray
    values: np.ndarray  # of the characters
    begins: np.ndarray  # of words among the characters
    ends: np.ndarray


def read(texts: list[str]) -> tuple[Lines, np.ndarray]:
    """The lines of texts, and of each text the number of its first line."""
    joined = "\n".join(texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    value, of_word = _characters()
    on = np.zeros(len(codes) + 2, bool)
    np.take(of_word, codes, out=on[1:-1])
    edges = np.flatnonzero(on[1:] != on[:-1])
    begins, ends = edges[::2], edges[1::2]
    values = np.take(value, codes)
    words = spans_hashed(values, begins, ends)
    of = np.searchsorted(np.flatnonzero(codes == 10), begins)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    last = np.append(first[1:], len(of))[: len(first)]
    lengths = np.concatenate(([0], np.cumsum(ends - begins)))
    chars = lengths[last] - lengths[first] + (last - first) - 1
    starts = np.cumsum([0, *(t.count("\n") + 1 for t in texts)])[:-1]
    return Lines(of[first], spans_hashed(words, first, last), chars, first, last, words, values, begins, ends), starts


def _within(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place): the places of all spans one after another."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)


def _runs(lines: Lines, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the runs of two characters of the chosen lines, blanks and both ends included."""
    owner, word = _within(lines.first[chosen], lines.last[chosen])
    at, place = _within(lines.begins[word], lines.ends[word])
    # Each word as a blank and its characters; what follows the last one is a blank again.
    sizes = lines.ends[word] - lines.begins[word] + 1
    text, of = np.zeros(int(sizes.sum()), _U), np.repeat(owner, sizes)
    text[np.arange(len(place)) + at + 1] = lines.values[place]
    after = np.append(text[1:], _U(0))
    after[np.append(of[1:], -1) != of] = 0
    return of, mixed(text * _U(3) + mixed(after))


@cache
def _spread() -> np.ndarray:
    """Of every byte its 8 bits as 8 bytes of one word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(_U).ravel()


def simhash_blocks(block: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, 32-bit SimHash of the distinct features in it, their number), in the order of the numbers
    of blocks, which are under 2**24.  A word that a line repeats has one vote: it would outvote all others."""
    # Block and 40 bits of the feature in one number: one plain sort brings repeated features together.
    both = np.sort((block.astype(_U) << _U(40)) | (features >> _U(24)))
    both = both[np.flatnonzero(np.diff(both, prepend=~both[:1]))]
    block = (both >> _U(40)).astype(np.int64)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    sizes = np.diff(np.append(first, len(block)))
    quarters = both.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :4]
    sums = np.empty((len(first), 4), _U)
    for i in range(4):
        sums[:, i] = np.add.reduceat(_spread()[quarters[:, i]], first) if len(first) else 0
    votes = sums.view(np.uint8).astype(np.int16)
    many = np.flatnonzero(sizes > 255)  # more votes than a byte holds
    votes = votes.astype(np.int64) if len(many) else votes
    for i in many:
        votes[i] = np.unpackbits(quarters[first[i] : first[i] + sizes[i]], axis=1).sum(0, dtype=np.int64)
    # Equal votes are broken by the bit's number, alike for all lines.
    bits = 4 * votes - (2 * sizes[:, None]).astype(votes.dtype) + (np.arange(32) % 2).astype(votes.dtype) > 0
    return block[first], np.packbits(bits, axis=1).view("<u4").ravel(), sizes


def band_keys(lines: Lines, chosen: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) of the chosen lines: the keys of each one's level, and of the level below if a form
    that much shorter lies there.  ``owner`` is a place in ``chosen``."""
    size = lines.chars[chosen]
    own, lower = level_of(size), level_of(np.floor(size * similarity))
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, _U)]
    for level in np.unique(np.concatenate((own, lower))).tolist():
        of = np.flatnonzero((own == level) | (lower == level))
        owner, key = _level_keys(lines, chosen[of], level)
        owners.append(of[owner])
        keys.append(key)
    return np.concatenate(owners), np.concatenate(keys)


def _level_keys(lines: Lines, chosen: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    owner, place = _within(lines.first[chosen], lines.last[chosen])
    owners, keys = _block_keys(len(chosen), owner, lines.words[place], *shape_of(level), level + 1)
    if level > 0:
        return owners, keys
    more, others = _block_keys(len(chosen), *_runs(lines, chosen), RUN_BLOCKS, 1, RUN_LEAST, 0)
    return np.concatenate((owners, more)), np.concatenate((keys, others))


def _block_keys(n: int, owner: np.ndarray, features: np.ndarray, blocks: int, each: int, least: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key) for the choices of ``each`` of an owner's blocks."""
    at, found, sizes = simhash_blocks(owner * blocks + (features % _U(blocks)).astype(np.int64), features)
    mark = mixed(found.astype(_U) + (at % blocks + 1).astype(_U) * _U(_BASE) + (_U(kind) << _U(56)))
    marks, counts = np.zeros(n * blocks, _U), np.zeros(n * blocks, np.int64)
    marks[at], counts[at] = mark, sizes
    marks, counts = marks.reshape(n, blocks), counts.reshape(n, blocks)
    # Of three words two are enough; lines that repeat few words have smaller keys, and long lines that repeat
    # one or two words have keys of one.
    held, fewest = counts.sum(axis=1), 1 if kind > 1 else 2
    needed = np.minimum(least, np.where(held < 2 * least, np.maximum(fewest, held - 1), np.maximum(2, each * held // blocks)))
    if blocks > ALL:
        # All choices of neighbours at once: long lines have thousands of blocks.
        total, all_held = np.arange(1, blocks + 1, dtype=_U) + np.zeros((n, 1), _U), np.zeros((n, blocks), np.int64)
        for i in range(each):
            total = mixed(total + np.roll(marks, -i, axis=1))
            all_held += np.roll(counts, -i, axis=1)
        owner, number = np.nonzero(all_held >= needed[:, None])
        return owner, total[owner, number]
    owners, keys = [], []
    for number, choice in enumerate(itertools.combinations(range(blocks), each)):
        some = np.flatnonzero(counts[:, choice].sum(axis=1) >= needed)
        total = np.full(len(some), number + 1, _U)
        for i in choice:
            total = mixed(total + marks[some, i])
        owners.append(some)
        keys.append(total)
    return np.concatenate(owners), np.concatenate(keys)


def chunks(texts: list[str | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Parts of the texts, cut at line ends, with the text that each belongs to and the number of its first
    line there: as many as make up ``CHUNK`` characters, or one longer line."""
    parts, rows, lines, size = [], [], [], 0
    for row, text in enumerate(texts):
        at, line = 0, 0
        while text:
            end = len(text) if len(text) - at <= CHUNK else text.find("\n", at + CHUNK)
            end = len(text) if end < 0 else end
            part = text[at:end]
            parts.append(part)
            rows.append(row)
            lines.append(line)
            size += len(part)
            if size >= CHUNK:
                yield parts, rows, lines
                parts, rows, lines, size = [], [], [], 0
            if end == len(text):
                break
            line += part.count("\n") + 1
            at = end + 1
    if parts:
        yield parts, rows, lines

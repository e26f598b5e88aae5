"""Token ids of whole texts by a public tokenizer file, with the words of a worker remembered.

The tokenizer's file is a parameter.  Its pre-tokenizer never lets a token cross white space,
so the ids of a text are those of its white-space separated words in order; a word is encoded
when a worker first meets it and its ids are kept as packed little-endian 32-bit numbers, which
makes a text's ids one ``bytes.join``.
"""

from __future__ import annotations

import os
import re
from array import array

#: A word of Latin-1 letters and the punctuation behind it: the tokenizer lower-cases and
#: separates the two, so both parts can be remembered on their own.
_STEM = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")

#: Marks of words met once, a power of two.
MARKS = 1 << 22

#: Byte-level alphabets show the bytes that are no printable Latin-1 character as U+0100 and on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SHOWN = {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}


class WordIds(dict):
    """Word (UTF-8 bytes without white space) -> packed ids, filled on demand.

    Without ``once`` a word is kept from the second time on, as most are never met again: a first time leaves one of
    ``MARKS`` marks.  Bounded: it forgets everything once it holds ``max_words``, and never keeps a word of more
    than ``max_word_bytes``.  ``stems`` says that the tokenizer lower-cases, and splits letters
    from punctuation.
    """

    def __init__(self, path: str, stems: bool, max_words: int = 1_000_000, max_word_bytes: int = 48, once: bool = True):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self._encode, self._merge = tokenizer.encode, tokenizer.model.tokenize
        self._stems, self._max_words, self._max_word_bytes = stems, max_words, max_word_bytes
        self._once, self._met, self._marked = once, bytearray(0 if once else MARKS), 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self._encoded(word)
        if len(word) <= self._max_word_bytes and (self._once or self._again(hash(word) & (MARKS - 1))):
            if len(self) >= self._max_words:
                self.clear()
            self[word] = ids
        return ids

    def _again(self, mark: int) -> bool:
        if self._met[mark]:
            return True
        if self._marked >= MARKS // 4:
            self._met, self._marked = bytearray(MARKS), 0
        self._met[mark] = 1
        self._marked += 1
        return False

    def _encoded(self, word: bytes) -> bytes:
        text = word.decode()
        parts = _STEM.match(text) if self._stems else None
        if parts is None:
            return array("I", self._encode(text, add_special_tokens=False).ids).tobytes()
        if parts[2]:
            return self[parts[1].lower().encode()] + self[parts[2].encode()]
        if not text.islower():
            return self[text.lower().encode()]
        # The model alone, on the bytes as its alphabet shows them.
        shown = text if text.isascii() else word.decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self._merge(shown)]).tobytes()

    def of(self, text: str | None) -> bytes:
        """Packed ids of a whole text; a null or empty text has none."""
        return b"".join(map(self.__getitem__, (text or "").encode().split()))

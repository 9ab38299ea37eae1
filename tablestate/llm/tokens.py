"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once for each worker.

A text is cut only where both tokenizers start a new pre-token anyway: at a space between two characters that are
not white space. Everything else is left to the library. Words of plain letters and ASCII punctuation go to the
library's model directly, which skips its normaliser and pre-tokeniser; other words go through the whole library.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPLIT = re.compile(r"(?<=\S) (?=\S)").split
#: Letters whose case, normal form and class no Unicode version disputes.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: ASCII punctuation without the apostrophe, which both pre-tokenisers treat specially.
_P = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"(?:[{_L}]+|[{_P}]+|\n(?=[{_L}{_P}]))+").fullmatch
_PIECES = re.compile(rf"[{_L}]+|[{_P}]+|\n").findall
_LONGEST = 64


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE = _byte_letters()
#: For str.translate: characters up to U+00FF to the letters of their UTF-8 bytes.
_LETTERS = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(256)}


class _Odd(Exception):
    """A part between two spaces that is no word: empty, or with white space at an end."""


class _Words(dict):
    """Word to its ids as little-endian unsigned 32-bit integers; emptied when it reaches its limit."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= _LONGEST:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids
        return ids


class TextEncoder:
    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = self.tokenizer.normalizer is not None
        self.pieces = _Words(self._piece, limit)
        self.words = _Words(self._word, limit)
        self.starts = _Words(self._start, limit // 10)

    def _whole(self, text: str) -> bytes:
        return _pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece != "\n":
            letters = _BYTE[32] + piece[1:] if piece[0] == " " else piece
        else:
            letters = piece.translate(_LETTERS)
        return _pack([t.id for t in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        """A word that a space precedes."""
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Odd
        if not _PLAIN(word):
            return self._whole(" " + word)
        if self.lower:
            return b"".join([self.pieces[p] for p in _PIECES(word.lower()) if p != "\n"])
        first, *rest = _PIECES(word)
        return b"".join([self.pieces[" " + first], *[self.pieces[p] for p in rest]])

    def _start(self, word: str) -> bytes:
        """A word at the start of a text."""
        if not word or word[-1].isspace():
            raise _Odd
        if not _PLAIN(word):
            return self._whole(word)
        if self.lower:
            return self._word(word)
        return b"".join([self.pieces[p] for p in _PIECES(word)])

    def encode(self, text: str) -> bytes:
        """The text's ids, little-endian unsigned 32-bit integers one after another."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._whole(text)
        first, *rest = text.split(" ")
        try:
            return self.starts[first] + b"".join(map(self.words.__getitem__, rest))
        except _Odd:  # white space beside a space: cut there only where the library would
            first, *rest = _SPLIT(text)
        if not rest:
            return self._whole(first)
        *rest, last = rest
        return self._first(first) + b"".join(map(self.words.__getitem__, rest)) + self._last(last)

    def _first(self, part: str) -> bytes:
        return self._whole(part) if part[0].isspace() else self.starts[part]

    def _last(self, part: str) -> bytes:
        return self._whole(" " + part) if part[-1].isspace() else self.words[part]


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One for each worker and vocabulary file."""
    return TextEncoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

"""Encoding with the tokenizers library, with a bounded cache of segments.

A text is cut at places where no token can cross: before a single space that stands before a visible character, and
around white space that a vocabulary drops. A segment's ids do not depend on its neighbours, so each distinct segment is
encoded once and remembered. Texts for which that is not plain to see are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

#: Segments that one generation of a worker's cache holds. When it is full it becomes the old one, from which segments that
#: come again are taken over.
CACHE = 500_000
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　\x00]")
#: Marks that may end a word segment.
_MARKS = frozenset(".,:;!?")
#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_encoders: dict[tuple[str, bool], Encoder] = {}


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, s: str) -> bytes:
        got = self.old.get(s)
        if got is None:
            got = self.make(s)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[s] = got
        return got


class Encoder:
    """ids_of(texts): ids of each text as little-endian unsigned 32-bit integers.

    drops_space: the vocabulary's pre-tokenizer drops white space, so that segments are the words between blanks and
    line feeds; otherwise segments carry the blank before them.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space, self.known = Tokenizer.from_file(path), drops_space, _Cache(self._encode)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)
        self.marks = {p: self._whole(p) for p in _MARKS}
        self.known[""] = b""

    def _whole(self, s: str) -> bytes:
        return array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes()

    def _word(self, s: str) -> bytes:
        """A run of letters below U+0250, with one blank before it at most: one pre-token, given to the model itself."""
        if self.drops_space:
            s = s.lower()
        s = s.replace(" ", "\u0120") if s.isascii() else s.encode().decode("latin-1").translate(_BYTES)
        return array("I", [t.id for t in self.model.tokenize(s)]).tobytes()

    def _segments(self, text: str) -> list[str]:
        if self.drops_space:
            return text.replace("\n", " ").split(" ")
        if _ODD.search(text) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return [text]
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    @staticmethod
    def _simple(w: str) -> bool:
        """Normalising and lower-casing leave such letters letters."""
        return w.isascii() or max(w) < "\u0250" and "\u0130" not in w

    def _encode(self, s: str) -> bytes:
        """A segment's ids: words, and words with one mark after them, by the model alone, all others by the tokenizer."""
        w = s[1:] if s[:1] == " " and not self.drops_space else s
        if w.isalpha() and self._simple(w):
            return self._word(s)
        if w[-1:] in self.marks and (w := w[:-1]).isalpha() and self._simple(w):
            return self.known[s[:-1]] + self.marks[s[-1]]
        return self._whole(s) if s else b""

    def forget(self) -> None:
        """Empties the cache."""
        self.known.clear()
        self.known.old = {}
        self.known[""] = b""

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, self._segments(t))) if t else b"" for t in texts]


def encoder(path: str, drops_space: bool) -> Encoder:
    """This worker's encoder for a vocabulary."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]

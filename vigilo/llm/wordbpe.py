"""Encoding whole texts with a public word-level BPE file through the tokenizers library, each distinct word once.

The tokenizer drops white space and never forms a token across it, so a text is the concatenation of its pieces
between spaces and line feeds.  A worker keeps the ids of pieces it has met; only new pieces reach the library: plain
words its model alone, since nothing in the file's normalizing and splitting touches them, other pieces all of it.
"""

from __future__ import annotations

import os
from array import array

#: Entries a worker keeps per table before it starts afresh.
KEEP = 350_000
#: ASCII marks that end a word; the tokenizer always cuts between a letter and any of them.
MARKS = ".,;:!?|#$%&*)"


def byte_letters() -> list[str]:
    """The letter that byte-level files use for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class _Table(dict):
    """Calls ``learn`` for a key it lacks."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> bytes:
        if len(self) >= KEEP:
            self.clear()
        value = self[key] = self.learn(key)
        return value


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.letters = byte_letters()
        self.pieces = _Table(self._piece)
        self.words = _Table(self._word)

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A lower-case word of letters below U+0130, which neither compose nor split."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if not word.isalpha() or max(word) >= "İ":
            return self._whole(piece)
        tail = piece[len(word) :]
        ids = self.words[word.lower()]
        return ids + self.pieces[tail] if tail else ids

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as native unsigned 32-bit integers (little-endian on all Spark's platforms in use); null counts as empty."""
        get = self.pieces.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) if t else b"" for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

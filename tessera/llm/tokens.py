"""Token ids of whole texts, by a tokenizer file of the ``tokenizers`` library.

A byte-level tokenizer first cuts a text into pieces, and never joins what stands before a single space or line break to
what follows it. So a text is cut there, and each word with what stands before it is encoded once and remembered. Letters
alone are one piece, which goes to the file's model as it is; marks at the end of a word are pieces of their own; any
other word goes through the library's whole encoding. Texts in which white space follows white space are encoded as they
are, and so is every text if the file has another kind of pre-tokenizer, or a normalizer. When ``REMEMBERED`` words are
held, those that were not asked for since it was half that are forgotten. Texts are taken in slices, so a worker's memory
does not grow with its input; a caller with memory to spare can have more words held. Strings of special tokens in a
text are ordinary text.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

REMEMBERED = 300_000
SLICE = 2_000_000
#: Marks that end words. In a byte-level vocabulary "Ġ" stands for the space.
MARKS = ".,;:!?"


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else one of those
    from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Words(dict):
    """The ids of words, which are found when they are first asked for. A word that starts with a line break stands
    first in its line; all others follow a space."""

    def __init__(self, owner: Encoder, older: dict):
        self.owner, self.older = owner, older

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.older.get(word) or self.owner.word(word)
        return ids


class WideGap(Exception):
    """White space follows white space."""


class Encoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        by_word = (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True))
        self.by_word = by_word == ("ByteLevel", False, True) and not parts.get("normalizer")
        self.line_break, self.model = self.whole("\n"), self.tokenizer.model
        self.letters = byte_letters()
        self.as_letters = str.maketrans({b: c for b, c in enumerate(self.letters) if b < 128})
        self.marks = {c: self.whole(c) for c in MARKS}
        self.known = Words(self, {})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii():
            piece = piece.translate(self.as_letters)
        else:
            piece = "".join([self.letters[b] for b in piece.encode("utf-8", "surrogatepass")])
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a word with what stands before it."""
        if word.isalpha():
            return array("I", [t.id for t in self.model.tokenize("Ġ" + word)]).tobytes() if word.isascii() else self._piece(" " + word)
        first = word[:1] == "\n"
        bare = word[1:] if first else word
        if not bare or bare[0].isspace() or bare[-1].isspace():
            raise WideGap
        if first:
            return self.line_break + (self._piece(bare) if bare.isalpha() else self.whole(bare))
        if word[-1] in MARKS and word[:-1].isalpha():
            return self.known[word[:-1]] + self.marks[word[-1]]
        return self.whole(" " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as unsigned little-endian 32-bit integers."""
        if len(self.known) > self.remembered // 2:
            self.known = Words(self, dict(self.known))
        get, out = self.known.__getitem__, []
        for t in texts:
            if self.by_word:
                words = ("\n" + t).replace("\n", " \n").split(" ")
                try:
                    out.append(b"".join(map(get, words[1:]))[len(self.line_break) :])
                    continue
                except WideGap:
                    pass
            out.append(self.whole(t))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].remembered = remembered
    return _ENCODERS[path]


def highest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


def encoded(batch: pa.RecordBatch, text: str, path: str, end_id: int, remembered: int = REMEMBERED) -> Iterator[tuple[int, bytes]]:
    """(row, ids with the end id) of each row of a batch, in order; a null text has the end id alone."""
    end, column = np.array([end_id], "<u4").tobytes(), batch.column(text)
    first, held, n = 0, [], 0
    for k in range(len(batch)):
        held.append(column[k].as_py() or "")
        n += len(held[-1])
        if n > SLICE or k + 1 == len(batch):
            for i, ids in enumerate(encoder(path, remembered).encode(held), first):
                yield i, ids + end
            first, held, n = k + 1, [], 0

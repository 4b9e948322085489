"""Quotes found in texts once both are normalized, with offsets in the original texts.

A text's normal form (NFKC of each character; white space dropped, but one space kept between characters that need it) is
made with a sparse map back: only places where the two texts drift apart are held, so the map of plain prose is short. All
quotes of a block are one Aho-Corasick automaton, and a text goes through it once however many quotes there are.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import numpy as np

from tessera.functions import text as T

_KEEP = re.compile(f"[{T.KEEP_BETWEEN}]")
#: What is known of each character, by its code: that it was looked at, and these.
KNOWN, WHITE, KEEP, SPACED, CHANGED = 1, 2, 4, 8, 16
_FLAGS = np.zeros(0x110000, np.uint8)
_FORMS: dict[int, str] = {}


def _flags(codes: np.ndarray) -> np.ndarray:
    """For each character: whether it is white space; whether a space between it and another such one is kept; whether it
    becomes white space with a mark in NFKC, which counts as white space; whether it becomes another at all."""
    found = _FLAGS[codes]
    if not found.all():
        for code in np.unique(codes[found == 0]).tolist():
            shown = unicodedata.normalize("NFKC", chr(code))
            white, changed = chr(code) in T.WHITE, shown != chr(code)
            spaced = not white and any(c in T.WHITE for c in shown)
            _FLAGS[code] = KNOWN | WHITE * white | KEEP * bool(_KEEP.fullmatch(shown)) | SPACED * spaced | CHANGED * changed
            if changed:
                _FORMS[code] = shown
        found = _FLAGS[codes]
    return found


@dataclass(frozen=True)
class Normal:
    """A normalized text and where it comes from: from ``places[i]`` on its characters stand ``places[i]`` + ``drift[i]``."""

    text: str
    places: np.ndarray
    drift: np.ndarray

    def origin(self, place: int) -> int:
        """The offset in the original text of a character of the normal form."""
        return place + int(self.drift[np.searchsorted(self.places, place, "right") - 1])


def normal(s: str) -> Normal:
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4")
    flags = _flags(codes)
    solid = np.flatnonzero(flags & WHITE == 0)
    kept, spaced = flags[solid] & KEEP != 0, flags[solid] & SPACED != 0
    gap = np.flatnonzero((np.diff(solid) > 1) & kept[:-1] & kept[1:])
    spaces = solid[gap] + 1  # the first white space between two that need one
    marks, stay = np.zeros(0, np.int64), solid
    if spaced.any():
        marks, stay = solid[1:-1][spaced[1:-1] & kept[:-2] & kept[2:]], solid[~spaced]
    blank = np.zeros(len(codes), bool)
    blank[spaces] = blank[marks] = True
    there = blank.copy()
    there[stay] = True
    at = np.flatnonzero(there)
    is_space = blank[at]
    if not (flags[stay] & CHANGED).any():
        shown = np.where(is_space, np.uint32(32), codes[at])
        text, origin = shown.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), at
    else:
        pieces = [" " if b else _FORMS.get(c) or chr(c) for c, b in zip(codes[at].tolist(), is_space.tolist(), strict=True)]
        text, origin = "".join(pieces), np.repeat(at, [len(p) for p in pieces])
    drift = origin - np.arange(len(origin))
    turns = np.flatnonzero(np.diff(drift, prepend=drift[:1] - 1)) if len(drift) else np.zeros(0, np.int64)
    return Normal(text, turns, drift[turns])


class Quotes:
    """An automaton of quotes (key, text). Quotes without any character once normalized are never found."""

    def __init__(self, quotes: list[tuple[object, str]]):
        import ahocorasick

        keys: dict[str, list] = {}
        for key, quote in quotes:
            shown = T.squeezed(unicodedata.normalize("NFKC", quote))
            if shown:
                keys.setdefault(shown, []).append(key)
        self.automaton = ahocorasick.Automaton()
        for shown, owners in keys.items():
            self.automaton.add_word(shown, (len(shown), owners))
        if keys:
            self.automaton.make_automaton()

    def ranges(self, text: str) -> dict[object, tuple[int, int, int]]:
        """For each quote that occurs: the offsets of its first occurrence in ``text``, the end exclusive, and how often it
        occurs, overlaps included."""
        if not len(self.automaton):
            return {}
        held = normal(text)
        first: dict[int, list] = {}
        for last, (n, owners) in self.automaton.iter(held.text):
            seen = first.get(id(owners))
            if seen:
                seen[2] += 1
            else:
                first[id(owners)] = [last - n + 1, n, 1, owners]
        out = {}
        for start, n, times, owners in first.values():
            span = (held.origin(start), held.origin(start + n - 1) + 1, times)
            out |= dict.fromkeys(owners, span)
        return out

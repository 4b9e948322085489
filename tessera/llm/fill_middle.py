"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order, so that a model learns to fill the gap.

A unit is a run of ASCII letters or any other single code point, so every text is its units in a row. A text's boundaries
are held in a learned rank index: line segments that predict the offset of the boundary of a rank within ``ERROR`` code
points, fitted by narrowing a cone of slopes, and the residual of every boundary in a signed byte. Each cut is predicted
from its rank and then corrected by its residual, so it is exact. The index of a text is built slice by slice and takes
one byte for a boundary, whatever the length of the text.

Defined results: a null or empty text has no unit and is plain; a text that holds a marker is plain, so each marker stands
once in every other output and ``restored`` gives the text back exactly; a null id hashes as the empty text; equal ids are
cut by equal numbers, so repeated rows give repeated rows; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The error of a segment's prediction, which with rounding fits in a signed byte.
ERROR = 100
SLICE = 1_000_000
#: The marks before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")


def boundaries(text: str, before: bool, first: bool) -> tuple[np.ndarray, bool]:
    """Offsets in ``text`` before which a unit starts, and whether it ends with a letter. ``before``: a letter stands before
    it; ``first``: it begins the whole text."""
    codes = np.frombuffer(text.encode("ascii"), "u1") if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = (codes | 32) - codes.dtype.type(97) < 26  # unsigned, so what is below "a" wraps round
    starts = np.empty(len(codes), bool)
    starts[0] = first or not (before and letter[0])
    np.logical_and(letter[1:], letter[:-1], out=starts[1:])
    np.logical_not(starts[1:], out=starts[1:])
    return np.flatnonzero(starts), bool(letter[-1])


def segments(offsets: np.ndarray, error: int = ERROR) -> list[tuple[int, int, float]]:
    """(place of its first boundary, that one's offset, slope) of segments through their first boundary that predict all
    others within ``error``."""
    out, at, width = [], 0, 1024
    while at < len(offsets):
        while True:
            rise = offsets[at + 1 : at + width] - offsets[at]
            run = np.arange(1, len(rise) + 1)
            high = np.minimum.accumulate((rise + error) / run)
            low = np.maximum.accumulate((rise - error) / run)
            apart = low > high
            n = int(apart.argmax()) if apart.any() else len(rise)
            if n < len(rise) or at + width >= len(offsets):
                break
            width *= 2
        out.append((at, int(offsets[at]), float((low[n - 1] + high[n - 1]) / 2) if n else 0.0))
        at, width = at + n + 1, max(1024, 2 * n)
    return out


@dataclass(frozen=True)
class RankIndex:
    """The offset of every boundary of a text by its rank."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def _line(base, slope, run):
        return base + np.rint(slope * run).astype(np.int64)

    @classmethod
    def of(cls, text: str, error: int = ERROR, size: int = SLICE) -> RankIndex:
        if not 0 < error <= ERROR:
            raise ValueError(f"an error of at most {ERROR} fits in a signed byte")
        lines, residuals, rank, letter = [], [], 0, False
        for start in range(0, len(text) + 1, size):
            part = text[start : start + size]
            at, letter = boundaries(part, letter, not start) if part else (np.zeros(0, np.int64), letter)
            if start + size > len(text):
                at = np.append(at, len(part))  # the end of the last unit
            at += start
            found = segments(at, error)
            for (k, base, slope), end in zip(found, [*(s[0] for s in found), len(at)][1:], strict=True):
                lines.append((rank + k, base, slope))
                residuals.append((at[k:end] - cls._line(base, slope, np.arange(end - k))).astype(np.int8))
            rank += len(at)
        first, base, slope = zip(*lines, strict=True)
        return cls(np.array(first), np.array(base), np.array(slope), np.concatenate(residuals))

    def __len__(self) -> int:
        return len(self.residuals)

    def offset(self, rank: int) -> int:
        """The segment's prediction, put right by the stored residual."""
        k = int(np.searchsorted(self.first, rank, "right")) - 1
        return int(self._line(self.base[k], self.slope[k], rank - self.first[k])) + int(self.residuals[rank])


def _numbers(id_column: str, seed: str) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the digest of a row's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _checked(markers: tuple[str, str, str]) -> None:
    """No marker may arise where a piece and a marker meet: it would have to start within the marker."""
    if len(markers) != 3 or len(set(markers)) != 3 or not all(markers):
        raise ValueError("three different markers are needed")
    if any(m[0] in other[1:] for m in markers for other in markers):
        raise ValueError("a marker's first character may not stand elsewhere in a marker")


def fill_in_middle(
    docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain), and output, the text in the order of its form."""
    _checked(markers)
    p, s, m = markers

    def rows(batches):
        for batch in batches:
            h = [batch.column(f"h{k}").to_pylist() for k in (1, 2, 3, 4)]
            out = []
            for text, h1, h2, h3, h4 in zip(batch.column("text"), *h, strict=True):
                text = text.as_py()
                index = RankIndex.of(text)
                n = len(index) - 1
                if not text or any(x in text for x in markers) or h3 % 100 >= 100 - plain_percent:
                    out.append((n, "plain", None, None, text))
                    continue
                a, b = (index.offset(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
                prefix, middle, suffix = text[:a], text[a:b], text[b:]
                if h4 % 100 < spm_percent:
                    out.append((n, "spm", a, b - a, "".join((s, suffix, p, prefix, m, middle))))
                else:
                    out.append((n, "psm", a, b - a, "".join((p, prefix, s, suffix, m, middle))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    source = docs.select("doc_id", text_of("text").alias("text"), *_numbers("doc_id", seed))
    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", markers: tuple[str, str, str] = MARKERS) -> Column:
    """The exact text of an output, from it and its form alone."""
    p, s, m = markers

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(F.col(output), start, -1), end, 1)

    middle = F.substring_index(F.col(output), m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))

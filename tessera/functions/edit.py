"""Edit distance of long texts: bit-parallel columns within a band that slides along the diagonal.

A column of the distance table is held as two whole numbers whose bits say where it rises and where it falls from one row
to the next (Myers; with a sliding band, Hyyrö). A band of k rows to each side of the diagonal gives every distance of at
most k, in one pass over a text with numbers of 2 k + 1 bits. The band starts at the limit that a caller expects and
doubles until the distance lies within it, so results are exact at every distance and near texts cost least.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf


def within(a: str, b: str, k: int) -> int | None:
    """The edit distance of ``a`` and ``b`` if it is at most ``k``, which is at least the difference of their lengths."""
    m, n = len(a), len(b)
    rows, at = dict.fromkeys(b, 0), {}
    for i, c in enumerate(a):
        if c in rows:
            at.setdefault(c, []).append(i)
    for c, places in at.items():
        held = bytearray(places[-1] // 8 + 1)
        for i in places:
            held[i >> 3] |= 1 << (i & 7)
        rows[c] = int.from_bytes(held, "little")
    full, top = (1 << 2 * k + 1) - 1, 1 << 2 * k
    rises, falls = full >> k << k, full >> k + 1  # above the first row distances fall towards it
    distance = min(k, m)
    for j, c in enumerate(b, 1):
        shift = j - k - 1
        equal = (rows[c] >> shift if shift >= 0 else rows[c] << -shift) & full
        same = (((equal & rises) + rises ^ rises) | equal | falls) & full  # nothing is added along the diagonal
        right_rises, right_falls = falls | full & ~(same | rises), same & rises
        if j + k <= m:
            distance += not same & top
            if distance > 2 * k + n - m:
                return None
        else:
            bit = 1 << m - j + k
            distance += bool(right_rises & bit) - bool(right_falls & bit)
        below = same >> 1
        rises, falls = right_falls | full & ~(below | right_rises), below & right_rises
    return distance if distance <= k else None


def distance(a: str, b: str, expected: int = 16) -> int:
    """The edit distance in code points; fastest if it is at most ``expected``."""
    start, end = 0, 0
    least = min(len(a), len(b))
    step = 1 << 12
    while start < least:  # equal beginnings, by pieces and then within the piece that differs
        if a[start : start + step] == b[start : start + step] and start + step <= least:
            start += step
        elif step > 1:
            step >>= 1
        else:
            break
    a, b, least, step = a[start:], b[start:], least - start, 1 << 12
    while end < least:
        if a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end] and end + step <= least:
            end += step
        elif step > 1:
            step >>= 1
        else:
            break
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    k = max(expected, abs(len(a) - len(b)), 1)
    while (found := within(a, b, k)) is None:
        k *= 2
    return found


def edit_distance(share: float = 0.01):
    """A column function of two texts: their distance, null if one is null. ``share`` of the first text's length is the
    first band."""

    @pandas_udf("int")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [None if x is None or y is None else distance(x, y, int(share * len(x)) + 1) for x, y in zip(a, b, strict=True)]
        return pd.Series(found, dtype="Int32")

    return apply

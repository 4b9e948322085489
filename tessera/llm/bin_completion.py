"""Best-fit packing of whole documents, improved by bin completion.

A document of up to ``capacity`` tokens is never cut; a longer one is cut into pieces of ``capacity`` tokens, and what is
over is its first piece. Packing is solved over the histogram of piece lengths, which has at most ``capacity`` entries
whatever the number of documents, so one task holds it and its time does not grow with the data.

The incumbent is best-fit decreasing: the longest pieces first, each where least room is left, done for all pieces of a
length at once. Bin completion then branches on the fillings around the longest piece left, least waste first and then
longer pieces first. A filling is passed over if it is dominated: pieces in it could be exchanged for one piece outside
that is no shorter than they are together and still fits. A branch ends when the waste made, or the lower bound of what is
left, shows that it can't beat the incumbent. While over ``SINGLES`` pieces are left, a filling is used as often as its
lengths allow. The search ends when the incumbent meets the lower bound, when all branches are closed, or after ``effort``
nodes; what it returns always holds every piece once.

Pieces of a length are ranked over all partitions (a count by partition and length, then running sums), and ranks map to
sequences by the table of patterns, so a length that a third of all documents share is no group anywhere.

Defined results: a null or empty text is one piece with the end id alone; equal lengths are placed in the order of
partitions; repeated rows, and rows with a null id, are packed each; other columns are not read; very long texts are many
full sequences and one first piece; an empty table gives an empty one. Sequences are numbered from 0 without gaps.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .packing import PLACE, Pattern, _places
from .tokens import encoded

#: Nodes of the search, and the number of pieces left from which on a filling is used once at a time.
EFFORT, SINGLES = 3_000, 400


def lower_bound(left: np.ndarray, capacity: int) -> int:
    """The least number of sequences: for every k, pieces over half and those beside which a piece of k no longer fits
    stand alone, and what pieces from k on exceed the room beside the others needs more. ``left`` counts by length."""
    half = capacity // 2
    length = np.arange(capacity + 1)
    n, size = np.cumsum(left), np.cumsum(left * length)
    k = np.arange(half + 1)
    big = n[capacity] - n[half]
    room_n, room_size = n[capacity - k] - n[half], size[capacity - k] - size[half]
    small = size[half] - np.where(k > 0, size[k - 1], 0)
    more = small - (room_n * capacity - room_size)
    return int(big + max(0, int((-(-more // capacity)).max())))


def best_fit(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram. Sequences with the same pieces are one entry with their number."""
    rooms: list[int] = []
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(room: int, held: dict[int, int], times: int) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append((held, times))

    for w in sorted(histogram, reverse=True):
        n, at, done = histogram[w], bisect_left(rooms, w), []
        while n and at < len(rooms):
            room, entries = rooms[at], by_room[rooms[at]]
            each = room // w
            while n and entries:
                held, times = entries.pop()
                full = min(times, n // each)
                if full:
                    done.append((room - each * w, held | {w: each}, full))
                    n, times = n - full * each, times - full
                if times and n:
                    done.append((room - n * w, held | {w: n}, 1))
                    n, times = 0, times - 1
                if times:
                    entries.append((held, times))
            if entries:
                break
            del by_room[room], rooms[at]
        if n:
            each = capacity // w
            if n // each:
                done.append((capacity - each * w, {w: each}, n // each))
            if n % each:
                done.append((capacity - n % each * w, {w: n % each}, 1))
        for entry in done:
            put(*entry)
    return [Pattern(tuple(held), tuple(held.values()), times) for room in rooms for held, times in by_room[room]]


def _spread(sums: int, most: int) -> int:
    """Bits of ``sums`` and of all numbers up to ``most`` above each."""
    width = 0
    while width < most:
        step = min(width + 1, most - width)
        sums |= sums << step
        width += step
    return sums


def _dominated(taken: dict[int, int], others: int, waste: int) -> bool:
    """A piece outside (a bit of ``others`` by its length) can stand for pieces of the filling and still fit."""
    one = several = 0
    for w, n in taken.items():
        for _ in range(n):
            several |= (one | several) << w
            one |= 1 << w
    longer = _spread(one << 1, waste - 1) if waste else 0
    return bool((_spread(several, waste) | longer) & others)


class Fillings:
    """The undominated fillings of the room beside a piece, from pieces left, least waste first."""

    def __init__(self, left: dict[int, int], room: int):
        self.room, self.left = room, left
        self.lengths = sorted((w for w in left if w <= room and left[w]), reverse=True)
        self.sums, self.within = [1], (2 << room) - 1  # sums[k]: a bit for each sum that the k longest give

    def _sums(self, k: int) -> int:
        while len(self.sums) <= k:
            w = self.lengths[len(self.sums) - 1]
            found, n, step = self.sums[-1], min(self.left[w], self.room // w), 1
            while n:
                step = min(step, n)
                found |= found << step * w & self.within
                n, step = n - step, step * 2
            self.sums.append(found)
        return self.sums[k]

    def _exactly(self, total: int, end: int) -> Iterator[dict[int, int]]:
        if not total:
            yield {}
            return
        for k in range(end):
            w = self.lengths[k]
            if w > total:
                continue
            for n in range(min(self.left[w], total // w), 0, -1):
                if self._sums(k) >> (total - n * w) & 1:
                    for rest in self._exactly(total - n * w, k):
                        yield rest | {w: n}

    def __call__(self, most_waste: int) -> Iterator[tuple[int, dict[int, int]]]:
        for waste in range(min(self.room, most_waste) + 1):
            total = self.room - waste
            for taken in self._exactly(total, len(self.lengths)):
                others = 0
                for w in self.lengths:
                    if self.left[w] > taken.get(w, 0):
                        others |= 1 << w
                if not _dominated(taken, others, waste):
                    yield waste, taken


def complete(histogram: dict[int, int], capacity: int, effort: int = EFFORT) -> tuple[list[Pattern], int]:
    """Patterns that hold every piece of ``histogram`` once, and the lower bound of their number."""
    histogram = {w: n for w, n in histogram.items() if n > 0}
    best = best_fit(histogram, capacity)
    left = np.zeros(capacity + 1, np.int64)
    for w, n in histogram.items():
        left[w] = n
    least, fewest = lower_bound(left, capacity), sum(p.times for p in best)
    size = int((left * np.arange(capacity + 1)).sum())
    path: list[tuple[dict[int, int], int]] = []  # fillings with their longest piece, and how often
    used = wasted = nodes = 0

    def branches() -> Iterator[tuple[int, dict[int, int]]]:
        longest = int(np.flatnonzero(left)[-1])
        now = {w: int(left[w]) for w in np.flatnonzero(left).tolist()}
        now[longest] -= 1
        for waste, taken in Fillings(now, capacity - longest)((fewest - 1) * capacity - size - wasted):
            yield waste, taken | {longest: taken.get(longest, 0) + 1}

    open_nodes = [branches()] if histogram and fewest > least else []
    while open_nodes and fewest > least and nodes < effort:
        step = next(open_nodes[-1], None)
        if step is None:
            open_nodes.pop()
            if path:
                taken, times, waste = path.pop()
                used, wasted = used - times, wasted - waste * times
                for w, n in taken.items():
                    left[w] += n * times
            continue
        nodes += 1
        waste, taken = step
        times = min(int(left[w]) // n for w, n in taken.items()) if int(left.sum()) > SINGLES else 1
        for w, n in taken.items():
            left[w] -= n * times
        used, wasted = used + times, wasted + waste * times
        path.append((taken, times, waste))
        if not left.any():
            if used < fewest:
                fewest, best = used, [Pattern(tuple(t), tuple(t.values()), n) for t, n, _ in path]
        elif used + lower_bound(left, capacity) < fewest:
            open_nodes.append(branches())
            continue
        path.pop()
        used, wasted = used - times, wasted - waste * times
        for w, n in taken.items():
            left[w] += n * times
    return best, least


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, its partition, its
    number among the partition's pieces of that length, and with ``keep_ids`` the ids as bytes."""
    fields = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"] + ["ids"] * keep_ids

    def rows(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            at, cols = [], [[] for _ in fields[1:]]
            for k, ids in encoded(batch, "text", tokenizer, end_id):
                n = len(ids) // 4
                first = n % capacity or capacity  # what is over comes first
                for piece, end in enumerate(range(first, n + 1, capacity)):
                    start = max(end - capacity, 0)
                    own = ids[4 * start : 4 * end]
                    at.append(k)
                    for c, x in zip(cols, (piece, start, end - start, zlib.crc32(own), part, int(seen[end - start]), own), strict=False):
                        c.append(x)
                    seen[end - start] += 1
            kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *arrays], fields)

    source = docs.select("doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, " + ", ".join(f"{f} long" for f in fields[2:7]) + ", ids binary" * keep_ids
    return source.mapInArrow(rows, schema)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, effort: int = EFFORT, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (and ids with ``keep_ids``)."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, keep_ids), "whole-pieces")
    counts = written(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "whole-piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).repartition(1)

    def solve(frames):
        histogram = {int(w): int(n) for f in frames for w, n in zip(f["length"], f["n"], strict=True)}
        yield pd.DataFrame(_places(complete(histogram, capacity, effort)[0]), columns=PLACE)

    solved = histogram.mapInPandas(solve, ", ".join(f"{c} long" for c in PLACE)).collect()
    places = np.array(sorted(solved), np.int64).reshape(-1, len(PLACE))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("number"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    first_of = {int(w): int(np.searchsorted(places[:, 0], w)) for w in np.unique(places[:, 0])}
    shared = docs.sparkSession.sparkContext.broadcast((places, first_of))

    def rows(batches):
        places, first_of = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.empty(len(length), np.int64)
            for w in np.unique(length).tolist():
                mine, start = length == w, first_of[w]
                end = int(np.searchsorted(places[:, 0], w, "right"))
                k[mine] = start + np.searchsorted(places[start:end, 1], rank[mine], "right") - 1
            nth = rank - places[k, 1]
            sequence, offset = places[k, 3] + nth // places[k, 2], places[k, 4] + nth % places[k, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    source = ranked.select(*names, "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "rank")
    return source.mapInArrow(rows, f"{schema}, sequence_id long, offset long")

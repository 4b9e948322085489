"""Packing of token sequences by cutting-stock column generation.

A document is cut every ``capacity`` tokens; its last piece is as long as what remains. The histogram of piece lengths
has at most ``capacity`` entries for any input, and one task gets it. There a linear program chooses how
often to use which pattern of lengths: it starts from greedily filled patterns, a knapsack dynamic program over the dual
prices finds the pattern that helps most, and it ends within ``tolerance`` of the bound or after ``rounds``. Uses are rounded
down; the pieces left over, which are as few as the patterns, fill sequences one by one by a subset-sum dynamic program.

Pieces of a length are ranked over all partitions (a count by partition and length, then running sums), and ranks map to
sequences by the table of patterns, whose size the number of lengths bounds. A length that a third of all documents
share is no group anywhere: its pieces keep their partition's numbers.

Defined results: a null or empty text is one piece with the end id alone; repeated rows are packed each; other columns
are not read; an empty table gives an empty one. Sequences are numbered from 0 without gaps.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoded


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each with ``counts[k]`` pieces of length ``lengths[k]``."""

    lengths: tuple[int, ...]
    counts: tuple[int, ...]
    times: int


def _best_fill(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack over ascending ``lengths``."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        n = upto[c]
        value = best[c - lengths[:n]] + prices[:n]
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], last[c] = value[k], k
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= int(lengths[last[c]])
    return float(best[capacity]), counts


def _fullest(left: dict[int, float], capacity: int) -> dict[int, int]:
    """The longest piece left with those that fill its sequence best, longer ones first."""
    longest = max(left)
    room = capacity - longest
    reach, items, within = [1], [], (2 << room) - 1
    for w in sorted((w for w in left if w <= room), reverse=True):
        for _ in range(min(int(left[w]) - (w == longest), room // w)):
            items.append(w)
            reach.append(reach[-1] | (reach[-1] << w) & within)
        if reach[-1] >> room:
            break
    total, taken = reach[-1].bit_length() - 1, {longest: 1}
    for k in range(len(items), 0, -1):
        if not reach[k - 1] >> total & 1:
            taken[items[k - 1]] = taken.get(items[k - 1], 0) + 1
            total -= items[k - 1]
    return taken


def _start(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """A basis: fullest sequences, each used until it runs a length out. No later one has that length, so the columns
    are triangular; a length that runs out beside another gets sequences of its own, used not at all."""
    at, left = {int(w): k for k, w in enumerate(lengths)}, dict(zip(lengths.tolist(), demand.tolist(), strict=True))
    columns = np.diag((capacity // lengths).astype(float))
    while left:
        held = _fullest({w: max(n, 1) for w, n in left.items()}, capacity)
        first = min(held, key=lambda w: left[w] / held[w])
        times = left[first] / held[first]
        columns[:, at[first]] = 0
        for w, n in held.items():
            columns[at[w], at[first]] = n
            left[w] -= n * times
        left = {w: n for w, n in left.items() if w != first and n > 1e-9}
    return columns


def _linear_program(lengths: np.ndarray, demand: np.ndarray, capacity: int, tolerance: float, rounds: int):
    """Columns and their fractional use, by the revised simplex method with generated columns."""
    columns = _start(lengths, demand, capacity)
    inverse = np.linalg.inv(columns)
    use, bound = inverse @ demand, float(lengths @ demand) / capacity
    for k in range(rounds):
        value, column = _best_fill(lengths, np.maximum(inverse.sum(axis=0), 0), capacity)
        bound = max(bound, use.sum() / max(value, 1))
        if value <= 1 + 1e-9 or use.sum() <= bound * (1 + tolerance):
            break
        step = inverse @ column
        can = step > 1e-9
        ratio = np.where(can, np.maximum(use, 0) / np.where(can, step, 1), np.inf)
        out = int(ratio.argmin())
        use -= ratio[out] * step
        use[out] = ratio[out]
        columns[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        if k % 200 == 199:
            inverse = np.linalg.inv(columns)
            use = inverse @ demand
    return columns.T, np.maximum(use, 0)


def patterns(histogram: dict[int, int], capacity: int, tolerance: float = 5e-4, rounds: int = 500) -> list[Pattern]:
    """Patterns that use every piece of ``histogram`` (length to count) exactly once."""
    left = {w: n for w, n in histogram.items() if n > 0}
    out = []
    if capacity in left:
        out.append(Pattern((capacity,), (1,), left.pop(capacity)))
    if left:
        lengths = np.array(sorted(left))
        columns, use = _linear_program(lengths, np.array([left[w] for w in lengths.tolist()], float), capacity, tolerance, rounds)
        for k in np.argsort(-use):
            held = {int(lengths[i]): int(columns[k][i]) for i in np.flatnonzero(columns[k])}
            times = min([int(use[k] + 1e-6), *(left.get(w, 0) // n for w, n in held.items())])
            if times:
                out.append(Pattern(tuple(held), tuple(held.values()), times))
                for w, n in held.items():
                    left[w] -= n * times
    left = {w: n for w, n in left.items() if n}
    while left:
        held = _fullest(left, capacity)
        out.append(Pattern(tuple(held), tuple(held.values()), 1))
        for w, n in held.items():
            left[w] -= n
            if not left[w]:
                del left[w]
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False) -> DataFrame:
    """A row per piece of each row of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, its
    partition, its number among the partition's pieces of that length, and with ``keep_ids`` the ids as bytes."""
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"] + ["ids"] * keep_ids

    def rows(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            at, cols = [], [[] for _ in fields[1:]]
            for k, ids in encoded(batch, "text", tokenizer, end_id):
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    number = seen[length] = seen.get(length, -1) + 1
                    at.append(k)
                    for c, x in zip(cols, (start, length, zlib.crc32(piece), n, part, number, piece), strict=False):
                        c.append(x)
            kinds = [pa.int64()] * 6 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *arrays], fields)

    source = docs.select("doc_id", "text")
    kind = dict(source.dtypes)["doc_id"]
    schema = f"doc_id {kind}, " + ", ".join(f"{f} long" for f in fields[1:7]) + ", ids binary" * keep_ids
    return source.mapInArrow(rows, schema)


PLACE = ["length", "first_rank", "together", "first_sequence", "first_offset"]


def _places(found: list[Pattern]) -> np.ndarray:
    """For each pattern and length: the length, first rank, pieces in one sequence, first sequence, first offset."""
    out, ranks, sequence = [], {}, 0
    for p in found:
        offset = 0
        for w, n in zip(p.lengths, p.counts, strict=True):
            out.append((w, ranks.get(w, 0), n, sequence, offset))
            ranks[w] = ranks.get(w, 0) + n * p.times
            offset += n * w
        sequence += p.times
    return np.array(out, np.int64).reshape(-1, len(PLACE))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of each piece (and ids with ``keep_ids``)."""
    cut = written(pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = written(counts, "piece-counts")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).repartition(1)

    def solve(frames):
        histogram = {int(w): int(n) for f in frames for w, n in zip(f["length"], f["n"], strict=True)}
        yield pd.DataFrame(_places(patterns(histogram, capacity)), columns=PLACE)

    solved = histogram.mapInPandas(solve, ", ".join(f"{c} long" for c in PLACE)).collect()
    places = np.array(sorted(solved), np.int64).reshape(-1, len(PLACE))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("number"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    top = int(places[:, 1].max()) + 1 if len(places) else 1
    shared = docs.sparkSession.sparkContext.broadcast(places)

    def rows(batches):
        p = shared.value
        starts = p[:, 0] * top + p[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(starts, length * top + np.minimum(rank, top - 1), "right") - 1
            nth = rank - p[k, 1]
            sequence, offset = p[k, 3] + nth // p[k, 2], p[k, 4] + nth % p[k, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    source = ranked.select(*names, "rank")
    schema = ", ".join(f"`{c}` {t}" for c, t in source.dtypes if c != "rank")
    return source.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, boundaries) from ``pack`` with its ids: a sequence's ids as bytes, and its pieces' offsets."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("p")).select(
        "sequence_id",
        F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("p.offset").alias("boundaries"),
    )

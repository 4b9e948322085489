"""Vectors as codes of their parts: a codebook of entries per part, learned in whole numbers, and exact nearest entries.

Every component becomes floor(``SCALE`` * x). A codebook starts as that part of the vectors with the smallest ids; each
round assigns every part to its nearest entry and moves entries to the floored mean of their parts. Sums are made per task
and entry, so what is shuffled and what comes to the driver is bounded by the codebooks (parts x entries x length).

The nearest entry is found through memoised grid cells. A part's coarse cell (a box of side ``CELL`` in whole numbers) is
hashed; for a new cell the least and the greatest distance from the box to each entry are worked out, and the entries whose
least distance is above the smallest greatest distance are dominated in the whole box. The others are remembered with the cell,
and only they are compared with the cell's parts, exactly, ties to the lower index. A task forgets all cells once it holds
``CELLS`` of a part, so its memory does not grow; they are then worked out again.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. ``length`` is that of most
of the other vectors (the shorter, of equally frequent ones); rows with another have null code, error and label_error.
A length that can't be cut into equal parts is refused. Rows with a null id have codes but don't start a codebook; of rows with equal
ids the one with the smaller vector comes first. With fewer rows than entries the codebooks are smaller, and an empty table
gives an empty one. Components beyond what 64 bits of a distance hold (over 700,000 for 64 components) count as that limit, and
a label's error beyond 64 bits is null. Repeated rows are coded each; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, small_batches, written

SCALE, CELL, CELLS = 256, 32, 100_000


def is_whole(vector: str) -> Column:
    """The vector is not null and has only finite components."""
    return F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def most(length: int) -> int:
    """The greatest component for which a squared distance of whole vectors fits in 64 bits."""
    return int((2**61 // max(length, 1)) ** 0.5)


def whole_numbers(values: np.ndarray, length: int) -> np.ndarray:
    """Rows of floor(SCALE * x), within the limits of ``most``."""
    limit = most(length)
    scaled = np.floor(SCALE * values.astype(np.float64))
    return np.clip(scaled, -limit, limit).astype(np.int64).reshape(-1, length)


class Cells:
    """The nearest entries of one part's codebook, by remembered cells."""

    def __init__(self, entries: np.ndarray, cell: int = CELL, most_cells: int = CELLS):
        self.entries, self.cell, self.most_cells = entries, cell, most_cells
        self.columns = [np.ascontiguousarray(c) for c in entries.T]
        self.known: dict[bytes, np.ndarray] = {}
        self.worked_out = 0

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each box the entries that are nearest somewhere in it, in order, and perhaps some more."""
        low = cells[:, None, :] * self.cell
        to_low, to_high = low - self.entries, low + (self.cell - 1) - self.entries
        nearest = np.maximum(np.maximum(to_low, -to_high), 0)
        farthest = np.maximum(np.abs(to_low), np.abs(to_high))
        least, greatest = (nearest * nearest).sum(axis=2), (farthest * farthest).sum(axis=2)
        self.worked_out += len(cells)
        return [np.flatnonzero(row) for row in least <= greatest.min(axis=1, keepdims=True)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part."""
        boxes = np.ascontiguousarray(parts // self.cell)
        keys = boxes.view(np.dtype((np.void, boxes.dtype.itemsize * boxes.shape[1]))).ravel()
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        names = [k.tobytes() for k in distinct]
        new = [k for k, name in enumerate(names) if name not in self.known]
        if len(self.known) + len(new) > self.most_cells:
            self.known, new = {}, list(range(len(names)))
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            for k, found in zip(some, self.candidates(boxes[first[some]]), strict=True):
                self.known[names[k]] = found
        per_cell = [self.known[name] for name in names]
        sizes = np.array([len(c) for c in per_cell], np.int64)
        table = np.zeros((sizes.max(initial=1), len(names)), np.int64)
        for k, found in enumerate(per_cell):
            table[: len(found), k] = found
        order = np.argsort(-sizes[which], kind="stable")  # those with most candidates first
        which, columns = which[order], [np.ascontiguousarray(c) for c in parts[order].T]
        with_place = len(parts) - np.searchsorted(np.sort(sizes[which]), np.arange(len(table)), "right")
        best, index = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        for n, row in zip(with_place, table, strict=True):  # in the order of entries, so the first of equal ones stays
            entry, far = row[which[:n]], np.zeros(n, np.int64)
            for column, values in zip(columns, self.columns, strict=True):
                gap = column[:n] - values[entry]
                far += gap * gap
            closer = far < best[:n]
            np.copyto(best[:n], far, where=closer)
            np.copyto(index[:n], entry, where=closer)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        index, best = index[back], best[back]
        return index, best


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return whole_numbers(batch.column("v").flatten().to_numpy(zero_copy_only=False), length)


def _moved(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: part, entry and component by component the floored mean of what is assigned."""
    parts, entries, width = codebooks.shape
    length = parts * width

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        total, n = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            vectors = _vectors(batch, length)
            for p in range(parts):
                mine = vectors[:, p * width : (p + 1) * width]
                index, _ = cells[p].nearest(mine)
                n[p] += np.bincount(index, minlength=entries)
                for c in range(width):
                    np.add.at(total[p, :, c], index, mine[:, c])
        p, e = np.nonzero(n)
        values = pa.array(total[p, e].ravel())
        offsets = pa.array(np.arange(0, len(p) * width + 1, width, dtype=np.int32))
        columns = [pa.array(p), pa.array(e), pa.array(n[p, e]), pa.ListArray.from_arrays(offsets, values)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    per_task = kept.select("v").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    added = [F.sum(F.col("total")[c].cast("decimal(38,0)")).alias(f"c{c}") for c in range(width)]
    out = codebooks.copy()
    for row in per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():
        out[row.part, row.entry] = [int(row[f"c{c}"]) // row.n for c in range(width)]
    return out


def _coded(kept: DataFrame, codebooks: np.ndarray, names: list[str]) -> DataFrame:
    parts, _, width = codebooks.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        for batch in batches:
            vectors = _vectors(batch, parts * width)
            codes, error = np.empty((len(vectors), parts), "u1"), np.zeros(len(vectors), np.int64)
            for p in range(parts):
                codes[:, p], far = cells[p].nearest(vectors[:, p * width : (p + 1) * width])
                error += far
            hexed = [row.tobytes().hex() for row in codes]
            columns = [*(batch.column(c) for c in names), pa.array(hexed, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "code", "error"])

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return kept.select(*names, "v").mapInArrow(rows, f"{schema}, code string, error long")


def fit(kept: DataFrame, length: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks by part, entry and component, of rows (vec_id, v) with vectors of ``length``."""
    if length % parts or not 0 < entries <= 256:
        raise ValueError("vectors are cut into equal parts, and an index has two hex digits")
    start = kept.where("vec_id is not null").orderBy("vec_id", "v").select("v").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, length // parts), np.int64)
    vectors = whole_numbers(np.array([r.v for r in start]), length)
    codebooks = vectors.reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        codebooks = _moved(kept, codebooks)
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    """Of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of each row of ``vectors`` (vec_id, embedding, label), and the codebooks."""
    small_batches(vectors.sparkSession)
    whole = vectors.where(is_whole("embedding")).select("vec_id", "label", F.col("embedding").alias("v"))
    lengths = whole.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), "length").first()
    length = lengths["length"] if lengths else parts
    kept, rest = whole.where(F.size("v") == length), whole.where(F.size("v") != length)
    codebooks = fit(kept, length, parts, entries, rounds)
    names = ["vec_id", "label"]
    if codebooks.shape[1]:
        coded = _coded(kept, codebooks, names)
    else:  # no row has an id
        coded = kept.select(*names, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = coded.unionByName(rest.select(*names), allowMissingColumns=True)
    coded = coded.withColumn("_named", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    coded = written(coded, "vector-codes")
    by_label = coded.groupBy("_named").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n"))
    every = join_counted(coded, by_label, "_named")
    error = F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error")
    return every.select(*names, "code", "error", error), codebooks

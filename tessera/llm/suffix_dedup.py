"""Exact substring dedup with a logarithmic family of sampled suffix arrays.

A byte of a document goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Suffixes are sampled where a string of that length must be noticed: of every window of ``length`` bytes the position whose
first ``GRAM`` bytes hash lowest is an anchor, so equal windows hold equal anchors at equal places (a suffix array sampled
by minimizers). Documents come in batches of ascending ids. A batch gets the array of its anchors' suffixes in the order of
their bytes; an array keeps the head of each suffix, ``GRAM`` bytes, and of suffixes with one head the smallest document.
The array is merge-scanned against those of the levels before it: neighbours in suffix order are compared by the length of
their common prefix, and where that reaches the whole head and their documents differ, there is a hit for all its holders.
The new array then merges with the levels of its own size, as in a binary counter, so each entry is rewritten as often as
the logarithm of the number of batches. A bulk load takes ``n_batches`` batches whatever its size, as each batch reads all
levels before it.

Hits are then extended to both sides. Each is sent with all bytes around it that a window over it can cover. Equal
surroundings are one entry, of the smallest document; all others that hold them lose them whole. Where a head has several
surroundings, their windows are compared one place at a time. A head with more hits than ``HOT_HITS`` is split by further
bytes instead: each window over it is a row of its own, rows are dealt and sorted by the
window's bytes, and a task compares neighbours as they come, holding one. What a task has found to be equal within a slice
is reduced before it is shuffled, both for the arrays and for the surroundings, so a passage that very many documents share
costs each slice one entry. A text that a smaller document has whole goes whole, without being compared. Texts are
shuffled twice, compressed, by document (a third time those with a hot head); nothing of them passes the driver, which
keeps only the batch bounds and the hot heads, at most one for every ``HOT_HITS`` hits.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose nothing; a very long text is held whole by
its task; rows with equal ids do not count against each other; a row with a null id loses nothing and counts against none;
of equal strings those of the smallest id stay, so ties do not arise; other columns are not read; an empty table gives an
empty one.
"""

from __future__ import annotations

import gc
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, join_counted, scratch, text_of, written
from .decontamination import merged

GRAM = 16
SLICE = 1_000_000
#: A head with more hits than this is hot, however many there are: its hits are dealt by their windows and not by the head. The
#: surroundings of so many hits are 42 MB, and comparing them takes about three times that beside them. What the driver holds
#: of hot heads is 8 bytes for every so many hits.
HOT_HITS = 500_000
TOP = np.uint64(2**64 - 1)
#: Odd multipliers of the hashes: multiples of the golden ratio's and of pi's fraction.
MULTIPLIERS = [np.uint64((k * 0x9E3779B97F4A7C15 ^ k * 0x243F6A8885A308D3) % 2**64 | 1) for k in range(3, 9)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIERS[0]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of each position the hash of the GRAM bytes from there; ``data`` has GRAM bytes more than positions."""
    n = len(data) - GRAM
    return _hashes(*(np.ndarray((n,), "<u8", data, k, (1,)) for k in (0, 8)))


def _hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(first * MULTIPLIERS[1] + MULTIPLIERS[3]) + second * MULTIPLIERS[2])


def head_hashes(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """``gram_hashes`` of heads, which are pairs of numbers in the order of their bytes."""
    return _hashes(high.byteswap(), low.byteswap())


def common_prefix(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """How many bytes each head has in common with the one before it, from the second on."""
    first, second = high[1:] ^ high[:-1], low[1:] ^ low[:-1]
    more = first == 0
    differing, out = np.where(more, second, first), more.astype(np.int8) * np.int8(8)
    for k in range(8):
        out += differing < np.uint64(1 << 8 * k)
    return out


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of each run of ``width`` values."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class Slice:
    """Some documents' bytes in a row, with their gram hashes and anchors."""

    def __init__(self, texts: list[bytes], length: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n, width = int(sizes.sum()), length - GRAM + 1
        self.data = np.frombuffer(b"".join([*texts, bytes(GRAM)]), np.uint8)
        left = np.repeat(self.ends, sizes) - np.arange(n)
        self.hashes = np.where(left >= GRAM, gram_hashes(self.data), TOP)
        if n < length:
            self.least = np.zeros(n + width + length, np.uint64)
            self.window = np.zeros(n + width + length, bool)
            self.anchors = np.zeros(0, np.int64)
        else:
            window = left[: n - width + 1] >= length
            least = np.where(window, _sliding(self.hashes, width, np.minimum), np.uint64(0))
            edge = np.zeros(width - 1, np.uint64)
            most = _sliding(np.concatenate((edge, least, edge)), width, np.maximum)
            near = _sliding(np.concatenate((edge.astype(bool), window, edge.astype(bool))), width, np.maximum)
            self.anchors = np.flatnonzero((self.hashes == most) & near)
            self.least = np.concatenate((edge, least, np.zeros(length, np.uint64)))
            self.window = np.concatenate((edge.astype(bool), window, np.zeros(length, bool)))
        self.rows = np.searchsorted(self.ends, self.anchors, "right")

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """The first GRAM bytes of the suffix at each anchor, as two numbers in the order of their bytes."""
        n = len(self.data) - GRAM
        return tuple(np.ndarray((n,), ">u8", self.data, k, (1,))[self.anchors].astype(np.uint64) for k in (0, 8))

    def reach(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """How many bytes before and after each anchor the windows cover of which it is the lowest."""
        width = length - GRAM + 1
        before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for back in range(width):
            k = at - back + width - 1
            mine = (self.least[k] == self.hashes[at]) & self.window[k]
            before[mine] = back
            after[mine & (after == 0)] = length - back
        return before, after


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed): the key and the compressed bytes of each text, for what shuffles texts."""

    def rows(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack(t.as_buffer() or b"") for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), z], ["doc_id", "key", "packed"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, packed binary")


def _texts(batch: pa.RecordBatch):
    if "packed" in batch.schema.names:
        unpack = zstandard.ZstdDecompressor().decompress
        return (unpack(x.as_buffer()) for x in batch.column("packed"))
    return (bytes(x.as_buffer() or b"") for x in batch.column("text"))


def _slices(batch: pa.RecordBatch, length: int):
    """(first row, Slice) over a batch with the column ``text`` or ``packed``."""
    held, first, n = [], 0, 0
    for k, t in enumerate(_texts(batch)):
        held.append(t)
        n += len(held[-1])
        if n > SLICE or k + 1 == len(batch):
            yield first, Slice(held, length)
            held, first, n = [], k + 1, 0


def _buckets(grams: np.ndarray, n: int) -> np.ndarray:
    """Even buckets, though anchors are those with the lowest hashes."""
    return ((_mixed(grams * MULTIPLIERS[5]) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values of a sorted array start, and for each value the number of its run."""
    new = np.concatenate(([True], x[1:] != x[:-1])) if len(x) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1


def _blob_rows(kind: int, high: np.ndarray, low: np.ndarray, docs: np.ndarray, known: np.ndarray, n: int) -> pa.RecordBatch:
    """A row per bucket of entries (head, doc, known), which stay in suffix order."""
    b = _buckets(head_hashes(high, low), n)
    order = np.argsort(b, kind="stable")
    starts, _ = _runs(b[order])
    cut = lambda x: [p.tobytes() for p in np.split(x[order], starts[1:])] if len(starts) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(starts), kind), pa.int32()),
            pa.array(b[order][starts], pa.int32()),
            *(pa.array(cut(x), pa.binary()) for x in (high, low, docs, known.astype(np.uint8))),
        ],
        BLOB_NAMES,
    )


BLOBS = "kind int, bucket int, high binary, low binary, docs binary, known binary"
BLOB_NAMES = [x.split()[0] for x in BLOBS.split(", ")]
PARTS = dict(high=np.uint64, low=np.uint64, docs=np.int64, known=np.uint8)
HIT, NEW = -1, 0  # a kind over 0 is a level


def _scan(high, low, docs, known):
    """Bring suffixes in order and scan neighbours. Returns entries with one head each and the smallest document, and the
    (high, low, docs) of new hits."""
    order = np.lexsort((low, high))
    high, low, docs, known = (x[order] for x in (high, low, docs, known))
    if not len(high):
        return (high, low, docs, known), (high, low, docs)
    new = np.concatenate(([True], common_prefix(high, low) < GRAM))
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    least, most = np.minimum.reduceat(docs, starts), np.maximum.reduceat(docs, starts)
    shared = (least < most) | np.maximum.reduceat(known, starts).astype(bool)
    hit = shared[run] & (known == 0)
    return (high[starts], low[starts], least, shared.astype(np.uint8)), (high[hit], low[hit], docs[hit])


def _array_rows(batches, length: int, n: int):
    """Suffixes of documents, one of each head within a slice, and hits between documents of a slice."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, s in _slices(batch, length):
            entries, hits = _scan(*s.heads(), ids[first:][s.rows], np.zeros(len(s.rows), np.uint8))
            yield _blob_rows(NEW, *entries, n)
            yield _blob_rows(HIT, *hits, np.zeros(len(hits[0]), np.uint8), n)


def _merge_rows(batches, merging: frozenset[int], n: int):
    """All rows of a bucket: hits pass, the new entries and levels are scanned, and those in ``merging`` are merged."""
    held = {}
    for batch in batches:
        for kind, *blobs in zip(batch.column("kind").to_pylist(), *(batch.column(c) for c in PARTS), strict=True):
            parts = [np.frombuffer(b.as_buffer(), t) for b, t in zip(blobs, PARTS.values(), strict=True)]
            if kind == HIT:
                yield _blob_rows(HIT, *parts, n)
            else:
                held.setdefault(kind, []).append(parts)
    if not held:
        return
    old = [p for k, ps in held.items() if k not in merging and k != NEW for p in ps]
    new = [p for k, ps in held.items() if k in merging or k == NEW for p in ps]
    every = [np.concatenate(x) for x in zip(*old, *new, strict=True)]
    _, hits = _scan(*every)
    yield _blob_rows(HIT, *hits, np.zeros(len(hits[0]), np.uint8), n)
    if new:
        mine = [np.concatenate(x) for x in zip(*new, strict=True)]
        (high, low, docs, known), _ = _scan(*mine)
        found = np.isin(head_hashes(high, low), head_hashes(*hits[:2]))
        yield _blob_rows(NEW, high, low, docs, known | found, n)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def levels_after(ranks: list[int]) -> tuple[int, int]:
    """Of levels with ``ranks``, the largest first, how many stay as they are when a batch comes, and the rank of the level
    that the batch makes with the rest: levels of a size merge as a binary counter carries."""
    kept, rank = len(ranks), 0
    while kept and ranks[kept - 1] == rank:
        kept, rank = kept - 1, rank + 1
    return kept, rank


def hits(docs: DataFrame, length: int, n_batches: int, n_buckets: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, grams): for each document the grams of its anchors that more documents than one hold; and the grams that
    are hot. Builds the index family over ``docs`` (doc_id not null, text) batch by batch."""
    spark = docs.sparkSession
    shares = [k / n_batches for k in range(1, n_batches)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000 * n_batches)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    found, levels = [], []  # levels: (rank, path), the largest first
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        n_kept, rank = levels_after([r for r, _ in levels])
        kept = levels[:n_kept]
        rows = batch.mapInArrow(partial(_array_rows, length=length, n=n_buckets), BLOBS)
        for k, (_, path) in enumerate(levels, 1):
            level = spark.read.schema(BLOBS).parquet(f"{path}/of=level")
            rows = rows.union(level.withColumn("kind", F.lit(k)))
        merging = frozenset(range(len(kept) + 1, len(levels) + 1))
        path = scratch(spark, "suffixes")
        (
            rows.repartitionById(n_buckets, F.col("bucket"))
            .mapInArrow(partial(_merge_rows, merging=merging, n=n_buckets), BLOBS)
            .withColumn("of", F.when(F.col("kind") == HIT, "hit").otherwise("level"))
            .write.partitionBy("of").option("compression", "zstd").parquet(path)
        )
        for _, gone in levels[len(kept) :]:
            drop(spark, f"{gone}/of=level")
        levels = [*kept, (rank, path)]
        found.append(f"{path}/of=hit")
        del rows, batch
        release(spark)
    for _, path in levels:
        drop(spark, f"{path}/of=level")
    out = None
    jvm = spark.sparkContext._jvm
    for path in found:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            rows = spark.read.schema(BLOBS).parquet(path)
            out = rows if out is None else out.union(rows)

    def flat(batches):
        for batch in batches:
            for high, low, docs in zip(batch.column("high"), batch.column("low"), batch.column("docs"), strict=True):
                grams = head_hashes(*(np.frombuffer(x.as_buffer(), np.uint64) for x in (high, low)))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs.as_buffer(), np.int64)), pa.array(grams.view(np.int64))], ["doc_id", "gram"])

    if out is None:
        return spark.createDataFrame([], "doc_id long, grams array<long>"), np.zeros(0, np.int64)
    flat_rows = out.mapInArrow(flat, "doc_id long, gram long")
    by_doc = written(flat_rows.groupBy("doc_id").agg(F.collect_set("gram").alias("grams")), "hits")
    for path in found:
        drop(spark, path)
    counted = by_doc.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    hot = np.array(sorted(r.gram for r in counted.where(F.col("n") > HOT_HITS).select("gram").collect()), np.int64)
    return by_doc, hot


def _window_hashes(around: np.ndarray, length: int):
    """For one start after another the hashes of all rows' windows from it, each rolled on from the one before, so what is
    held beside the rows is a few numbers a row."""
    columns = np.ascontiguousarray(around.T)
    bases = MULTIPLIERS[3:5]
    held = [np.zeros(len(around), np.uint64) for _ in bases]
    for s in range(len(columns) - length + 1):
        for k, base in enumerate(bases):
            h = held[k]
            if s:
                h -= (columns[s - 1] + np.uint64(1)) * np.uint64(pow(int(base), length - 1, 2**64))
            for column in columns[:length] if not s else columns[s + length - 1 : s + length]:
                h *= base
                h += column
                h += np.uint64(1)
        yield _mixed(_mixed(held[0]) + held[1])


class Around:
    """Hits with the bytes around them: gram, document, key of its text, position, and how many bytes before and after it
    count."""

    fields = (("grams", np.uint64), ("docs", np.int64), ("keys", np.int64), ("at", np.int32), ("before", np.uint8), ("after", np.uint8))

    def __init__(self, columns: list[np.ndarray], around: np.ndarray, length: int):
        self.grams, self.docs, self.keys, self.at, self.before, self.after = columns
        self.around, self.length, self.reach = around, length, length - GRAM

    def take(self, k: np.ndarray) -> Around:
        return Around([getattr(self, f)[k] for f, _ in self.fields], self.around[k], self.length)

    def _spans(self, k: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [self.docs[k], self.keys[k], (self.at[k] + start).astype(np.int32), (self.at[k] + end).astype(np.int32)]

    def reduced(self) -> tuple[Around, list[np.ndarray]]:
        """One entry for each surroundings, of the smallest document, and the spans that the others lose."""
        if not len(self.grams):
            return self, [self.docs, self.keys, self.at, self.at]
        key = self.grams * MULTIPLIERS[5]
        for k in range(0, self.around.shape[1], 8):
            part = np.zeros((len(key), 8), np.uint8)
            part[:, : self.around.shape[1] - k] = self.around[:, k : k + 8]
            key = _mixed(key + part.view("<u8").ravel() * MULTIPLIERS[2])
        key = _mixed(key + self.before * MULTIPLIERS[3] + self.after * MULTIPLIERS[4])
        order = np.lexsort((self.docs, key))
        starts, run = _runs(key[order])
        first = order[starts][run]
        same = (self.around[order] == self.around[first]).all(axis=1) & (self.grams[order] == self.grams[first])
        same &= (self.before[order] == self.before[first]) & (self.after[order] == self.after[first])
        goes = same & (self.docs[order] > self.docs[first])
        # the same document may hold the same surroundings twice: all of those stay, for each place needs its answer
        stays, out = np.sort(order[~goes]), order[goes]
        return self.take(stays), self._spans(out, -self.before[out].astype(np.int32), self.after[out].astype(np.int32))

    def windows(self) -> list[np.ndarray]:
        """Spans of windows that a smaller document holds at the same place around the same gram."""
        order = np.lexsort((self.docs, self.grams))
        starts, run = _runs(self.grams[order])
        if not len(starts):
            return [self.docs, self.keys, self.at, self.at]
        docs = self.docs[order]
        mixed = docs[starts] < np.maximum.reduceat(docs, starts)
        x = self.take(order[mixed[run]])
        spans = [[x.docs[:0], x.keys[:0], x.at[:0], x.at[:0]]]
        n, done = len(x.grams), 0
        while done < n:  # whole grams, about this many entries at a time
            end = min(n, done + 50_000)
            while end < n and x.grams[end] == x.grams[end - 1]:
                end += 1
            spans += x.take(np.arange(done, end))._window_spans()
            done = end
        return [np.concatenate(c) for c in zip(*spans, strict=True)]

    def _window_spans(self) -> list[list[np.ndarray]]:
        out = []
        for s, hashes in enumerate(_window_hashes(self.around, self.length)):
            k = np.flatnonzero((self.before >= self.reach - s) & (self.after >= self.length - self.reach + s))
            key = _mixed(hashes[k] + self.grams[k] * MULTIPLIERS[1])
            order = np.lexsort((self.docs[k], key))
            starts, run = _runs(key[order])
            if not len(starts):
                continue
            rows = k[order]
            first = rows[starts][run]
            later = self.docs[rows] > self.docs[first]
            rows, first = rows[later], first[later]
            equal = (self.around[rows, s : s + self.length] == self.around[first, s : s + self.length]).all(axis=1)
            rows = rows[equal]
            start = np.full(len(rows), s - self.reach, np.int32)
            out.append(self._spans(rows, start, start + self.length))
        return out


def _span_rows(spans: list[np.ndarray]) -> pa.RecordBatch:
    """Spans, with those of a text that touch made one."""
    docs, keys, start, end = spans
    order = np.lexsort((end, start, keys, docs))
    docs, keys, start, end = docs[order], keys[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if len(docs):
        wide = np.cumsum(np.concatenate(([False], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])))) * 2**32
        reach = np.maximum.accumulate(end + wide)
        starts = np.flatnonzero(np.concatenate(([True], (start + wide)[1:] > reach[:-1])))
        end = np.maximum.reduceat(end + wide, starts) - wide[starts]
        docs, keys, start = docs[starts], keys[starts], start[starts]
    blank = [pa.nulls(len(docs), pa.int32()), *(pa.nulls(len(docs), pa.binary()) for _ in range(len(Around.fields) + 1))]
    spans = [pa.array(docs), pa.array(keys), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
    return pa.RecordBatch.from_arrays([*blank, *spans], AROUND_NAMES)


SPAN = "doc_id long, key long, start int, end int"
AROUND = "bucket int, " + "".join(f"{f} binary, " for f, _ in Around.fields) + f"around binary, {SPAN}"
AROUND_NAMES = [f.split()[0] for f in AROUND.split(", ")]
SPAN_NAMES = AROUND_NAMES[-4:]


def _around_rows(batches, length: int, n: int, hot: np.ndarray):
    """For each document with its hits' grams: the hits but the hot ones with what is around them, and spans known from the
    slice."""
    reach = length - GRAM
    for batch in batches:
        ids, keys, grams = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy(), batch.column("grams")
        for first, s in _slices(batch, length):
            wanted = [np.setdiff1d(np.array(grams[first + k].values).astype(np.int64), hot) for k in range(len(s.ends))]
            mine = s.hashes[s.anchors].view(np.int64)
            cuts = np.searchsorted(s.rows, np.arange(len(s.ends) + 1))
            found = [np.isin(mine[a:b], w) for a, b, w in zip(cuts, cuts[1:], wanted, strict=False)]
            at = s.anchors[np.concatenate(found)] if found else s.anchors
            row = np.searchsorted(s.ends, at, "right")
            before, after = s.reach(at, length)
            place = np.arange(-reach, length)
            padded = np.concatenate((np.zeros(reach, np.uint8), s.data, np.zeros(length, np.uint8)))
            around = padded[at[:, None] + (place + reach)]
            around[(place < -before[:, None]) | (place >= after[:, None])] = 0
            columns = [s.hashes[at], ids[first:][row], keys[first:][row], (at - s.starts[row]).astype(np.int32), before.astype(np.uint8), after.astype(np.uint8)]
            left, spans = Around(columns, around, length).reduced()
            yield _span_rows(spans)
            b = _buckets(left.grams, n)
            order = np.argsort(b, kind="stable")
            starts, _ = _runs(b[order])
            pack = zstandard.ZstdCompressor(level=1).compress
            cut = lambda x: pa.array([pack(p.tobytes()) for p in np.split(x[order], starts[1:])] if len(starts) else [], pa.binary())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [pa.array(b[order][starts], pa.int32()), *(cut(getattr(left, f)) for f, _ in Around.fields), cut(left.around)]
                + [pa.nulls(len(starts), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())],
                AROUND_NAMES,
            )


def _compared_rows(batches, length: int):
    """All rows of a bucket: spans pass, the hits of each gram are compared."""
    held, unpack = [], zstandard.ZstdDecompressor().decompress
    for batch in batches:
        spans = batch.filter(batch.column("doc_id").is_valid())
        if len(spans):
            yield spans.select(SPAN_NAMES)
        for row in zip(*(batch.column(c) for c in AROUND_NAMES[1:-4]), strict=True):
            if row[0].is_valid:
                held.append([np.frombuffer(unpack(x.as_buffer()), t) for x, t in zip(row, [t for _, t in Around.fields] + [np.uint8], strict=True)])
    if held:
        *columns, around = [np.concatenate(x) for x in zip(*held, strict=True)]
        del held
        left, spans = Around(columns, around.reshape(len(columns[0]), -1), length).reduced()
        yield _span_rows(spans).select(SPAN_NAMES)
        yield _span_rows(left.windows()).select(SPAN_NAMES)


WINDOW = "window binary, doc_id long, key long, at int"


def _window_rows(batches, length: int):
    """For each document with the hot grams that it holds: its windows over them, of each slice's equal ones that of the
    smallest document, and spans (without a window) that the others lose."""
    reach = length - GRAM
    for batch in batches:
        ids, keys, grams = batch.column("doc_id").to_numpy(), batch.column("key").to_numpy(), batch.column("grams")
        for first, s in _slices(batch, length):
            wanted = [np.array(grams[first + k].values).astype(np.int64) for k in range(len(s.ends))]
            mine, cuts = s.hashes[s.anchors].view(np.int64), np.searchsorted(s.rows, np.arange(len(s.ends) + 1))
            found = [np.isin(mine[a:b], w) for a, b, w in zip(cuts, cuts[1:], wanted, strict=False)]
            at = s.anchors[np.concatenate(found)] if found else s.anchors
            before, after = s.reach(at, length)
            back = np.arange(reach + 1)
            fits = (back <= before[:, None]) & (length - back <= after[:, None])
            start = np.unique((at[:, None] - back)[fits])
            row = np.searchsorted(s.ends, start, "right")
            docs, least = ids[first:][row], {}
            windows = [s.data[a : a + length].tobytes() for a in start.tolist()]
            for k, w in enumerate(windows):
                j = least.setdefault(w, k)
                if docs[k] < docs[j]:
                    least[w] = k
            lost = np.array([docs[k] > docs[least[w]] for k, w in enumerate(windows)], bool)
            column = pa.array([None if gone else w for w, gone in zip(windows, lost.tolist(), strict=True)], pa.binary())
            place = pa.array(start - s.starts[row], pa.int32())
            yield pa.RecordBatch.from_arrays([column, pa.array(docs), pa.array(keys[first:][row]), place], ["window", "doc_id", "key", "at"])


def _neighbour_rows(batches, length: int):
    """Spans of rows sorted by window and document that have the window of a smaller document; one window is held."""
    last, least = None, None
    for batch in batches:
        docs, lost = batch.column("doc_id").to_pylist(), []
        for k, w in enumerate(batch.column("window").to_pylist()):
            if w is None or w != last:
                lost += [k] if w is None else []
                last, least = (w, docs[k]) if w is not None else (last, least)
            elif docs[k] > least:
                lost.append(k)
        rows = batch.take(pa.array(lost, pa.int64()))
        start = rows.column("at").to_numpy()
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("key"), pa.array(start, pa.int32()), pa.array(start + np.int32(length), pa.int32())], SPAN_NAMES)


def hot_spans(docs: DataFrame, found: DataFrame, hot: np.ndarray, length: int, n: int) -> DataFrame:
    """(doc_id, key, start, end) that documents lose for windows over hot grams; ``docs`` is ``packed``."""
    known = docs.sparkSession.sparkContext.broadcast(hot)

    def only(batches):
        for batch in batches:
            kept = [np.intersect1d(np.array(x.values), known.value) for x in batch.column("grams")]
            some = pa.array([k for k, x in enumerate(kept) if len(x)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(some), pa.array([x for x in kept if len(x)], pa.list_(pa.int64()))], ["doc_id", "grams"])

    mine = found.mapInArrow(only, "doc_id long, grams array<long>")
    rows = docs.join(mine, "doc_id").mapInArrow(partial(_window_rows, length=length), WINDOW)
    dealt = rows.repartition(n, F.coalesce("window", F.unhex(F.lpad(F.hex(F.xxhash64("doc_id", "at")), 16, "0")))).sortWithinPartitions("window", "doc_id")
    return dealt.mapInArrow(partial(_neighbour_rows, length=length), SPAN)


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id) of documents with a text that no smaller document has whole, and (doc_id, key, n) of the rows whose text
    one has. Those lose all they have without being compared."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n"))
    rows = written(rows, "copies")
    least = rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count("*").alias("c")).where("c > 1")
    later = written(join_counted(rows, written(least, "repeated"), "sha", "c").where("doc_id > least").select("doc_id", "key", "n"), "copies")
    return rows.join(later.select("doc_id", "key"), ["doc_id", "key"], "left_anti").select("doc_id").distinct(), later


def repeated_spans(docs: DataFrame, length: int = 50, n_batches: int = 4, bucket_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, key, start, end): byte spans of ``docs`` (doc_id, text) that cover what goes; they may overlap. The key
    is the XXH64 of the text, which tells rows with equal ids apart."""
    spark = docs.sparkSession
    mine = docs.select("doc_id", text_of().alias("text")).where("doc_id is not null")
    total = mine.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(16, -(-total // bucket_bytes))
    found, hot = hits(mine, length, n_batches, n)
    release(spark)
    first, later = copies(mine)
    found = found.join(first, "doc_id", "left_semi")
    near = packed(mine).join(found, "doc_id").mapInArrow(partial(_around_rows, length=length, n=n, hot=hot), AROUND)
    dealt = near.repartitionById(n, F.coalesce("bucket", F.pmod(F.hash("doc_id", "start"), F.lit(n))))
    spans = dealt.mapInArrow(partial(_compared_rows, length=length), SPAN)
    whole = later.where(F.col("n") >= length).select("doc_id", "key", F.lit(0).alias("start"), F.col("n").cast("int").alias("end"))
    if len(hot):
        spans = spans.union(hot_spans(packed(mine), found, hot, length, n))
    spans = written(spans.union(whole), "spans")
    del near, dealt
    release(spark)
    return spans


def remove_repeats(docs: DataFrame, length: int = 50, n_batches: int = 4, bucket_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each row's removed byte spans [start, end), maximal and in order, and the bytes
    that stay."""
    spans = repeated_spans(docs, length, n_batches, bucket_bytes)
    by_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = pa.list_(pa.list_(pa.int32()))

    def rows(batches):
        for batch in batches:
            out, kept, sizes = [], [], []
            for raw, spans in zip(_texts(batch), batch.column("spans").to_pylist(), strict=True):
                gone = merged([(x["start"], x["end"]) for x in spans or []])
                edges = [0, *(e for span in gone for e in span), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                out.append([list(x) for x in gone])
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    both = packed(docs.select("doc_id", text_of().alias("text"))).join(by_doc, ["doc_id", "key"], "left")
    return both.mapInArrow(rows, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, spans array<array<int>>, kept binary")


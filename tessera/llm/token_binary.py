"""Binary token files: ids by rank of frequency, in byte-aligned variable-length coding with separate control bytes.

All ids of the corpus are counted and ranked, so that frequent ids get small numbers. A number takes one to four bytes;
its size less one is two bits of a control byte, which serves four numbers. Control bytes and data bytes stand apart, so
numpy decodes a file whole: a table gives the four sizes of every control byte, and running sums give where each number
starts.

A file holds consecutive documents in ascending doc_id order::

    magic "TVB1", documents (u4), ids (u8), control bytes (u8), data bytes (u8), ids of the part before this file (u8)
    doc_ids (i8 each), whether the doc_id is not null (u1 each), ids per document (u4 each), control bytes, data bytes

Each document's numbers start at a new control byte. Numbers are little-endian. Every task writes files of about
``file_ids`` ids into the shared folder under names of its own attempt, and the table of files holds only those of
attempts that ended well, so a lost executor leaves at most files that nothing names.

Texts are tokenized once and their ids are written, then counted; documents are dealt to parts by doc_id ranges whose
bounds come from quantiles over all documents, which spread any order of ids; what is shuffled is already coded. A
doc_id that fills several parts is a bound more than once, and its rows are dealt to those parts by a digest of their
ids; rows with a null doc_id likewise have parts of their own, before all others. There are at most ``MOST_PARTS`` parts,
so that the sketch of the quantiles has a bounded size; beyond that parts grow, and are written file by file. Only the
counts by id, bounded by the vocabulary, and one sum per part come to the driver.

Defined results: a null or empty text has the end id alone; a very long text is one row like any other, in a file of its
own if it alone is larger than a file; rows with equal doc_ids follow each other in the files, in the order of a digest of
their ids, and rows with a null doc_id come first; doc_id must be of an integer type, anything else is refused; other
columns are not read; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, scratch, written
from .tokens import encoded, highest_id

HEAD = struct.Struct("<4sIQQQQ")
MAGIC = b"TVB1"
#: At most so many parts, and so many entries in the sketch of their bounds.
MOST_PARTS, SKETCH = 10_000, 1_000_000
#: For each control byte the sizes of its four numbers.
SIZES = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_numbers(x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of documents with ``counts`` unsigned 32-bit numbers each, one after the
    other, and how many control bytes and data bytes each document has."""
    slots = -(-counts // 4) * 4
    top = int(x.max(initial=0))
    more = (x > 0xFF).astype(np.uint8)
    for k in (16, 24):
        if top >> k:
            more += x >> np.uint32(k) > 0
    padded = np.zeros(int(slots.sum()), np.uint8)
    shift = np.cumsum(slots) - slots - (np.cumsum(counts) - counts)
    padded[np.arange(len(x)) + np.repeat(shift, counts)] = more
    p = padded.reshape(-1, 4)
    size = 4 if top >> 16 else 2
    used = np.arange(size, dtype=np.uint8) <= more[:, None]
    upto, ends = np.concatenate(([0], np.cumsum(more, dtype=np.int64))), np.cumsum(counts)
    longer = upto[ends] - upto[ends - counts]
    return p[:, 0] | p[:, 1] << 2 | p[:, 2] << 4 | p[:, 3] << 6, x.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[used], slots // 4, counts + longer


def decode_numbers(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of documents with ``counts`` numbers, each from a new control byte, one after the other."""
    last = np.cumsum(-(-counts // 4) * 4)  # the slots after a document's numbers, up to the next control byte, are free
    kept = np.ones(4 * len(control), bool)
    for k in range(1, 4):
        kept[(last - k)[(-counts) % 4 >= k]] = False
    sizes = SIZES[control].ravel()[kept]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    out = data[at].astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    for k in range(1, int(sizes.max(initial=1))):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _pack_file(doc_ids: list, counts: list[int], controls: list[bytes], datas: list[bytes], before: int) -> bytes:
    control, data = b"".join(controls), b"".join(datas)
    head = HEAD.pack(MAGIC, len(counts), sum(counts), len(control), len(data), before)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    return b"".join((head, ids, known, np.array(counts, "<u4").tobytes(), control, data))


def read_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids per document, the numbers of all, and how many ids of the part stand before."""
    magic, n, n_ids, n_control, n_data, before = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    doc_ids = np.frombuffer(raw, "<i8", n, at).tolist()
    known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    control = np.frombuffer(raw, np.uint8, n_control, at)
    data = np.frombuffer(raw, np.uint8, n_data, at + n_control)
    numbers = decode_numbers(control, data, counts)
    if len(numbers) != n_ids:
        raise ValueError("token file is incomplete")
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], counts, numbers, before


def binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow column whose values have ``sizes`` bytes of ``data``, one after the other."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a column of bytes without nulls, one after the other, and how many each value has."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(0, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    values = np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]].view(kind)
    return values, np.diff(at) // values.itemsize


TOKENS = "doc_id long, ids binary, seen binary"


def token_ids(docs: DataFrame, tokenizer: str, end_id: int, kind: str = "<u4", remembered: int = 600_000) -> DataFrame:
    """(doc_id, ids, seen): ids with the end id as bytes, each id a number of numpy's ``kind``. The first row of a batch
    also has how often the batch has each id, as pairs (id, n) of eight bytes each."""

    def rows(batches):
        for batch in batches:
            found = [ids for _, ids in encoded(batch, "text", tokenizer, end_id, remembered)]
            x = np.frombuffer(b"".join(found), "<u4")
            total = np.bincount(x)
            some = np.flatnonzero(total)
            seen = [np.stack((some, total[some]), axis=1).astype("<i8").tobytes()] + [None] * (len(batch) - 1)
            small = x.astype(kind).view(np.uint8)
            sizes = np.array([len(ids) for ids in found], np.int64) // 4 * np.dtype(kind).itemsize
            arrays = [batch.column("doc_id"), binary(small, sizes), pa.array(seen[: len(batch)], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "seen"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(rows, TOKENS)


def id_counts(tokens: DataFrame) -> DataFrame:
    """(id, n) over all rows of ``token_ids``; reads the counts alone."""

    def rows(batches):
        for batch in batches:
            for seen in batch.column("seen"):
                pairs = np.frombuffer(seen.as_buffer(), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["id", "n"])

    found = tokens.select("seen").where("seen is not null").mapInArrow(rows, "id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def part_of(ids: np.ndarray, known: np.ndarray, digest: np.ndarray, bounds: np.ndarray, null_parts: int) -> np.ndarray:
    """The part of each row. Ids above one bound and up to the next are a part; the rows of an id that is several bounds
    are dealt to their parts in the order of ``digest`` (31 bits). Rows without an id have the first ``null_parts``."""
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    low = low + (digest * np.maximum(high - low, 1) >> 31)
    return np.where(known, low + null_parts, digest * null_parts >> 31).astype(np.int32)


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, part_ids: int = 8_000_000, file_ids: int = 2_000_000) -> tuple[DataFrame, np.ndarray]:
    """Write the token files of ``docs`` (doc_id, text) under ``path``. Returns the table of files (part, path, n_ids)
    and the ids by rank."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be of an integer type")
    spark = docs.sparkSession
    held, kind = scratch(spark, "token-ids"), "<u4" if max(highest_id(tokenizer), end_id) > 0xFFFF else "<u2"
    token_ids(docs, tokenizer, end_id, kind).write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "1"}).parquet(held)
    tokens = spark.read.schema(TOKENS).parquet(held)
    counts = id_counts(tokens).orderBy(F.desc("n"), "id").collect()
    by_rank = np.array([r.id for r in counts], np.uint32)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank))
    parts = min(MOST_PARTS, max(1, -(-sum(r.n for r in counts) // part_ids)))
    shares = [k / parts for k in range(1, parts)]
    found = tokens.agg(
        F.percentile_approx("doc_id", shares, min(SKETCH, 100 * parts)) if shares else F.lit(None), F.count("*"), F.count_if(F.col("doc_id").isNull())
    ).first()
    bounds = np.array(sorted(found[0] or []), np.int64)
    null_parts = -(-found[2] * parts // max(found[1], 1))
    ranks = spark.sparkContext.broadcast(rank)

    def code(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            part = part_of(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("digest").to_numpy(), bounds, null_parts)
            numbers, n = flat(batch.column("ids"), kind)
            control, data, n_control, n_data = encode_numbers(ranks.value[numbers], n)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("digest"), pa.array(part), pa.array(n), binary(control, n_control), binary(data, n_data)],
                ["doc_id", "digest", "part", "n", "control", "data"],
            )

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        task, files = TaskContext.get(), 0
        part, before, held, n = None, 0, [], 0

        def close():
            nonlocal files, before, held, n
            name = f"{root}/part-{part:06d}-{files:06d}-{task.attemptNumber()}-{uuid.uuid4().hex}.tvb"
            with store.open_output_stream(name) as f:
                f.write(_pack_file(*map(list, zip(*held, strict=True)), before))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n])], ["part", "path", "n_ids"])
            files, before, held, n = files + 1, before + n, [], 0
            return row

        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("control"), batch.column("data"), strict=True):
                if held and (n >= file_ids or row[0] != part):
                    yield close()
                if row[0] != part:
                    part, before = row[0], 0
                held.append((row[1], row[2], row[3].as_py(), row[4].as_py()))
                n += row[2]
        if held:
            yield close()

    digest = F.shiftrightunsigned(F.xxhash64("ids"), 33).alias("digest")
    coded = tokens.select("doc_id", "ids", digest).mapInArrow(code, "doc_id long, digest long, part int, n long, control binary, data binary")
    dealt = coded.repartitionById(len(bounds) + 1 + null_parts, F.col("part")).sortWithinPartitions("part", "doc_id", "digest")
    files = written(dealt.mapInArrow(write, "part int, path string, n_ids long"), "token-files")
    drop(spark, held)
    return files, by_rank


def read_files(files: DataFrame, path: str, by_rank: np.ndarray, digests: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's ids as unsigned little-endian 32-bit integers, from the files. With
    ``digests`` their CRC-32 stands for the ids (doc_id, start, n_tokens, ids_crc32)."""
    spark = files.sparkSession
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, at = {}, 0
    for part in sorted(totals):
        bases[part] = at
        at += totals[part]
    vocabulary = spark.sparkContext.broadcast((by_rank.astype("<u4"), bases))
    last = "ids_crc32" if digests else "ids"

    def rows(batches):
        store, _ = fs.FileSystem.from_uri(path)
        ids, base = vocabulary.value
        for batch in batches:
            for part, name in zip(batch.column("part").to_pylist(), batch.column("path").to_pylist(), strict=True):
                with store.open_input_stream(name) as f:
                    doc_ids, counts, numbers, before = read_file(f.read())
                ends = np.cumsum(counts)
                starts = ends - counts
                found = ids[numbers]
                if digests:
                    out = pa.array([zlib.crc32(found[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    out = binary(found.view(np.uint8), 4 * counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + before + base[part]), pa.array(counts), out], ["doc_id", "start", "n_tokens", last]
                )

    spread = files.select("part", "path").repartition(max(1, len(totals)), "path")
    return spread.mapInArrow(rows, f"doc_id long, start long, n_tokens long, {last} {'long' if digests else 'binary'}")

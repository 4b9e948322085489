"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits: a bit is 1 if it is set in more than half of the hashes of the text's word shingles. Two
fingerprints link if they differ in at most ``radius`` bits. For radius r each bit position gets a vector of r + 1 bits
other than zero, and each of the 2^(r+1) - 1 vectors v gives a table, which hashes a fingerprint to its bits at the
positions whose vector has an odd inner product with v. For any r positions some v is orthogonal to all of their
vectors, so two fingerprints that differ there only agree in that table: no linked pair is missed.

Equal fingerprints are one row before anything is compared. Buckets with one fingerprint go at once. A bucket of at most
``pairs_up_to`` fingerprints is compared pair by pair. In a fuller one each fingerprint stands for itself and, if the
radius is 2, for itself with any one of the table's hidden bits flipped; fingerprints that meet in such a variant differ
in at most 2 bits, all that differ in at most 2 do meet, and no variant has more members than hidden bits and one. So
hot buckets cost rows in proportion to their size, and nothing is capped.

Defined results: a null or empty text, or one without words, has fingerprint 0, which links like any other; texts of
fewer words than a shingle are one shingle; repeated rows share a fingerprint; rows with a null id get the component of
their fingerprint; a very long text costs time and memory in proportion to its words; other columns are not read; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, shuffled, written
from .components import components

BITS = 64
SLICE = 200_000


def text_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of the shingles of ``text``, repeats included; only A-Z are lower-cased."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) < words:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)] if found else []
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(x), seed) for x in zip(*(found[i:] for i in range(words)), strict=False)]


def majorities(hashes: list[list[int]]) -> np.ndarray:
    """For each list the 64 bits that are set in more than half of its hashes, as signed integers."""
    sizes = np.array([len(x) for x in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.fromiter((h for x in hashes for h in x), np.uint64, int(sizes.sum()))
        bits = np.unpackbits(flat.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
        set_in = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        most = (2 * set_in > sizes[some, None]).astype(np.uint8)
        out[some] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def rows(batches):
        for batch in batches:
            fps, held, n = [], [], 0
            for t in batch.column(1):
                held.append(text_hashes(t.as_py(), words, seed))
                n += len(held[-1])
                if n > SLICE:
                    fps.append(majorities(held))
                    held, n = [], 0
            fps.append(majorities(held))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps))], ["doc_id", "fp"])

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(rows, f"doc_id {dict(source.dtypes)['doc_id']}, fp long")


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def masks(radius: int) -> list[int]:
    """The bits that each table of the covering family looks at, as signed longs."""
    n = 2 ** (radius + 1) - 1
    out = []
    for v in range(1, n + 1):
        m = sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() % 2)
        out.append(signed(m))
    return out


def links(fps: DataFrame, radius: int = 2, pairs_up_to: int = 64) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` that connect all that differ in at most ``radius`` bits. Each
    returned pair itself differs in at most that many bits."""
    if not 0 <= radius <= 2:
        raise ValueError("crowded buckets are split exactly for a radius of at most 2")
    tables = fps.select("fp").distinct().select(
        "fp",
        F.explode(
            F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks(radius))))
        ).alias("t"),
    ).select("fp", "t.k", "t.key")
    sizes = tables.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(tables.join(shuffled(sizes), ["k", "key"]), "buckets")
    few = shared.where(F.col("n") <= pairs_up_to).select("k", "key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = (
        few.withColumnRenamed("fp", "a")
        .join(shuffled(few.withColumnRenamed("fp", "b")), ["k", "key"])
        .where((F.col("a") > F.col("b")) & near)
        .select("a", "b")
    )
    unseen = [[signed(1 << i) for i in range(BITS) if not m >> i & 1] for m in masks(radius)]
    hidden = F.create_map(*(x for k, bits in enumerate(unseen) for x in (F.lit(k), F.array(*map(F.lit, bits)))))
    meeting = (
        shared.where(F.col("n") > pairs_up_to)
        .select("k", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), hidden[F.col("k")])).alias("flip"))
        .groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .where("a > b")
        .where(near)
        .select("a", "b")
    )
    return pairs.union(meeting)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest id that is reachable over links, its own included."""
    fps = written(fingerprints(docs, doc_id, text, words), "fingerprints")
    first = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "known")
    roots = components(links(fps, radius)).withColumnRenamed("node", "fp")
    linked = written(roots.join(shuffled(first.drop("n")), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("least_id"))
    classes = linked.join(shuffled(least), "root").select("fp", "least_id")
    known = first.join(shuffled(classes), "fp", "left").select("fp", "n", F.coalesce("least_id", "first_id").alias("component_id"))
    return join_counted(fps, written(known, "named"), "fp").select("doc_id", "fp", "component_id")

"""Near copies: the SimHash search on five-word shingles, widened to a similarity of sets of shingles.

Texts first meet in the covering tables of ``simhash``: fingerprints of their shingles that differ in at most 2 bits. Few
texts of similarity 0.8 are that close, so each text also gets the minima of ``BANDS`` x ``ROWS`` hash functions over its
set of shingles, and texts meet in a bucket if all minima of a band agree, which texts of similarity 0.8 miss in all bands
with a chance of (1 - 0.8^5)^24, or 0.00007. Whoever meets is compared by the sets themselves, so each link is exact.

Equal sets are one node before anything meets. In each bucket all nodes are compared with one leader, which makes one
component of most groups of copies for rows in proportion to their size. Crowded buckets that still hold several components
then take as leader the node whose shingles most of the others have. Last, nodes in different components are compared: in buckets of at most
``CROWDED`` nodes all pairs, and the nodes of crowded ones where their sets share one of their rarest shingles and their
sketches are near, as those of all of the wanted similarity are. Pairs within one component cannot change it. Nothing is capped.

Defined results: a null or empty text, or one without words, has the empty set, which equals only itself; texts of fewer
words than a shingle are one shingle; a very long text costs time and memory in proportion to its words; rows with a null
id connect others but name no component; other columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, shuffled, text_of, written
from .components import components
from .simhash import SLICE, links, majorities, text_hashes

BANDS, ROWS = 24, 5
CROWDED = 64
#: Shingles of a crowd whose counts come to the driver, at most.
FREQUENT = 100_000
#: Words of 64 bits in a sketch of a set.
SKETCH = 8
#: Of each hash function what is added, and its odd factor.
_random = np.random.default_rng(7)
ADDED, FACTORS = (_random.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
FACTORS |= np.uint64(1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, which must not be empty, a signed key per band."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    minima = np.empty((len(sets), BANDS * ROWS), "<u8")
    for k in range(BANDS * ROWS):
        x = (flat ^ ADDED[k]) * FACTORS[k]
        minima[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    of = lambda row: [xxhash.xxh64_intdigest(row[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array([of(row) for row in minima], np.uint64).view(np.int64)


def text_digest() -> Column:
    """What tells the texts of a table apart; a null is the empty text."""
    return F.unhex(F.sha2(text_of(), 256))


def _sliced(batch, words: int, seed: int):
    """(first row, lists of shingle hashes, sets of them) of slices of a batch's texts."""
    lists, first, n = [], 0, 0
    for k, t in enumerate(batch.column("text")):
        lists.append(text_hashes(t.as_py(), words, seed))
        n += len(lists[-1])
        if n > SLICE or k + 1 == len(batch):
            yield first, lists, [np.unique(np.array(x, np.uint64)) for x in lists]
            lists, first, n = [], k + 1, 0


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())


def shingle_keys(docs: DataFrame, words: int, seed: int = 42) -> DataFrame:
    """(doc_id, sha, node, fp, keys) of each row of ``docs`` (doc_id, text): the digest of its text, a digest of its set of
    shingles, their SimHash fingerprint, and the keys of its bands."""

    def rows(batches):
        for batch in batches:
            for first, lists, held in _sliced(batch, words, seed):
                some = [x for x in held if len(x)]
                found = iter(band_keys(some) if some else [])
                columns = [
                    batch.column("doc_id").slice(first, len(held)),
                    batch.column("sha").slice(first, len(held)),
                    _nodes(held),
                    pa.array(majorities(lists)),
                    pa.array([next(found) if len(x) else [] for x in held], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sha", "node", "fp", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    source = docs.select("doc_id", text_digest().alias("sha"), "text")
    return source.mapInArrow(rows, f"doc_id {kind}, sha binary, node binary, fp long, keys array<long>")


def sketch(x: np.ndarray) -> np.ndarray:
    """``SKETCH`` words of bits, each the parity of the shingles that fall on it. Two sketches differ in at most as many bits
    as shingles are in one of the sets alone."""
    odd = np.bincount((x % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def shingle_sets(docs: DataFrame, words: int, chosen: DataFrame, seed: int = 42) -> DataFrame:
    """(node, hashes, bits) of the texts whose digests ``chosen`` (sha) has: their sets of shingles and the sets' sketches.
    Sets are made again from the texts and not kept from the search for candidates: they are larger than the texts."""

    def rows(batches):
        for batch in batches:
            for _, _, held in _sliced(batch, words, seed):
                sets = pa.array([x.view(np.int64) for x in held], pa.list_(pa.int64()))
                bits = pa.array([sketch(x) for x in held], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([_nodes(held), sets, bits], ["node", "hashes", "bits"])

    texts = docs.select(text_digest().alias("sha"), text_of().alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    return texts.join(shuffled(chosen), "sha", "left_semi").mapInArrow(rows, "node binary, hashes array<long>, bits array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, fifths: int) -> DataFrame:
    """Those of ``pairs`` (a, b and other columns) whose sets have a similarity of at least ``fifths`` / 5."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("hashes").alias(f"in_{c}"))
    both = pairs.join(shuffled(of("a")), "a").join(shuffled(of("b")), "b")
    total, common = F.size("in_a") + F.size("in_b"), F.size(F.array_intersect("in_a", "in_b"))
    return both.where(common * (5 + fifths) >= total * fifths).select(*pairs.columns)


#: Two nodes and the components that they are known to be in.
PAIR = ["a", "b", "a_root", "b_root"]


def _ordered(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def simhash_pairs(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp) that connect all whose fingerprints differ in at most ``radius`` bits."""
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "heads")
    same = join_counted(nodes, heads, "fp").where("node <> head").select(*_ordered("node", "head"))
    of = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"at_{c}"))
    near = links(heads.select("fp"), radius).join(shuffled(of("a")), "a").join(shuffled(of("b")), "b")
    return same.union(near.select(*_ordered("at_a", "at_b"))).distinct()


def frequent(crowd: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of shingles of ``crowd`` (node, hashes) that are more than a ``FREQUENT``-th of all its shingles, so
    no more than ``FREQUENT`` of them, sorted by hash. Tasks count their batches first, and a shingle that a batch holds once is not
    counted there: counts only order shingles, and any order finds the same pairs."""

    def rows(batches):
        for batch in batches:
            held, n = np.unique(batch.column("hashes").flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held[n > 1].astype(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["h", "n"])

    total = crowd.agg(F.sum(F.size("hashes"))).first()[0] or 0
    counted = crowd.select("hashes").mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > max(1, total // FREQUENT)).collect()
    hashes, counts = np.array([r.h for r in found], np.int64), np.array([r.n for r in found], np.int64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def _counts(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each shingle how often it is counted among the common ones, 0 if it is none."""
    known, counts = common
    if not len(known):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, counts[at], 0)


def centrality(crowd: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(node, central): the mean count of a node's shingles, higher where more of the others have them."""

    def rows(batches):
        for batch in batches:
            found = [float(_counts(np.array(x.values), common).mean()) if len(x.values) else 0.0 for x in batch.column("hashes")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.float64())], ["node", "central"])

    return crowd.select("node", "hashes").mapInArrow(rows, "node binary, central double")


def prefix_pairs(nodes: DataFrame, crowd: DataFrame, common: tuple[np.ndarray, np.ndarray], fifths: int) -> DataFrame:
    """Pairs (a, b, a_root, b_root) of ``nodes`` (node, root) with different roots, among them all of a similarity of at
    least ``fifths`` / 5; ``crowd`` has their sets and sketches. Of two such sets, both sorted from the rarest shingle on (those that are
    not common first, by hash), the first ones have one in common, as many as a set can lack and one more; from the first one in
    common on both have enough left; and their sketches differ in no more bits than the sets may differ in shingles, which few
    others pass."""
    words = [f"bits_{k}" for k in range(SKETCH)]

    def rows(batches):
        names = ["h", "node", "root", "size", "left"]
        for batch in batches:
            owner, h, size, left = [], [], [], []
            for k, x in enumerate(batch.column("hashes")):
                held = np.array(x.values)
                most = len(held) - -(-len(held) * fifths // 5) + 1
                order = np.lexsort((held, _counts(held, common)))[:most]
                owner.append(np.full(len(order), k))
                h.append(held[order])
                size.append(np.full(len(order), len(held)))
                left.append(len(held) - np.arange(len(order)))
            at = pa.array(np.concatenate(owner or [np.zeros(0, np.int64)]).astype(np.int64))
            flat = [pa.array(np.concatenate(c or [np.zeros(0, np.int64)]).astype(np.int64)) for c in (h, size, left)]
            yield pa.RecordBatch.from_arrays([flat[0], *(batch.column(c).take(at) for c in ("node", "root")), *flat[1:], *(batch.column(w).take(at) for w in words)], names + words)

    sketched = crowd.join(shuffled(nodes), "node").select("node", "root", "hashes", *(F.col("bits")[k].alias(w) for k, w in enumerate(words)))
    schema = "h long, node binary, root binary, size long, left long, " + ", ".join(f"{w} long" for w in words)
    prefix = written(sketched.mapInArrow(rows, schema), "prefixes")
    of = lambda c: prefix.select("h", *(F.col(x).alias(f"{c}_{x}") for x in ("node", "root", "size", "left", *words)))
    near = (5 + fifths) * F.least("x_left", "y_left") >= fifths * (F.col("x_size") + F.col("y_size"))
    apart = sum((F.bit_count(F.col(f"x_{w}").bitwiseXOR(F.col(f"y_{w}"))) for w in words), F.lit(0))
    near &= (5 + fifths) * apart <= (5 - fifths) * (F.col("x_size") + F.col("y_size"))
    near &= (F.col("x_root") != F.col("y_root")) & (F.col("x_node") > F.col("y_node"))
    columns = zip(("x_node", "y_node", "x_root", "y_root"), PAIR, strict=True)
    return of("x").join(shuffled(of("y")), "h").where(near).select(*(F.col(x).alias(c) for x, c in columns)).distinct()


def near_copies(docs: DataFrame, words: int = 5, fifths: int = 4) -> DataFrame:
    """(doc_id, sha, component_id, stays) for each row: the digest of its text, the smallest id that is reachable over
    links, its own included, and whether the row stands for its component: of the rows with that id those with the
    smallest digest. Texts link if their sets of shingles of ``words`` words have a similarity of at least ``fifths`` / 5.
    Components of different texts with one id have the same component_id, and each has a row that stays."""
    rows = written(shingle_keys(docs, words), "keys")
    known = rows.groupBy("node").agg(
        F.min("fp").alias("fp"), F.min("sha").alias("sha"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "sha"))).alias("first"), F.count("*").alias("n")
    )
    known = written(known, "known")
    members = rows.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key")).distinct()
    members = written(members, "members")
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(shuffled(sizes), "key"), "buckets")
    seeds = written(simhash_pairs(known.select("node", "fp")), "seeds")
    met = shared.select("node").union(seeds.select("a")).union(seeds.select("b")).distinct()
    sets = written(shingle_sets(docs, words, known.join(shuffled(met), "node").select("sha")), "met")

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """``roots`` (node, root) once the alike ones of ``pairs`` are links: components of the roots, not of all nodes."""
        found = _alike(pairs.distinct(), sets, fifths).select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        tops = components(found).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return written(roots.join(shuffled(tops), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")

    def several(roots: DataFrame) -> DataFrame:
        """The members of buckets that hold several components."""
        x = shared.join(shuffled(roots), "node")
        some = x.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
        return written(x.join(shuffled(some), "key"), "open")

    def to_leaders(x: DataFrame, rank: Column) -> DataFrame:
        best = x.groupBy("key").agg(F.max(F.struct(rank.alias("r"), "node", "root")).alias("leader"))
        led = x.join(shuffled(best), "key").where("root <> leader.root")
        return led.select(F.col("node").alias("a"), F.col("leader.node").alias("b"), F.col("root").alias("a_root"), F.col("leader.root").alias("b_root"))

    alone = sets.select("node", F.col("node").alias("root"))
    led = to_leaders(shared.withColumn("root", F.col("node")), F.xxhash64("node"))
    roots = joined(alone, led.union(seeds.select("a", "b", "a", "b")))
    still = several(roots)
    crowd = lambda: still.where(F.col("n") > CROWDED)
    crowded = written(sets.join(shuffled(crowd().select("node").distinct()), "node"), "crowd")
    common = frequent(crowded)
    central = written(centrality(crowded, common), "central")
    roots = joined(roots, to_leaders(crowd().join(shuffled(central), "node", "left"), F.col("central")))
    still = several(roots)
    few = still.where(F.col("n") <= CROWDED)
    a, b = (few.select("key", F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    rest = a.join(shuffled(b), "key").where("a_root <> b_root and a > b").select(*PAIR)
    roots = joined(roots, rest.union(prefix_pairs(crowd().select("node", "root").distinct(), crowded, common, fifths)))
    linked = written(roots.join(shuffled(known.drop("n", "sha")), "node"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = linked.join(shuffled(least), "root").select("node", "least")
    named = written(known.join(shuffled(classes), "node", "left").select("node", "n", F.coalesce("least", "first").alias("of")), "named")
    stays = (F.col("doc_id") == F.col("of.doc_id")) & (F.col("sha") == F.col("of.sha"))
    return join_counted(rows.select("doc_id", "sha", "node"), named, "node").select(
        "doc_id", "sha", F.col("of.doc_id").alias("component_id"), F.coalesce(stays, F.lit(False)).alias("stays")
    )

"""Provenance of versions: what each was made of, sealed so that a later change is named by version and path.

A version's artifacts (path and digest) are folded to one root, its seal is the digest of the root, its directive, its
replacement and the seal of the version before it, so versions of a project form a chain. ``verified`` recomputes all of
it from what is stored now and names what differs; what follows a broken version is derived from it and named as such.

The fold is a tree over artifacts in the order of their paths: a round joins up to ``FAN`` neighbours, so no task or row holds a
large version's artifacts, however many it has, and there are as many rounds as the largest version has digits in base ``FAN``.
A version with at most ``FAN`` artifacts is one row, folded and compared where its artifacts already lie together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources.shared import checkpointed

FAN = 1_000
#: The root of a version without artifacts.
NO_ROOT = hashlib.sha256(b"").hexdigest()
PROBLEM_ROWS = "array<struct<path:string,problem:string>>"
PROBLEMS = (
    "manifest changed",
    "artifact changed",
    "artifact missing",
    "artifact added",
    "directive changed",
    "replacement changed",
    "seal changed",
    "parent is another",
    "derived from a broken version",
)


def leaf(path: Column, digest: Column) -> Column:
    """The digest of an artifact at its path; the path's length keeps the two apart."""
    return F.sha2(F.concat(F.octet_length(path).cast("string"), F.lit(":"), path, F.coalesce(digest, F.lit(""))), 256)


def packed(text: Column) -> Column:
    """A text as bytes, a digest in half as many; different texts stay different."""
    return F.when(text.rlike(r"^[0-9a-f]{64}\z"), F.concat(F.lit(b"\1"), F.unhex(text))).otherwise(F.concat(F.lit(b"\0"), text.cast("binary")))


def split(fan: int, *tables: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Each table's artifacts of versions with at most ``fan`` in every table, and those of versions with more; the second
    list is empty if there are none."""
    named = [t.where("version_id is not null") for t in tables]
    many = checkpointed(reduce(DataFrame.unionByName, (t.groupBy("version_id").count().where(F.col("count") > fan).select("version_id") for t in named)).distinct())
    if many.isEmpty():
        return named, []
    return [t.join(many, "version_id", "left_anti") for t in named], [t.join(many, "version_id", "left_semi") for t in named]


def held(few: DataFrame, digests: bool = True) -> DataFrame:
    """(version_id, held) of versions with few artifacts: these in order, each with its path, leaf and, if ``digests``, digest. Rows
    that lie together by version are not shuffled again."""
    row = F.struct("path", F.unhex(leaf(F.col("path"), F.col("digest"))).alias("h"), *["digest"] * digests)
    return few.groupBy("version_id").agg(F.array_sort(F.collect_list(row)).alias("held"))


def _root_of_held() -> Column:
    h = F.transform("held", lambda x: F.lower(F.hex(x["h"])))
    return F.when(F.size("held") == 1, h[0]).otherwise(F.sha2(F.array_join(h, ""), 256))


def _rounds(many: DataFrame, fan: int) -> DataFrame:
    rows = many.select("version_id", "path", leaf(F.col("path"), F.col("digest")).alias("h"))
    placed = scan.scanned(rows, "version_id", ["path", "h"], scan.Wanted(number="at"))
    level = checkpointed(placed.select("version_id", (F.col("at") - 1).alias("at"), "h"))
    counts = level.groupBy("version_id").agg(F.count("*").alias("n"))
    while level.where("at > 0").limit(1).count():
        up = level.groupBy("version_id", F.floor(F.col("at") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "h"))).alias("held"))
        joined = F.when(F.size("held") == 1, F.col("held")[0]["h"]).otherwise(F.sha2(F.array_join(F.transform("held", lambda x: x["h"]), ""), 256))
        level = checkpointed(up.select("version_id", F.col("up").alias("at"), joined.alias("h")))
    return level.select("version_id", F.col("h").alias("root")).join(counts, "version_id")


def roots(artifacts: DataFrame, fan: int = FAN) -> DataFrame:
    """(version_id, root, n) of artifacts (version_id, path, digest): digests of at most ``fan`` digests in order, in one
    aggregation for versions with no more artifacts, in rounds for the others."""
    few, many = split(fan, artifacts)
    found = held(few[0], digests=False).select("version_id", _root_of_held().alias("root"), F.size("held").cast("long").alias("n"))
    return found.unionByName(_rounds(many[0], fan)) if many else found


def text_digest(column: str) -> Column:
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def sealed(versions: DataFrame, manifest: DataFrame, fan: int = FAN) -> DataFrame:
    """``versions`` (project_id, number, version_id, directive, replacement) with root, n_artifacts, directive_hash,
    replacement_hash, parent_seal (null for a project's first) and seal. The versions of a project are read in order of their
    numbers, one at a time."""
    x = versions.join(roots(manifest, fan), "version_id", "left").select(
        *versions.columns, F.unhex(F.coalesce("root", F.lit(NO_ROOT))).alias("root"), F.coalesce("n", F.lit(0)).cast("long").alias("n_artifacts")
    )
    # digests of texts are made, and that of the root is written out, after rows have been dealt
    x = x.repartition("project_id").select(
        *versions.columns,
        F.lower(F.hex("root")).alias("root"),
        "n_artifacts",
        text_digest("directive").alias("directive_hash"),
        text_digest("replacement").alias("replacement_hash"),
    )
    parts = ("root", "directive_hash", "replacement_hash")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, seal = None, None
        for batch in batches:
            parents, seals = [], []
            for k, *held in zip(batch.column("project_id").to_pylist(), *(batch.column(c).to_pylist() for c in parts), strict=True):
                if project != (k,):
                    project, seal = (k,), None
                parents.append(seal)
                seal = hashlib.sha256("".join((seal or "", *held)).encode()).hexdigest()
                seals.append(seal)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parents, pa.string()), pa.array(seals, pa.string())], [*batch.schema.names, "parent_seal", "seal"])

    schema = ", ".join(f"`{c}` {t}" for c, t in x.dtypes)
    return x.sortWithinPartitions("project_id", "number", "version_id").mapInArrow(rows, f"{schema}, parent_seal string, seal string")


def _once() -> Column:
    """Of what is held under equal paths the first."""
    return F.filter("held", lambda x, i: (i == 0) | ~x["path"].eqNullSafe(F.get("held", i - 1)["path"]))


def _of_path(path: Column, problem: Column | str) -> Column:
    return F.struct(path.cast("string").alias("path"), (F.lit(problem) if isinstance(problem, str) else problem).alias("problem"))


def _differences() -> Column:
    """The problems of artifacts, from ``_both``: what was and what is in order of paths, so equal paths are neighbours."""
    other = lambda y, x, side: F.coalesce((y["side"] == side) & y["path"].eqNullSafe(x["path"]), F.lit(False))

    def one(x: Column, i: Column) -> Column:
        after, before = F.get("_both", i + 1), F.get("_both", i - 1)
        changed = F.when(~after["digest"].eqNullSafe(x["digest"]), _of_path(x["path"], "artifact changed"))
        of_was = F.when(other(after, x, 1), changed).otherwise(_of_path(x["path"], "artifact missing"))
        return F.when(x["side"] == 0, of_was).when(~other(before, x, 0), _of_path(x["path"], "artifact added"))

    return F.coalesce(F.array_compact(F.transform("_both", one)), F.array().cast(PROBLEM_ROWS))


def verified(versions: DataFrame, manifest: DataFrame, artifacts: DataFrame, fan: int = FAN) -> DataFrame:
    """(project_id, version_id, path, problem) of everything that is not as it was sealed, with one of ``PROBLEMS``; the
    path is null for what concerns a version. ``versions`` is as ``sealed`` gives it, with its directive and replacement as
    they are now, ``manifest`` (version_id, path, digest) is what was sealed, and ``artifacts`` what is there now.

    Equal paths of a version count once each way; a null digest is its own value. Versions without a problem give no row.
    Artifacts of a version are compared in one row if it has at most ``fan``, else by path."""
    told = F.sha2(F.concat(F.coalesce("parent_seal", F.lit("")), "root", "directive_hash", "replacement_hash"), 256)
    # what a version tells by itself is judged before anything is kept or shuffled
    alone = {
        "directive changed": text_digest("directive") != F.col("directive_hash"),
        "replacement changed": text_digest("replacement") != F.col("replacement_hash"),
        "seal changed": told != F.col("seal"),
    }
    named = lambda checks: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items())))
    own = ["project_id", "number", "version_id"]
    base = checkpointed(versions.select(*own, *(packed(F.col(c)).alias(c) for c in ("root", "parent_seal", "seal")), named(alone).alias("_found")))
    few, many = split(fan, manifest, artifacts)
    was = held(few[0]).select("version_id", _root_of_held().alias("_root"), _once().alias("_was"))
    now = held(few[1]).select("version_id", _once().alias("_is"))
    x = base.join(was, "version_id", "left").join(now, "version_id", "left").withColumn("_many", F.lit(False))
    if many:
        of_many = checkpointed(_compared(*many))
        x = x.join(_rounds(many[0], fan).select("version_id", F.col("root").alias("_root_of_many")), "version_id", "left")
        x = x.join(of_many.select("version_id", F.lit(True).alias("_of_many")).distinct(), "version_id", "left")
        x = x.withColumns({"_root": F.coalesce("_root", "_root_of_many"), "_many": F.col("_of_many").isNotNull()})
    x = x.withColumn("_found", F.concat("_found", named({"manifest changed": packed(F.coalesce("_root", F.lit(NO_ROOT))) != F.col("root")})))
    sided = lambda c, side: F.coalesce(F.transform(c, lambda y: F.struct(y["path"], F.lit(side).alias("side"), y["digest"])), F.array().cast(_sided(x, c)))
    x = x.withColumn("_both", F.when(~F.col("_was").eqNullSafe(F.col("_is")), F.array_sort(F.concat(sided("_was", 0), sided("_is", 1)))))
    x = x.select(*own, "parent_seal", "seal", "_found", "_many", _differences().alias("_paths"))
    before = scan.scanned(x, "project_id", own[1:], scan.Wanted(lags={"_before": F.col("seal")}), counted=base)
    of_version = F.concat("_found", named({"parent is another": ~F.col("parent_seal").eqNullSafe(F.col("_before"))}))
    found = before.select(*own, "_many", F.concat(F.transform(of_version, lambda p: _of_path(F.lit(None), p)), "_paths").alias("_found"))
    flagged = found.withColumn("_broken", (F.col("version_id").isNotNull() & (F.col("_many") | (F.size("_found") > 0))).cast("long"))
    counted = scan.scanned(flagged, "project_id", own[1:], scan.Wanted(sums={"_so_far": F.col("_broken")}), counted=base)
    derived = F.when(F.col("_so_far") > F.col("_broken"), F.array(_of_path(F.lit(None), PROBLEMS[-1]))).otherwise(F.array().cast(PROBLEM_ROWS))
    rows = counted.where("version_id is not null").select("project_id", "version_id", F.explode(F.concat("_found", derived)).alias("p")).select("project_id", "version_id", "p.path", "p.problem")
    return rows.unionByName(of_many.join(base.select("project_id", "version_id"), "version_id").select(*rows.columns)) if many else rows


def _sided(x: DataFrame, column: str) -> str:
    kind = {f.name: f.dataType for f in x.schema[column].dataType.elementType.fields}
    return f"array<struct<path:{kind['path'].simpleString()},side:int,digest:{kind['digest'].simpleString()}>>"


def _compared(manifest: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(version_id, path, problem) of artifacts that differ, by a join on their paths."""
    first = F.min(F.struct(leaf(F.col("path"), F.col("digest")), "digest"))["digest"]
    a = manifest.groupBy("version_id", "path").agg(F.struct(first.alias("digest")).alias("was"))
    b = artifacts.groupBy("version_id", "path").agg(F.struct(first.alias("digest")).alias("is"))
    same = F.col("a.version_id").eqNullSafe(F.col("b.version_id")) & F.col("a.path").eqNullSafe(F.col("b.path"))
    both = a.alias("a").join(b.alias("b"), same, "full_outer").select(F.coalesce("a.version_id", "b.version_id").alias("version_id"), F.coalesce("a.path", "b.path").alias("path"), "was", "is")
    why = F.when(F.col("is").isNull(), "artifact missing").when(F.col("was").isNull(), "artifact added").when(~F.col("was.digest").eqNullSafe(F.col("is.digest")), "artifact changed")
    return both.select("version_id", "path", why.alias("problem")).where("problem is not null")

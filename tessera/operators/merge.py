"""Findings and their parts merged by key: the first in order wins, lists are united in order of first sight.

Aggregates are combined before the shuffle where Spark can. United lists are made element by element: equal ones of a key
meet before anything is gathered, so what a key gathers is what its result holds, however many rows share it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T


def text_key(column: str) -> Column:
    """A digest of a text in NFKC with white space collapsed: what stands for it as a key, so that texts are not shuffled."""
    return F.unhex(F.sha2(T.collapse_ws(T.nfkc(column)), 256))


def dedup_key() -> list[Column]:
    """claim type, and digests of category and statement."""
    return [F.col("claim_type"), text_key("category"), text_key("statement")]


def first_of(df: DataFrame, keys: list[Column], order: str = "ord") -> DataFrame:
    """The first row of each key with ``n_rows``."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    rows = df.withColumns(named).groupBy(*named).agg(F.min_by(F.struct(*df.columns), order).alias("r"), F.count("*").alias("n_rows"))
    return rows.select("r.*", "n_rows")


def _united(rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """(keys, column): all elements of an array column, each once, by the rows' order and their places."""
    x = rows.select(*keys, F.col(order).alias("_o"), F.posexplode(column).alias("_p", "_x"))
    first = x.groupBy(*keys, "_x").agg(F.min(F.struct("_o", "_p")).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(f"_{column}"))


def _with_united(one: DataFrame, rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """``one``, a row per key, with ``_column``: the elements that the key's ``rows`` hold, an empty list if there are none."""
    other = _united(rows, keys, column, order).select(*(F.col(k).alias(f"_o{k}") for k in keys), F.col(f"_{column}").alias("_found"))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_o{k}")) for k in keys))
    none = F.array().cast(dict(rows.dtypes)[column])
    return one.join(other, same, "left").withColumn(f"_{column}", F.coalesce("_found", none)).drop("_found", *(f"_o{k}" for k in keys))


def merge_findings(findings: DataFrame, keys: list[Column] | None = None, order: str = "ord") -> DataFrame:
    """One finding per key: the first, with the citations and parents of all, each once, ``required_review`` if any needs
    it, and the revision records of all, one after the other."""
    named = {f"_k{i}": k for i, k in enumerate(keys or dedup_key())}
    x = findings.withColumns(named)
    revisions = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("revision_records") > 0, F.struct(order, "revision_records")))), lambda s: s["revision_records"]))
    rows = x.groupBy(*named).agg(F.min_by(F.struct(*findings.columns), order).alias("r"), F.bool_or("required_review").alias("_required_review"), revisions.alias("_revision_records"))
    united = ("source_anchors", "inference_parents")
    for column in united:
        rows = _with_united(rows, x, list(named), column, order)
    own = {c: F.col(f"_{c}") for c in (*united, "required_review", "revision_records")}
    return rows.select(*(own.get(c, F.col(f"r.{c}")).alias(c) for c in findings.columns))


def aliases(findings: DataFrame, keys: list[Column] | None = None, order: str = "ord") -> DataFrame:
    """(finding_id, canonical_id, conflict): the id of the first row of its key; a conflict if an id has several keys."""
    named = {f"_k{i}": k for i, k in enumerate(keys or dedup_key())}
    x = findings.withColumns(named)
    first = x.groupBy(*named).agg(F.min_by("finding_id", order).alias("canonical_id"))
    same = F.lit(True)
    for k in named:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"f.{k}"))
    return (
        x.alias("x")
        .join(first.alias("f"), same)
        .groupBy("x.finding_id")
        .agg(F.min("canonical_id").alias("canonical_id"), (F.count_distinct("canonical_id") > 1).alias("conflict"))
    )


STRUCTURE = ("subject", "action", "object", "condition", "frequency", "deadline", "strength", "responsibility", "exceptions", "shared_context")


def signature(columns: tuple[str, ...] = STRUCTURE) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def merge_requirements(requirements: DataFrame, alias: DataFrame, order: str = "ord") -> DataFrame:
    """One requirement per canonical finding: least confidence, manual if any is, citations united; ``conflict`` if their
    structures differ."""
    x = requirements.join(alias.select("finding_id", "canonical_id"), "finding_id", "left")
    x = x.withColumn("finding_id", F.coalesce("canonical_id", "finding_id")).drop("canonical_id")
    one = x.groupBy("finding_id").agg(
        F.min_by("requirement_id", order).alias("requirement_id"),
        F.min("confidence").alias("confidence"),
        F.bool_or("manual_verification_required").alias("manual_verification_required"),
        (F.count_distinct(signature()) > 1).alias("conflict"),
    )
    both = _with_united(one, x, ["finding_id"], "source_anchors", order).withColumnRenamed("_source_anchors", "source_anchors")
    return both.select("finding_id", "requirement_id", "confidence", "manual_verification_required", "source_anchors", "conflict")


def merge_relationships(relationships: DataFrame, alias: DataFrame) -> DataFrame:
    """Relationships by id with aliased ends; ``conflict`` if rows of an id differ."""
    to = alias.select(F.col("finding_id").alias("to_finding_id"), F.col("canonical_id").alias("_to"))
    x = relationships.join(to, "to_finding_id", "left").withColumn("to_finding_id", F.coalesce("_to", "to_finding_id")).drop("_to")
    ends = x.select("relationship_id", F.posexplode("from_finding_ids").alias("k", "finding_id")).join(alias, "finding_id", "left")
    ends = ends.groupBy("relationship_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("canonical_id", "finding_id").alias("i")))), lambda s: s["i"])).alias("_from"))
    x = x.join(ends, "relationship_id", "left").withColumn("from_finding_ids", F.coalesce("_from", "from_finding_ids")).drop("_from")
    rest = [c for c in x.columns if c != "relationship_id"]
    return x.groupBy("relationship_id").agg(*(F.first(c).alias(c) for c in rest), (F.count_distinct(F.to_json(F.struct(*rest))) > 1).alias("conflict"))


def expand_conflicts(requirements: DataFrame, order: str = "ord") -> DataFrame:
    """Requirements of a finding that differ in structure become variants: the n-th from the second on gets its finding's
    id with ``~atomic-n`` and a flag for review. Variants count in order of first sight."""
    first = requirements.groupBy("finding_id", signature().alias("_s")).agg(F.min(order).alias("_first"))
    rank = first.select("finding_id", "_s", "_first", F.expr("dense_rank() over (partition by finding_id order by _first)").alias("variant"))
    x = requirements.withColumn("_s", signature()).join(rank.drop("_first"), ["finding_id", "_s"]).drop("_s")
    late = F.col("variant") > 1
    return x.withColumns({"needs_review": late, "finding_id": F.when(late, F.concat("finding_id", F.lit("~atomic-"), F.col("variant"))).otherwise(F.col("finding_id"))})


def diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): retained, replaced, removed or added, by all columns of equal names."""
    value = lambda d: F.sha2(F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}), 256)
    b, a = before.select(key, value(before).alias("_b")), after.select(key, value(after).alias("_a"))
    change = F.when(F.col("_a").isNull(), "removed").when(F.col("_b").isNull(), "added").when(F.col("_a") == F.col("_b"), "retained").otherwise("replaced")
    return b.join(a, key, "full_outer").select(key, change.alias("change"))

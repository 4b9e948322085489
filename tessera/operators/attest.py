"""Rule outcomes resolved against human attestations, and quality metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: The resolutions.
RESOLUTIONS = (
    "automatic_passed",
    "manual_confirmed",
    "manual_review_pending",
    "manual_rejected",
    "attestation_integrity_failed",
    "failed",
)
BINDING = ("source_evidence_hash", "finding_hash", "atomic_requirement_hash")


def resolve(validations: DataFrame, attestations: DataFrame, bindings: DataFrame) -> DataFrame:
    """``validations`` (finding_id, rule, status) with resolution and effective_passed.

    An attestation counts if it is the only one for its finding and rule and bears the finding's present digests
    (``bindings``: finding_id and three digests). One on a failed rule, or one that does not count, makes a row for the
    rule ``attestation_integrity``."""
    now = bindings.select("finding_id", *(F.col(c).alias(f"_{c}") for c in BINDING))
    same = F.lit(True)
    for c in BINDING:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    by_rule = (
        attestations.join(now, "finding_id", "left")
        .groupBy("finding_id", "rule")
        .agg(F.count("*").alias("_n"), F.count_if(same).alias("_exact"), F.max(F.when(same, F.col("decision"))).alias("_decision"))
    )
    x = validations.join(by_rule, ["finding_id", "rule"], "left")
    broken = F.coalesce((F.col("_n") > 1) | (F.col("_exact") != 1), F.lit(False))
    resolution = (
        F.when(F.col("status") == "failed", "failed")
        .when(broken, "attestation_integrity_failed")
        .when(F.col("_decision") == "rejected", "manual_rejected")
        .when(F.col("status") == "passed", "automatic_passed")
        .when(F.col("_decision").isNull(), "manual_review_pending")
        .otherwise("manual_confirmed")
    )
    x = x.withColumns({"resolution": resolution, "_extra": broken & (F.col("status") == "failed")})
    x = x.withColumn("effective_passed", F.col("resolution").isin("automatic_passed", "manual_confirmed"))
    names = ["finding_id", "rule", "status", "resolution", "effective_passed"]
    extra = x.where("_extra").select("finding_id").distinct().select(
        "finding_id",
        F.lit("attestation_integrity").alias("rule"),
        F.lit("failed").alias("status"),
        F.lit("attestation_integrity_failed").alias("resolution"),
        F.lit(False).alias("effective_passed"),
    )
    return x.select(*names).unionByName(extra)


def resolution_counts(resolved: DataFrame, by: str) -> DataFrame:
    return resolved.groupBy(by).agg(*(F.count_if(F.col("resolution") == r).alias(r) for r in RESOLUTIONS))


def ratio(part: Column, whole: Column, empty: float) -> Column:
    """A share, or ``empty`` where there is nothing to share."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty))


def quality_metrics(findings: DataFrame, parse_complete: Column | None = None, by: str = "project_id") -> DataFrame:
    """Five metrics per project over ``findings`` with the flags is_fact, has_citation, is_evidence, reverse_passed,
    unsupported, is_inference, is_marked, needs_review and is_reviewed."""
    n = lambda *flags: F.count_if(F.lit(True) & F.expr(" and ".join(flags)))
    x = findings.withColumn("_complete", F.lit(True) if parse_complete is None else parse_complete)
    complete = F.bool_and("_complete")
    unsupported, evidence = n("unsupported"), n("is_evidence")
    return x.groupBy(by).agg(
        ratio(n("is_fact", "has_citation"), n("is_fact"), 0.0).alias("citation_coverage"),
        F.when(complete, ratio(n("is_evidence", "reverse_passed"), evidence, 0.0)).otherwise(F.lit(0.0)).alias("reverse_check_rate"),
        F.when(complete, unsupported).otherwise(F.greatest(unsupported, evidence, F.lit(1))).alias("unsupported_count"),
        ratio(n("is_inference", "is_marked"), n("is_inference"), 1.0).alias("inference_marking_rate"),
        ratio(n("needs_review", "is_reviewed"), n("needs_review"), 1.0).alias("review_completion_rate"),
        F.count("*").alias("n_findings"),
    )


def quality_gate(metrics: DataFrame) -> DataFrame:
    """``metrics`` with gate_passed: all rates are 1, nothing is unsupported, and there are findings."""
    rates = ("citation_coverage", "reverse_check_rate", "inference_marking_rate", "review_completion_rate")
    ok = (F.col("unsupported_count") == 0) & (F.col("n_findings") > 0)
    for r in rates:
        ok &= F.col(r) == 1.0
    return metrics.withColumn("gate_passed", ok)


def integrity_keys(resolved: DataFrame) -> DataFrame:
    """The number of distinct attestation failures; imports count once."""
    key = F.when(F.col("rule") == "attestation_integrity", "attestation_import").otherwise(F.concat_ws(":", "finding_id", "rule"))
    return resolved.agg(F.count_distinct(F.when(F.col("resolution") == "attestation_integrity_failed", key)).alias("n_keys"))


def work_queue(resolved: DataFrame) -> DataFrame:
    """Rules that wait for a person or were rejected by one, with a flag of integrity failures in their finding."""
    bad = resolved.groupBy("finding_id").agg(F.max(F.col("resolution") == "attestation_integrity_failed").alias("integrity_failed"))
    open_ = resolved.where(F.col("resolution").isin("manual_review_pending", "manual_rejected"))
    return open_.join(bad, "finding_id")


def with_messages(validations: DataFrame, texts: dict[str, tuple[str, str]], manual: str) -> DataFrame:
    """``validations`` (rule, status) with severity and message; ``texts`` has what is said of a rule that passes, and of
    one that fails."""
    table = lambda k: F.create_map(*(F.lit(x) for rule, said in texts.items() for x in (rule, said[k])))[F.col("rule")]
    status = F.col("status")
    return validations.withColumns(
        {
            "severity": F.when(status == "passed", "info").when(status == "manual_review_required", "warning").otherwise("error"),
            "message": F.when(status == "passed", table(0)).when(status == "manual_review_required", manual).otherwise(table(1)),
        }
    )


def read_attestations(lines: DataFrame, rules: tuple[str, ...], column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(records, issues) of stored attestations, one JSON object a row. A row with other keys, without a decision or with
    a time that is not UTC is an issue, which keeps finding_id and rule if it names a finding and a known rule."""
    fields = ("finding_id", "rule", "decision", "source_evidence_hash", "finding_hash", "atomic_requirement_hash", "reviewer", "reviewed_at", "reason")
    x = lines.withColumns({"r": F.from_json(column, ", ".join(f"{f} string" for f in fields)), "_keys": F.json_object_keys(column)})
    filled = lambda f: F.coalesce(T.trim_ws(F.col(f"r.{f}")) != "", F.lit(False))
    named = filled("finding_id") & F.coalesce(F.col("r.rule").isin(*rules), F.lit(False))
    good = F.coalesce(F.array_sort("_keys") == F.array(*map(F.lit, sorted(fields))), F.lit(False)) & named
    good &= F.coalesce(F.col("r.decision").isin("confirmed", "rejected"), F.lit(False)) & filled("reviewer") & filled("reason") & T.utc_timestamp_valid(F.col("r.reviewed_at"))
    x = x.withColumns({"_good": good, "_named": F.coalesce(named, F.lit(False))})
    issues = x.where(~F.col("_good")).select(*(F.when(F.col("_named"), F.col(f"r.{f}")).alias(f) for f in ("finding_id", "rule")), F.lit("malformed attestation").alias("why"))
    return x.where("_good").select("r.*"), issues

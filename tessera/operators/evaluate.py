"""Actual against expected corpora: one-to-one matches, precision and recall, character accuracy, and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.edit import edit_distance
from tessera.operators import scan

#: Critical categories with the categories that count as each, and the limits of the gate.
CRITICAL = {
    "core_requirement": ("key_matter:core_requirement",),
    "prohibition": ("key_matter:prohibition",),
    "key_date": (
        "key_matter:effective_date",
        "document_identity:publication_date",
        "document_identity:effective_date",
        "document_identity:expiry_date",
        "document_identity:deadline",
    ),
    "transition_period": ("key_matter:transition_period",),
}
LIMITS = {"critical": (0.95, 0.95), "atomic": (0.90, 0.85), "ocr": 0.99}


def critical_category(category: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, members in CRITICAL.items():
        out = F.when(category.isin(*members), name).otherwise(out)
    return out


def match(expected: DataFrame, actual: DataFrame, keys: list[str], id_: str = "id") -> DataFrame:
    """(expected_id, actual_id): rows with equal keys paired one to one, each side by ascending id. Equality is
    transitive, so pairing by rank within a key is what a greedy walk would find."""
    rank = scan.Wanted(number="_rank")
    e = scan.scanned(expected.select(id_, *keys), keys, id_, rank)
    a = scan.scanned(actual.select(id_, *keys), keys, id_, rank)
    e = e.select(F.col(id_).alias("expected_id"), *(F.col(k).alias(f"e_{k}") for k in keys), F.col("_rank").alias("n"))
    a = a.select(F.col(id_).alias("actual_id"), *(F.col(k).alias(f"a_{k}") for k in keys), F.col("_rank").alias("m"))
    same = F.col("n") == F.col("m")
    for k in keys:
        same &= F.col(f"e_{k}").eqNullSafe(F.col(f"a_{k}"))
    return e.join(a, same).select("expected_id", "actual_id")


def counts(expected: DataFrame, actual: DataFrame, matches: DataFrame, by: str, id_: str = "id") -> DataFrame:
    """Per ``by`` and, with a null, over all: tp, fp, fn, precision and recall (null where there is nothing). A match
    counts for a group if both its rows are of it."""
    e = expected.select(F.col(id_).alias("expected_id"), F.col(by).alias("e_by"))
    a = actual.select(F.col(id_).alias("actual_id"), F.col(by).alias("a_by"))
    both = matches.join(e, "expected_id").join(a, "actual_id")
    rows = (
        e.select(F.col("e_by").alias(by), F.lit(1).alias("e"), F.lit(0).alias("a"), F.lit(0).alias("t"))
        .unionByName(a.select(F.col("a_by").alias(by), F.lit(0).alias("e"), F.lit(1).alias("a"), F.lit(0).alias("t")))
        .unionByName(both.where("e_by = a_by").select(F.col("e_by").alias(by), F.lit(0).alias("e"), F.lit(0).alias("a"), F.lit(1).alias("t")))
    )
    x = rows.where(F.col(by).isNotNull()).rollup(by).agg(F.sum("t").alias("tp"), (F.sum("a") - F.sum("t")).alias("fp"), (F.sum("e") - F.sum("t")).alias("fn"))
    share = lambda other: F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0))
    return x.withColumns({"precision": share("fp"), "recall": share("fn")})


def page_accuracy(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Per page of ``expected`` (keys, text): errors (edits; all characters if the page is missing), length, accuracy,
    and whether it needs review. Edits are counted exactly, in a band that is first as wide as the limit of accuracy allows."""
    a = actual.select(*keys, F.col("text").alias("actual_text"))
    x = expected.join(a, keys, "left")
    n = F.length("text")
    errors = F.when(F.col("actual_text").isNull(), n).otherwise(edit_distance(1 - LIMITS["ocr"])("text", "actual_text"))
    x = x.withColumns({"errors": errors, "n_chars": n})
    accuracy = 1 - F.col("errors") / F.nullif(F.col("n_chars"), F.lit(0))
    return x.select(*keys, "errors", "n_chars", accuracy.alias("accuracy"), F.coalesce(accuracy < LIMITS["ocr"], F.lit(True)).alias("needs_review"))


def pending_reviews(pages: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """Pages of ``page_accuracy`` that need review and have none that is current (``reviews``: keys, is_current)."""
    current = reviews.where("is_current").select(*keys).distinct()
    return pages.where("needs_review").join(current, keys, "left_anti")


def corpus_accuracy(pages: DataFrame) -> DataFrame:
    n, e = F.sum("n_chars"), F.sum("errors")
    return pages.agg(F.coalesce(e, F.lit(0)).alias("errors"), F.coalesce(n, F.lit(0)).alias("n_chars"), (1 - e / F.nullif(n, F.lit(0))).alias("accuracy"))


def citation_validity(actual: DataFrame, matches: DataFrame) -> DataFrame:
    """Matched regulatory facts among all regulatory facts: valid, total, rate."""
    facts = actual.where("claim_type = 'regulatory_fact'").select(F.col("id").alias("actual_id"))
    hit = matches.select("actual_id").distinct().withColumn("hit", F.lit(1))
    n, v = F.count("*"), F.count("hit")
    return facts.join(hit, "actual_id", "left").agg(v.alias("valid"), n.alias("total"), (v / F.nullif(n, F.lit(0))).alias("rate"))


def unmarked_inferences(actual: DataFrame) -> DataFrame:
    return actual.where("startswith(category, 'institution_impact:') and claim_type <> 'ai_inference'").select("id")


def omissions(expected: DataFrame, matches: DataFrame) -> DataFrame:
    """Critical expected findings without a match."""
    critical = expected.where(critical_category(F.col("category")).isNotNull()).select(F.col("id").alias("expected_id"))
    return critical.join(matches, "expected_id", "left_anti")


def gate(metrics: DataFrame) -> DataFrame:
    """``metrics`` (one row) with failures, in their fixed order, and passed. Columns: precision_ and recall_ of each
    critical category and of atomic, citation_rate, n_unmarked, n_omissions, ocr_accuracy, ocr_coverage, n_pending."""
    below = lambda c, limit: F.coalesce(F.col(c) < limit, F.lit(True))
    absent = lambda k: F.col(f"precision_{k}").isNull() & F.col(f"recall_{k}").isNull()
    checks = []
    for k in CRITICAL:
        p, r = LIMITS["critical"]
        checks += [
            (absent(k), f"critical_category_not_evaluable:{k}"),
            (~absent(k) & below(f"precision_{k}", p), f"critical_precision_below_95:{k}"),
            (~absent(k) & below(f"recall_{k}", r), f"critical_recall_below_95:{k}"),
        ]
    p, r = LIMITS["atomic"]
    checks += [
        (absent("atomic"), "atomic_not_evaluable"),
        (~absent("atomic") & below("precision_atomic", p), "atomic_precision_below_90"),
        (~absent("atomic") & below("recall_atomic", r), "atomic_recall_below_85"),
        (F.col("citation_rate").isNull(), "citation_not_evaluable"),
        (F.col("citation_rate") != 1, "citation_validity_below_100"),
        (F.col("n_unmarked") > 0, "unmarked_ai_inference"),
        (F.col("n_omissions") > 0, "critical_omissions"),
        (F.col("ocr_accuracy").isNull(), "ocr_not_evaluable"),
        (F.col("ocr_accuracy") < LIMITS["ocr"], "ocr_accuracy_below_99"),
        (~F.col("ocr_coverage"), "ocr_page_coverage_mismatch"),
        (F.col("n_pending") > 0, "ocr_manual_review_pending"),
    ]
    failures = F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))
    return metrics.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def release_report(expected: DataFrame, actual: DataFrame, keys: list[str], pages: DataFrame, cited: DataFrame) -> DataFrame:
    """One row with all metrics of a release, its failures and whether it passes: matches of ``expected`` and ``actual``
    (id, category, claim_type and ``keys``) per critical category and for atomic requirements, citations (``cited``: valid,
    total, rate), page accuracy (``pages``: errors, n_chars, needs_review, is_extra), unmarked inferences and omissions."""
    found = match(expected, actual, keys)
    kind = F.coalesce(critical_category(F.col("category")), F.when(F.col("category") == "atomic_requirement", "atomic"))
    e, a = expected.withColumn("kind", kind), actual.withColumn("kind", kind)
    kinds = [*CRITICAL, "atomic"]
    by = counts(e, a, found, "kind")
    cells = by.agg(*(F.max(F.when(F.col("kind") == k, F.col(m))).alias(f"{m}_{k}") for k in kinds for m in ("precision", "recall")))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    ocr = pages.agg(
        (1 - F.sum("errors") / F.nullif(F.sum("n_chars"), F.lit(0))).alias("ocr_accuracy"), F.coalesce(~F.bool_or("is_extra"), F.lit(False)).alias("ocr_coverage"), F.count_if("needs_review").alias("n_pending")
    )
    one = cells.crossJoin(n(unmarked_inferences(actual), "n_unmarked")).crossJoin(n(omissions(expected, found), "n_omissions"))  # one row each
    return gate(one.crossJoin(cited.select(F.col("rate").alias("citation_rate"))).crossJoin(ocr))

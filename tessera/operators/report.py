"""Report tables: eligible findings routed to sections, cut to each section's limit, with their sources' titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

_has = lambda *words: "(" + " or ".join(f"contains(category, '{w}')" for w in words) + ")"
_is = lambda *names: f"category in ({', '.join(repr(n) for n in names)})"
#: The sections of each report as (key, condition, limit), and the dimensions of impact.
DIMENSIONS = ("governance", "institution", "process", "system", "data", "people", "reporting")
PURPOSES = {"generic": "human_review", "recommended_action": "recommended_action:priority"}
_DATES = _is(
    "key_matter:effective_date",
    "key_matter:implementation_arrangement",
    "key_matter:transition_period",
    "document_identity:effective_date",
    "document_identity:deadline",
)
_IMPACT = f"({_is(*(f'institution_impact:{d}' for d in DIMENSIONS))} and claim_type = 'ai_inference')"
_ACTION = _is(PURPOSES["recommended_action"])
FULL = (
    ("executive_summary", _has("core_requirement", "prohibition", "effective_date"), 3),
    ("document_information", _has("document_identity"), None),
    ("regulatory_background", _has("regulatory_context", "official_context"), None),
    ("applicable_scope", _has("applicability"), None),
    ("core_requirements", _has("core_requirement") + " or category = 'atomic_requirement'", None),
    ("red_lines", _has("prohibition"), None),
    ("dates_and_transition", _DATES, None),
    ("institution_impact", _IMPACT, None),
    ("recommended_actions", _ACTION, None),
    ("pending_and_risks", "false", None),
    ("evidence_appendix", "true", None),
)
_TOP = _has("key_matter", "core_requirement", "atomic_requirement", "applicability")
QUICK = (
    ("one_line", _TOP, 1),
    ("why_it_matters", _has("regulatory_context", "official_context"), 2),
    ("top_changes", _TOP, 5),
    ("red_lines", _has("prohibition"), 3),
    ("dates", _DATES, 3),
    ("affected_scope", _has("applicability") + f" or {_IMPACT}", 3),
    ("actions", _ACTION, 5),
    ("limitations", "claim_type = 'official_explanation'", 2),
)
CLAIM_LABELS = {"regulatory_fact": "监管原文", "official_explanation": "官方解读", "human_judgment": "人工判断"}


def claim_label(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CLAIM_LABELS.items() for x in kv))[c], F.lit("AI推导"))


def review_queue(findings: DataFrame) -> DataFrame:
    """``findings`` with score, the most urgent first: deleted ones last, then required, pending and facts."""
    score = (
        F.when(F.col("review_status") == "deleted", -100).otherwise(0)
        + F.when(F.col("required_review"), 20).otherwise(0)
        + F.when(F.col("review_status") == "pending", 10).otherwise(0)
        + F.when(F.col("claim_type") == "regulatory_fact", 5).otherwise(0)
    )
    return findings.withColumn("score", score).orderBy(F.desc("score"), "ord")


def eligible(findings: DataFrame, resolved: DataFrame, controlled: DataFrame) -> DataFrame:
    """Findings that a report may show: not deleted or pending, free of credentials, unchanged since their last review,
    and with every rule in effect passed."""
    passed = resolved.groupBy("finding_id").agg(F.bool_and("effective_passed").alias("ok")).where("ok")
    quotes = F.array_join(F.transform("source_anchors", lambda a: a["quote"]), "\n")
    changes = F.array_join(F.transform("revision_records", lambda r: r["change_summary"]), "\n")
    clean = ~T.has_credentials(F.concat_ws("\n", "statement", quotes, changes))
    kept = findings.where((F.col("review_status") != "deleted") & (F.col("claim_type") != "pending_confirmation") & clean)
    return kept.join(passed, "finding_id", "left_semi").join(controlled, ["finding_id", "hash"], "left_semi")


def route(findings: DataFrame, sections, by: str = "project_id", order: str = "ord") -> DataFrame:
    """(by, section_ord, section, item_ord, …) of findings in each section whose condition holds, the first of each up to
    its limit."""
    each = F.array(*(F.when(F.expr(w), F.struct(F.lit(k).alias("k"), F.lit(s).alias("s"), F.lit(n).cast("int").alias("n"))) for k, (s, w, n) in enumerate(sections)))
    x = findings.select("*", F.explode(F.array_compact(each)).alias("_s"))
    x = x.select(*findings.columns, F.col("_s.k").alias("section_ord"), F.col("_s.s").alias("section"), F.col("_s.n").alias("_limit"))
    rank = F.row_number().over(Window.partitionBy(by, "section_ord").orderBy(order))
    most = max([n for _, _, n in sections if n], default=0)
    # a bound that Spark knows lets each task drop rows before the shuffle; sections without a limit are numbered apart
    cut = x.where("_limit is not null").withColumn("item_ord", rank).where(F.col("item_ord") <= most).where("item_ord <= _limit")
    return cut.unionByName(x.where("_limit is null").withColumn("item_ord", rank)).drop("_limit")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark keeps at most n rows of a group before it shuffles."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def with_titles(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Items (… source_id) with the source's title, or its id where it has none."""
    titles = sources.groupBy("source_id").agg(F.min("title").alias("_t"))
    return items.join(titles, "source_id", "left").withColumn("source_title", F.coalesce("_t", F.col("source_id").cast("string"))).drop("_t")


def dimension_of(category: Column) -> Column:
    name = F.substring_index(category, ":", -1)
    return F.when(category.startswith("institution_impact:") & name.isin(*DIMENSIONS), name)


def invalid_impact(category: Column, claim_type: Column) -> Column:
    """Whether a category is in the namespace of impacts, but not one of them or not marked as an inference."""
    within = category.startswith("institution_impact")
    return within & ~(dimension_of(category).isNotNull() & (claim_type == "ai_inference"))


def purpose_of(category: Column) -> Column:
    """The purpose of a human judgment's category, or null for one outside the closed set."""
    pairs = [(c, p) for p, c in PURPOSES.items()]
    return F.create_map(*(F.lit(x) for kv in pairs for x in kv))[category]


def export_block(items: DataFrame, by: str = "project_id") -> DataFrame:
    """Per project why a quick commentary may not be exported, or null: it needs three to five top changes."""
    n = F.count_if(F.col("section") == "top_changes")
    return items.groupBy(by).agg(F.when((n < 3) | (n > 5), "three to five top changes are needed").alias("reason"), n.alias("n_top"))


def step_gate(projects: DataFrame) -> DataFrame:
    """Per project the reason why it may not be finished, by the first condition that fails: has_regulation, reanalysis
    is not pending, parsing_completed, n_findings, reviews_done, evidence_ready, gate_passed."""
    why = (
        F.when(~F.col("has_regulation"), "no regulation")
        .when(F.col("reanalysis_pending"), "reanalysis is pending")
        .when(~F.col("parsing_completed"), "parsing is not completed")
        .when(F.col("n_findings") == 0, "no analysis")
        .when(~F.col("reviews_done"), "required reviews are open")
        .when(F.col("evidence_ready").isNull(), "evidence is not checked")
        .when(~F.col("evidence_ready"), "evidence failed")
        .when(~F.col("gate_passed"), "quality gate failed")
    )
    return projects.withColumn("reason", why).withColumn("allowed", F.col("reason").isNull())


def report_status(projects: DataFrame) -> DataFrame:
    """``projects`` (finalized, parse_complete, n_eligible) with the report's status, its watermark, and whether a draft can
    be looked at."""
    final = F.coalesce("finalized", F.lit(False))
    return projects.withColumns(
        {
            "review_status": F.when(final, "human_finalized").otherwise("ai_draft"),
            "watermark": F.when(~final, "AI草稿，未经人工复核"),
            "can_preview": F.coalesce(F.col("parse_complete") & (F.col("n_eligible") > 0), F.lit(False)),
        }
    )


def by_source_type(sources: DataFrame) -> DataFrame:
    """Sources in the order of reading: regulations first, then official sources, each by ``ord``."""
    return sources.orderBy(F.when(F.col("source_type") == "regulatory_text", 0).otherwise(1), "ord")

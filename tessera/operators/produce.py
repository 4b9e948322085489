"""Findings from stored model responses: parsed, checked and projected, rejects kept with a reason.

A response is a row (node_id, content). An extractor of one's own, or the rule extractor here, can stand for the model: it
maps batches of (node_id, text) to batches of (node_id, kind, value, quote)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.checks import keys_of, within
from tessera.operators.report import DIMENSIONS
from tessera.operators.rules import OFFICIAL_FORM, OFFICIAL_LABELS, long_form

#: Ids that only the engine gives, and the kinds of identity extractions.
RESERVED = "SYS-"
FILE_PROFILE_ID = "SYS-PENDING-FILE-PROFILE"
FILE_PROFILE = (
    "待确认：上传材料的官方来源状态、发布日期、当前效力/生效或废止状态，以及对具体机构的适用性维度（机构类型、业务范围、地域和主体画像）"
    "未由已提供资料完整建立。"
)
IDENTITY_CATEGORIES = ("document_identity:", "pending_confirmation:document_identity:", "official_context:", "pending_confirmation:file_profile", "pending_confirmation:source_conflict")


def stage_of(category: Column, claim_type: Column) -> Column:
    """The stage that makes findings of a category."""
    begins = lambda *heads: _any(category.startswith(h) for h in heads)
    impact = (claim_type == "ai_inference") | (category == "institution_impact") | category.isin(*(f"institution_impact:{d}" for d in DIMENSIONS))
    return (
        F.when((category == "atomic_requirement") | begins("pending_confirmation:atomic_conflict"), "atomic_clauses")
        .when(begins(*IDENTITY_CATEGORIES), "document_identity")
        .when(F.coalesce(impact, F.lit(False)), "institution_impact")
        .otherwise("key_matters")
    )


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out |= c
    return out


def is_reserved(finding_id: Column) -> Column:
    return finding_id.startswith(RESERVED)


def exact_fact(statement: Column, anchors: Column) -> Column:
    """Whether a statement stands in a quote from a regulation. Texts are squeezed (``functions.text.squeeze``)."""
    return F.exists(anchors, lambda a: (a["source_type"] == "regulatory_text") & F.contains(a["quote"], statement))


def selected_stages(plan: DataFrame, stages: list[str]) -> DataFrame:
    """The nodes of a plan whose stage is asked for."""
    return plan.where(F.col("stage").isin(stages))


def parse_responses(responses: DataFrame, schema: str, required: dict[str, Column]) -> DataFrame:
    """``responses`` (node_id, content) with the parsed ``row`` and ``refused``: no JSON in the text, another schema, or the
    first of ``required`` that does not hold of the row's columns."""
    body = T.json_of("content")
    x = responses.withColumn("_json", body)
    x = x.withColumn("row", F.from_json("_json", schema))
    inner = x.select("*", "row.*")
    why = F.when(F.col("_json").isNull(), "no JSON").when(F.try_parse_json("_json").isNull() | F.col("row").isNull(), "other schema")
    for name, holds in required.items():
        why = why.when(~F.coalesce(holds, F.lit(False)), name)
    return inner.select("node_id", "row", why.alias("refused"))


def extract(texts: DataFrame, extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None) -> DataFrame:
    """(node_id, kind, value, quote) that an extractor finds in ``texts`` (node_id, text). Without one: sentences with an
    obligation word, each with the word, and dates and numbers, each with its token."""
    schema = "node_id string, kind string, value string, quote string"
    return texts.select(F.col("node_id").cast("string").alias("node_id"), "text").mapInPandas(extractor or rule_extractor, schema)


def rule_extractor(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for node, text in zip(frame["node_id"], frame["text"], strict=True):
            for sentence in T.sentences(text or ""):
                rows += [(node, "modal", m, sentence) for m in T.modals_in(sentence)]
                rows += [(node, "date", t, sentence) for _, _, t in T.date_spans(sentence)]
                rows += [(node, "number", t, sentence) for _, _, t in T.number_spans(sentence)]
        yield pd.DataFrame(rows, columns=["node_id", "kind", "value", "quote"])


def identity_findings(extractions: DataFrame) -> DataFrame:
    """Pending findings of identity extractions (finding_id, kind, value, source_anchors), or the reason against them: a
    reserved id, a citation of anything but a regulation, or a value that no quote has once white space goes."""
    solid = T.strip_ws(T.nfkc("value"))
    x = extractions.withColumns({"_value": solid, "_quotes": T.strip_ws(T.nfkc(F.array_join(F.transform("source_anchors", lambda a: a["quote"]), "\x00")))})
    held = F.exists(F.split("_quotes", "\x00"), lambda q: F.contains(q, F.col("_value")))
    why = (
        F.when(is_reserved(F.col("finding_id")), "reserved id")
        .when(~F.forall("source_anchors", lambda a: a["source_type"] == "regulatory_text") | (F.size("source_anchors") == 0), "not a regulation")
        .when((F.col("_value") == "") | ~held, "value is not quoted")
    )
    return x.select("finding_id", F.concat(F.lit("document_identity:"), "kind").alias("category"), F.lit("pending_confirmation").alias("claim_type"), "source_anchors", why.alias("refused"))


def official_findings(records: DataFrame, primaries: DataFrame) -> DataFrame:
    """Explanations from excerpts (finding_id, kind, excerpt, source_anchors, parents), or the reason against them: a
    reserved id, other than one official citation, an excerpt that is not its quote, parents named twice or that are not
    among ``primaries`` (finding_id)."""
    named = records.select("finding_id", F.explode("parents").alias("parent")).join(primaries.select(F.col("finding_id").alias("parent")).distinct().withColumn("_known", F.lit(True)), "parent", "left")
    known = named.groupBy("finding_id").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_known"))
    first = F.get(F.col("source_anchors"), F.lit(0))
    x = records.join(known, "finding_id", "left").withColumns({"_quote": T.strip_ws(T.nfkc(first["quote"])), "_excerpt": T.strip_ws(T.nfkc("excerpt"))})
    why = (
        F.when(is_reserved(F.col("finding_id")), "reserved id")
        .when((F.size("source_anchors") != 1) | F.coalesce(first["source_type"] != "official_interpretation", F.lit(True)), "not one official citation")
        .when(F.coalesce(F.col("_excerpt") != F.col("_quote"), F.lit(True)), "excerpt is not the quote")
        .when(F.size(F.array_distinct("parents")) < F.size("parents"), "parent named twice")
        .when(~F.coalesce("_known", F.lit(True)), "parent is not paired")
    )
    category = F.concat(F.lit("official_context:"), "kind")
    label = F.create_map(*(F.lit(v) for kv in OFFICIAL_LABELS.items() for v in kv))[category]
    said = F.format_string(OFFICIAL_FORM, label, first["quote"])
    return x.select("finding_id", category.alias("category"), F.when(why.isNull(), said).alias("statement"), F.col("parents").alias("inference_parents"), why.alias("refused"))


def impacts(items: DataFrame, upstream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, relationships) of structured impacts (item_id, dimension, parents, source_anchors); what names a parent
    that is not ``upstream`` (finding_id, source_anchors), cites beyond its parents or has no known dimension keeps its
    row in findings with ``refused``."""
    above = items.select("item_id", F.explode("parents").alias("finding_id")).join(upstream.select("finding_id", keys_of(F.col("source_anchors")).alias("_keys")), "finding_id", "left")
    above = above.groupBy("item_id").agg(F.bool_and(F.col("_keys").isNotNull()).alias("_known"), F.flatten(F.collect_list("_keys")).alias("_above"))
    x = items.join(above, "item_id", "left").withColumn("_own", keys_of(F.col("source_anchors")))
    why = (
        F.when(~F.col("dimension").isin(*DIMENSIONS), "unknown dimension")
        .when(~F.coalesce("_known", F.lit(False)), "parent is not upstream")
        .when((F.size("_own") == 0) | ~within(F.col("_own"), F.col("_above")), "cites beyond its parents")
    )
    x = x.withColumn("refused", why)
    findings = x.select(F.col("item_id").alias("finding_id"), F.concat(F.lit("institution_impact:"), "dimension").alias("category"), F.lit("ai_inference").alias("claim_type"), F.col("parents").alias("inference_parents"), "refused")
    relationships = x.where("refused is null").select(F.concat(F.lit("rel:"), "item_id").alias("relationship_id"), F.col("parents").alias("from_finding_ids"), F.col("item_id").alias("to_finding_id"))
    return findings, relationships


def atomic_response_rules(findings: DataFrame, requirements: DataFrame, by: str = "node_id", form=long_form) -> DataFrame:
    """(requirement_id, rule, ok) of a node's atomic response: one requirement per finding, citations of regulations alone
    and within the finding's, and what lacks facts hangs on a pending finding. With ``tallied`` as ``form`` its rows are counted."""
    key = [by, "finding_id"]
    f = findings.select(*key, "category", "claim_type", keys_of(F.col("source_anchors")).alias("_keys")).groupBy(*key).agg(F.count("*").alias("_nf"), *(F.first(c).alias(c) for c in ("category", "claim_type", "_keys")))
    own = requirements.where(F.col(by).isNotNull() & F.col("finding_id").isNotNull()).withColumn("_own", keys_of(F.col("source_anchors")))
    x = own.withColumn("_nr", F.count("*").over(Window.partitionBy(*key))).join(f, key, "left")
    return form(
        x,
        "requirement_id",
        {
            "one_to_one": (F.col("_nf") == 1) & (F.col("_nr") == 1),
            "finding_is_atomic": (F.col("category") == "atomic_requirement") & F.col("claim_type").isin("regulatory_fact", "pending_confirmation"),
            "cites_regulations": F.forall("source_anchors", lambda a: a["source_type"] == "regulatory_text"),
            "cites_within": within(F.col("_own"), F.col("_keys")),
            "lacking_is_pending": (F.size("missing_facts") == 0) | (F.col("claim_type") == "pending_confirmation"),
        },
    )


def conflict_response_rules(conflicts: DataFrame, current: DataFrame, primaries: DataFrame) -> DataFrame:
    """(conflict_id, rule, ok): a conflict joins a paired primary finding and an explanation of this node that names it as
    parent, cites within both, and cites a regulation and an official source."""
    side = lambda df, p: df.select(F.col("finding_id").alias(f"{p}_id"), F.col("claim_type").alias(f"{p}_type"), F.col("inference_parents").alias(f"{p}_parents"), keys_of(F.col("source_anchors")).alias(f"{p}_keys"))
    x = conflicts.withColumn("_own", keys_of(F.col("source_anchors")))
    x = x.join(side(primaries, "r"), F.col("regulatory_finding_id") == F.col("r_id"), "left").join(side(current, "o"), F.col("interpretation_finding_id") == F.col("o_id"), "left")
    cites = lambda kind: F.exists("source_anchors", lambda a: a["source_type"] == kind)
    return long_form(
        x,
        "conflict_id",
        {
            "sides_known": F.col("r_id").isNotNull() & F.col("o_id").isNotNull(),
            "other_side_explains": F.col("o_type") == "official_explanation",
            "sides_are_paired": F.array_contains("o_parents", F.col("r_id")),
            "cites_within_both": within(F.col("_own"), F.array_union("r_keys", "o_keys")),
            "cites_both_kinds": cites("regulatory_text") & cites("official_interpretation"),
        },
    )


def pending_findings(conflicts: DataFrame, projects: DataFrame) -> DataFrame:
    """The pending findings of conflicts (conflict_id, summary, both finding ids, source_anchors), and one per project that
    says what the files leave open: finding_id, project_id, category, statement, inference_parents."""
    none = F.array().cast("array<string>")
    c = conflicts.select(
        F.col("conflict_id").alias("finding_id"),
        "project_id",
        F.lit("pending_confirmation:source_conflict").alias("category"),
        F.concat(F.lit("待确认："), "summary").alias("statement"),
        F.array("regulatory_finding_id", "interpretation_finding_id").alias("inference_parents"),
    )
    p = projects.select(F.lit(FILE_PROFILE_ID).alias("finding_id"), "project_id", F.lit("pending_confirmation:file_profile").alias("category"), F.lit(FILE_PROFILE).alias("statement"), none.alias("inference_parents"))
    return c.unionByName(p)


def normalized_pairs(pairs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, rejects) of (official_source_id, primary_source_id) rows: each once, of an official and a regulatory source
    that are known; rejects have ``why``."""
    kind = lambda c: sources.groupBy("source_id").agg(F.min("source_type").alias(f"_{c}")).withColumnRenamed("source_id", c)
    x = pairs.distinct().join(kind("official_source_id"), "official_source_id", "left").join(kind("primary_source_id"), "primary_source_id", "left")
    why = (
        F.when(F.col("_official_source_id").isNull() | F.col("_primary_source_id").isNull(), "unknown source")
        .when(F.col("_official_source_id") != "official_interpretation", "not official")
        .when(F.col("_primary_source_id") != "regulatory_text", "not a regulation")
    )
    x = x.select("official_source_id", "primary_source_id", why.alias("why"))
    return x.where("why is null").drop("why"), x.where("why is not null")


def pairing_checks(samples: DataFrame, corpora: DataFrame) -> DataFrame:
    """(source_id, ok) of a manifest's official samples: every corpus (corpus, official_source_id, primary_source_id) that
    cites it pairs it with the manifest's primary, and one does."""
    told = corpora.select(F.col("official_source_id").alias("source_id"), F.col("primary_source_id").alias("_told"))
    x = samples.where("source_type = 'official_interpretation'").join(told, "source_id", "left")
    return x.groupBy("source_id").agg(F.bool_and(F.coalesce(F.col("_told") == F.col("primary_source_id"), F.lit(False))).alias("ok"))


def chunk_locators(chunk_texts: DataFrame, units: DataFrame) -> DataFrame:
    """(chunk_id, source_id, paragraph_index) of units whose text stands in what the chunk has of their source;
    ``chunk_texts`` has chunk_id, source_id and text."""
    u = units.select("source_id", "paragraph_index", F.col("text").alias("_unit"))
    return chunk_texts.join(u, "source_id").where(F.contains("text", "_unit")).select("chunk_id", "source_id", "paragraph_index").distinct()


def run_log(outputs: DataFrame, responses: DataFrame, scopes: DataFrame) -> DataFrame:
    """A row per node: digests of its response (node_id, content), its scope (node_id, text) and its outputs (node_id,
    finding_id), and the ids of these in order."""
    ids = outputs.groupBy("node_id").agg(F.array_sort(F.collect_set("finding_id")).alias("output_ids"))
    scope = scopes.groupBy("node_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.sha2("text", 256)))), 256).alias("scope_hash"))
    x = responses.select("node_id", F.sha2("content", 256).alias("response_hash")).join(scope, "node_id", "left").join(ids, "node_id", "left")
    ids = F.coalesce("output_ids", F.array().cast("array<string>"))
    return x.select("node_id", "response_hash", "scope_hash", F.sha2(F.to_json(ids), 256).alias("output_hash"), ids.alias("output_ids"))


def saved_runs(spark, path: str, valid: Column) -> DataFrame:
    """Runs stored at ``path`` that are still valid, the last of each node by ``seq``."""
    rows = spark.read.parquet(path).where(valid)
    return rows.groupBy("node_id").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")


def finalize_draft(findings: DataFrame, requirements: DataFrame, relationships: DataFrame, pending: DataFrame) -> dict[str, DataFrame]:
    """The draft of a version: requirements that differ split into variants with findings of their own, pending findings
    added, equal findings merged, and requirements and relationships tied to the merged ones. Findings have ``ord``."""
    from tessera.operators import merge

    split = merge.expand_conflicts(requirements)
    late = split.where("needs_review").select("finding_id", F.regexp_replace("finding_id", "~atomic-.*$", "").alias("_of")).distinct()
    copies = late.join(findings.withColumnRenamed("finding_id", "_of"), "_of").drop("_of").withColumns({"required_review": F.lit(True), "category": F.lit("atomic_requirement")})
    more = findings.unionByName(copies.select(*findings.columns)).unionByName(pending.select(*findings.columns))
    keys = [*merge.dedup_key(), F.when(F.col("category") == "atomic_requirement", F.regexp_extract("finding_id", "~atomic-.*$", 0)).otherwise("")]
    alias = merge.aliases(more, keys)
    return {
        "findings": merge.merge_findings(more, keys),
        "aliases": alias,
        "requirements": merge.merge_requirements(split, alias),
        "relationships": merge.merge_relationships(relationships, alias),
    }


def kind_changes(findings: DataFrame, prior: DataFrame) -> DataFrame:
    """Findings that a directive targets and that have another category or claim type than before."""
    p = prior.select("finding_id", F.col("category").alias("_c"), F.col("claim_type").alias("_t"))
    return findings.join(p, "finding_id").where("category <> _c or claim_type <> _t").select("finding_id")

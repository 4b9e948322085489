"""Rule tables over sets of artifacts: requirements, drafts, checkpoints, corpora, manifests, versions, parse evidence.

Each function gives rows of (id, rule, ok). Ids that must be unique are counted by a grouped aggregate, references are
joined once by key, and sets are compared as sorted distinct arrays of one entity's own rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.rules import long_form, tilings
from tessera.sources.shared import checkpointed, dealt

#: Fields of a requirement in the order of its text, those that it must have, and marks of strength that a
#: person must read.
FIELDS = ("subject", "strength", "action", "object", "condition", "frequency", "deadline", "responsibility", "exceptions", "shared_context")
CORE = ("subject", "action", "object")
SINGLE_STRENGTH = ("应", "须")


def keys_of(anchors: Column) -> Column:
    """Citations as a sorted set of strings."""
    return F.array_sort(F.array_distinct(F.transform(anchors, lambda a: F.to_json(F.struct(a.alias("a"))))))


def within(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): how many rows have each key."""
    return df.groupBy(key).agg(F.count("*").alias(name))


def requirement_rules(requirements: DataFrame) -> DataFrame:
    """(requirement_id, rule, ok): missing facts are named once, what is named missing is null, and a core field is null
    exactly if it is named."""
    missing = F.col("missing_facts")
    named = lambda f: F.array_contains(missing, f)
    return long_form(
        requirements,
        "requirement_id",
        {
            "missing_named_once": F.size(F.array_distinct(missing)) == F.size(missing),
            "named_is_null": reduce(Column.__and__, (~named(f) | F.col(f).isNull() for f in FIELDS if f in requirements.columns)),
            "core_null_iff_named": reduce(Column.__and__, (F.col(f).isNull() == named(f) for f in CORE)),
        },
    )


def atomic_structure(findings: DataFrame, requirements: DataFrame) -> DataFrame:
    """(finding_id, status, strength_review) of all ``findings``: passed, failed or manual_review_required. A requirement
    must be the finding's only one and cite what it cites; its fields must cover the one quote exactly once, in one way,
    with subject, strength, action and object in this order."""
    mine = requirements.withColumn("_keys", keys_of(F.col("source_anchors"))).groupBy("finding_id").agg(
        F.count("*").alias("_n"), *(F.first(c).alias(f"_{c}") for c in FIELDS), F.first("manual_verification_required").alias("_manual"), F.first("_keys").alias("_keys")
    )
    x = dealt(findings.select("finding_id", "category", "statement", "source_anchors"), "finding_id").join(mine, "finding_id", "left")
    quote = F.get(F.col("source_anchors"), F.lit(0))["quote"]
    x = x.withColumns({"_quote": T.nfkc(quote), "_said": T.nfkc("statement"), "_force": T.nfkc("_strength")})
    value = {f: T.compact(F.col("_force") if f == "strength" else T.nfkc(f"_{f}")) for f in FIELDS}
    x = x.withColumns({"_text": T.compact(F.col("_quote")), **{f"v_{f}": F.nullif(value[f], F.lit("")) for f in FIELDS}})
    single = F.coalesce(F.col("_force").isin(*SINGLE_STRENGTH), F.lit(False)) | F.coalesce("_manual", F.lit(False))
    short = reduce(Column.__or__, (F.coalesce(F.length(f"v_{f}") == 1, F.lit(False)) for f in FIELDS if f != "strength"))
    lacking = reduce(Column.__or__, (F.coalesce(F.col(f"_{f}") == "", F.lit(True)) for f in CORE))
    absent = reduce(Column.__or__, (F.coalesce(~F.contains("_text", f"v_{f}"), F.lit(False)) for f in FIELDS))
    early = (
        F.when(F.col("category") != "atomic_requirement", "passed")
        .when(F.coalesce("_n", F.lit(0)) != 1, "failed")
        .when(single, "manual_review_required")
        .when(keys_of(F.col("source_anchors")) != F.col("_keys"), "failed")
        .when(F.size("source_anchors") != 1, "manual_review_required")
        .when(T.squeeze(F.col("_said")) != T.squeeze(F.col("_quote")), "manual_review_required")
        .when(F.coalesce(F.col("_strength") == "", F.lit(True)) | T.modal_class(F.col("_force")).isNull(), "manual_review_required")
        .when(lacking | short, "manual_review_required")
        .when(absent, "failed")
    )
    x = x.withColumns({"_early": early, "strength_review": (F.col("category") == "atomic_requirement") & (F.coalesce("_n", F.lit(0)) == 1) & single})
    # kept, as what follows reads it again and again, and each reading would normalize all texts anew
    x = checkpointed(x.select("finding_id", "_early", "strength_review", "_text", *(f"v_{f}" for f in FIELDS)))
    open_ = x.where("_early is null")
    fields = open_.select(F.col("finding_id").alias("req_id"), F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(f"v_{f}").alias("value")) for k, f in enumerate(FIELDS)))).alias("f"))
    fields = fields.select("req_id", "f.field", "f.value").where("value is not null")
    ways = tilings(fields, open_.select(F.col("finding_id").alias("req_id"), F.col("_text").alias("text")), in_order=4)
    x = x.join(ways.withColumnRenamed("req_id", "finding_id"), "finding_id", "left")
    status = F.coalesce("_early", F.when(F.col("n_tilings") == 1, "passed").otherwise("manual_review_required"))
    return x.select("finding_id", status.alias("status"), "strength_review")


def artifact_rules(findings: DataFrame, requirements: DataFrame, relationships: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(entity, id, rule, ok) over the artifacts of one version: unique ids, one requirement per atomic finding and none
    for others, citations within those of what they belong to, one relationship per inference, and conflicts bound to a
    fact, an explanation and their pending finding."""
    f = findings.select("finding_id", "category", "claim_type", F.array_sort("inference_parents").alias("parents"), keys_of(F.col("source_anchors")).alias("keys"))
    one = dealt(f, "finding_id").groupBy("finding_id").agg(*(F.first(c).alias(c) for c in ("category", "claim_type", "parents", "keys")), F.count("*").alias("n"))
    prefixed = lambda p: one.select(*(F.col(c).alias(f"{p}_{c}") for c in one.columns))
    rows = lambda df, entity, key, checks: long_form(df, key, checks).select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), "rule", "ok")
    per_finding = one.join(counted(requirements, "finding_id", "n_req"), "finding_id", "left")
    per_finding = per_finding.join(counted(relationships, "to_finding_id", "n_rel").withColumnRenamed("to_finding_id", "finding_id"), "finding_id", "left")
    n_req, n_rel = F.coalesce("n_req", F.lit(0)), F.coalesce("n_rel", F.lit(0))
    out = rows(
        per_finding,
        "finding",
        "finding_id",
        {
            "id_unique": F.col("n") == 1,
            "requirement_iff_atomic": n_req == F.when(F.col("category") == "atomic_requirement", 1).otherwise(0),
            "cited_unless_pending": (F.col("claim_type") == "pending_confirmation") | (F.size("keys") > 0),
            "relationship_iff_inference": n_rel == F.when(F.col("claim_type") == "ai_inference", 1).otherwise(0),
        },
    )
    r = requirements.withColumn("own", keys_of(F.col("source_anchors"))).join(prefixed("f"), F.col("finding_id") == F.col("f_finding_id"), "left")
    r = dealt(r, "requirement_id").join(counted(requirements, "requirement_id", "n_id"), "requirement_id")
    out = out.unionByName(
        rows(r, "requirement", "requirement_id", {"id_unique": F.col("n_id") == 1, "of_atomic_finding": F.col("f_category") == "atomic_requirement", "cites_within": within(F.col("own"), F.col("f_keys"))})
    )
    ends = relationships.select("relationship_id", F.explode("from_finding_ids").alias("end")).join(prefixed("p"), F.col("end") == F.col("p_finding_id"), "left")
    ends = dealt(ends.select("relationship_id", "p_finding_id", "p_keys"), "relationship_id").groupBy("relationship_id").agg(F.bool_and(F.col("p_finding_id").isNotNull()).alias("known"), F.array_distinct(F.flatten(F.collect_list("p_keys"))).alias("above"))
    x = relationships.withColumn("own", keys_of(F.col("source_anchors"))).join(ends, "relationship_id", "left").join(prefixed("t"), F.col("to_finding_id") == F.col("t_finding_id"), "left")
    out = out.unionByName(
        rows(
            x,
            "relationship",
            "relationship_id",
            {
                "to_inference": F.col("t_claim_type") == "ai_inference",
                "parents_known": F.col("known"),
                "parents_declared": F.array_sort("from_finding_ids") == F.col("t_parents"),
                "cites_within_parents": within(F.col("own"), F.col("above")) & within(F.col("t_keys"), F.col("above")),
                "cites_what_target_cites": F.col("own") == F.col("t_keys"),
            },
        )
    )
    c = conflicts.withColumn("own", keys_of(F.col("source_anchors"))).join(prefixed("r"), F.col("regulatory_finding_id") == F.col("r_finding_id"), "left")
    c = c.join(prefixed("o"), F.col("interpretation_finding_id") == F.col("o_finding_id"), "left").join(prefixed("q"), F.col("conflict_id") == F.col("q_finding_id"), "left")
    return out.unionByName(
        rows(
            c,
            "conflict",
            "conflict_id",
            {
                "of_fact": F.col("r_claim_type") == "regulatory_fact",
                "of_explanation": F.col("o_claim_type") == "official_explanation",
                "has_pending_finding": (F.col("q_category") == "pending_confirmation:source_conflict")
                & (F.col("q_parents") == F.array_sort(F.array("regulatory_finding_id", "interpretation_finding_id")))
                & (F.col("q_keys") == F.col("own")),
                "cites_within_both": within(F.col("own"), F.array_union("r_keys", "o_keys")),
            },
        )
    )


def checkpoint_rules(findings: DataFrame, requirements: DataFrame, ends: DataFrame, nodes: DataFrame, runs: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, rule, ok) of each project's checkpoint: requirements name atomic findings, atomic findings have a requirement,
    the ends of relationships and conflicts (by, finding_id) exist, and the last node is that of the last run."""
    key = [by, "finding_id"]
    known = findings.select(*key, (F.col("category") == "atomic_requirement").alias("atomic"))
    named = requirements.select(*key).distinct()
    failing = lambda df, rule: df.groupBy(by).agg(F.lit(rule).alias("rule"), F.bool_and("ok").alias("ok"))
    links = named.join(known, key, "left").withColumn("ok", F.coalesce("atomic", F.lit(False)))
    backs = known.where("atomic").select(*key).join(named.withColumn("ok", F.lit(True)), key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    ending = ends.join(known.select(*key, F.lit(True).alias("ok")), key, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    last = lambda df, name: df.groupBy(by).agg(F.max_by("node_id", "ord").alias(name))
    at = last(nodes, "node").join(last(runs, "run"), by, "left").select(by, F.lit("last_node_is_last_run").alias("rule"), F.coalesce(F.col("node") == F.col("run"), F.lit(False)).alias("ok"))
    return failing(links, "requirement_of_atomic").unionByName(failing(backs, "atomic_has_requirement")).unionByName(failing(ending, "ends_exist")).unionByName(at)


def draft_rules(findings: DataFrame, requirements: DataFrame, relationships: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, rule, ok) of each project's draft: ids are unique, atomic findings and requirements pair one to one, and
    relationships end in inferences."""
    unique = lambda df, key, rule: df.groupBy(by).agg(F.lit(rule).alias("rule"), (F.count_distinct(key) == F.count("*")).alias("ok"))
    key = [by, "finding_id"]
    atomic = findings.where("category = 'atomic_requirement'").groupBy(*key).agg(F.count("*").alias("a"))
    named = requirements.groupBy(*key).agg(F.count("*").alias("r"))
    pairs = atomic.join(named, key, "full_outer").groupBy(by).agg(F.lit("requirements_pair").alias("rule"), F.bool_and(F.coalesce((F.col("a") == 1) & (F.col("r") == 1), F.lit(False))).alias("ok"))
    kinds = findings.groupBy(*key).agg(F.bool_and(F.col("claim_type") == "ai_inference").alias("inferred")).withColumnRenamed("finding_id", "to_finding_id")
    ends = relationships.join(kinds, [by, "to_finding_id"], "left").groupBy(by).agg(F.lit("targets_inferred").alias("rule"), F.bool_and(F.coalesce("inferred", F.lit(False))).alias("ok"))
    out = unique(findings, "finding_id", "finding_ids_unique").unionByName(unique(requirements, "requirement_id", "requirement_ids_unique"))
    return out.unionByName(unique(relationships, "relationship_id", "relationship_ids_unique")).unionByName(pairs).unionByName(ends)


def corpus_rules(findings: DataFrame, requirements: DataFrame, pages: DataFrame, reviews: DataFrame, pairs: DataFrame, by: str = "corpus") -> DataFrame:
    """(by, rule, ok) of each evaluation corpus: unique ids, requirements one to one with atomic findings, unique pages and
    reviews, reviews bound to their page and its text, and pairs for exactly the official sources that are cited."""
    base = draft_rules(findings, requirements, findings.limit(0).select(by, F.lit("").alias("relationship_id"), F.lit("").alias("to_finding_id")), by)
    base = base.where("rule in ('finding_ids_unique', 'requirements_pair')")
    place = [by, "source_id", "page"]
    once = lambda df, rule: df.groupBy(*place).count().groupBy(by).agg(F.lit(rule).alias("rule"), F.bool_and(F.col("count") == 1).alias("ok"))
    texts = pages.groupBy(*place).agg(F.first("text").alias("_text"), F.lit(True).alias("_page"))
    bound = reviews.join(texts, place, "left")
    right = F.coalesce((F.col("decision") != "corrected") | F.col("corrected_text").eqNullSafe(F.col("_text")), F.lit(False))
    bound = bound.groupBy(by).agg(F.bool_and(F.coalesce("_page", F.lit(False))).alias("p"), F.bool_and(right).alias("t"))
    each = F.array(F.struct(F.lit("reviews_have_pages").alias("rule"), F.col("p").alias("ok")), F.struct(F.lit("corrections_are_page_texts").alias("rule"), F.col("t").alias("ok")))
    cited = findings.select(by, F.explode("source_anchors").alias("a")).where("a.source_type = 'official_interpretation'").select(by, F.col("a.source_id").alias("source_id")).distinct()
    paired = pairs.select(by, F.col("official_source_id").alias("source_id")).distinct().withColumn("_p", F.lit(True))
    equal = cited.withColumn("_c", F.lit(True)).join(paired, [by, "source_id"], "full_outer").groupBy(by).agg(F.lit("official_sources_paired").alias("rule"), F.bool_and(F.coalesce(F.col("_c") & F.col("_p"), F.lit(False))).alias("ok"))
    out = base.unionByName(once(pages, "pages_unique")).unionByName(once(reviews, "reviews_unique"))
    return out.unionByName(bound.select(by, F.inline(each))).unionByName(equal)


def exact_coverage(rows: DataFrame, declared: DataFrame, by: str, value: str, required: list[str] | None = None) -> DataFrame:
    """(by, ok): whether the distinct values in ``rows`` are exactly the declared ones, and these the required ones."""
    have = rows.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("_have"))
    want = declared.groupBy(by).agg(F.array_sort(F.collect_set(value)).alias("_want"))
    x = have.join(want, by, "full_outer")
    ok = F.col("_have") == F.col("_want")
    if required is not None:
        ok &= F.col("_want") == F.array(*(F.lit(v) for v in sorted(required)))
    return x.select(by, F.coalesce(ok, F.lit(False)).alias("ok"))


def sample_rules(samples: DataFrame) -> DataFrame:
    """(source_id, rule, ok) of a manifest's samples: unique ids, attachments exactly if the modality says so, an official
    sample pairs with a regulatory one and no other sample pairs, ground truth exactly for scans."""
    own = samples.groupBy("source_id").agg(F.count("*").alias("_n"), F.min("source_type").alias("_type"))
    x = samples.join(own.select("source_id", "_n"), "source_id").join(own.select(F.col("source_id").alias("primary_source_id"), F.col("_type").alias("_primary")), "primary_source_id", "left")
    official = F.col("source_type") == "official_interpretation"
    return long_form(
        x,
        "source_id",
        {
            "id_unique": F.col("_n") == 1,
            "attachments_iff_modality": F.array_contains("modalities", "attachment") == (F.col("n_attachments") > 0),
            "official_is_paired": F.when(official, F.col("_primary") == "regulatory_text").otherwise(F.col("primary_source_id").isNull()),
            "ground_truth_iff_scan": (F.col("file_type") == "pdf_scan") == F.col("has_ground_truth"),
        },
    )


def version_rules(versions: DataFrame, findings: DataFrame, anchors: DataFrame) -> DataFrame:
    """(version_id, rule, ok) of versions (version_id, parent_version_hash, directive_parent, source_ids, scope,
    replaced_finding_ids): lists are not empty and without repeats, what is replaced is there, all citations are of the
    version's sources, a directive names the parent, and findings are as the analysis left them."""
    proper = lambda c: (F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c))
    baseline = (F.col("claim_type") != "human_judgment") & (F.col("review_status") == "unreviewed") & (F.size("revision_records") == 0)
    f = findings.groupBy("version_id").agg(F.collect_set("finding_id").alias("_ids"), F.bool_and(baseline).alias("_baseline"))
    a = anchors.groupBy("version_id").agg(F.collect_set("source_id").alias("_cited"))
    x = versions.join(f, "version_id", "left").join(a, "version_id", "left")
    none = F.array().cast("array<string>")
    return long_form(
        x,
        "version_id",
        {
            "sources_proper": proper("source_ids"),
            "scope_proper": proper("scope"),
            "replaced_proper": proper("replaced_finding_ids"),
            "replaced_exist": within(F.col("replaced_finding_ids"), F.coalesce("_ids", none)),
            "cites_own_sources": within(F.coalesce("_cited", none), F.col("source_ids")),
            "directive_names_parent": F.col("parent_version_hash").eqNullSafe(F.col("directive_parent")),
            "findings_as_analysed": F.coalesce("_baseline", F.lit(True)),
        },
    )


def derived_version_rules(before: DataFrame, after: DataFrame, versions: DataFrame, targets: DataFrame, gone: DataFrame) -> DataFrame:
    """(version_id, rule, ok) of versions against those before them: the parent's hash, sources and scope united with the
    parent's, every target replaced with its kind kept, what was derived from targets gone, and the rest unchanged.
    ``before`` and ``after`` are findings (version_id, finding_id, kind, hash) under the new version's id."""
    b = before.select("version_id", "finding_id", F.col("kind").alias("_b_kind"), F.col("hash").alias("_b_hash"))
    key = ["version_id", "finding_id"]
    x = b.join(after, key, "full_outer").join(targets.select(*key, F.lit(True).alias("_target")), key, "left").join(gone.select(*key, F.lit(True).alias("_gone")), key, "left")
    target, lost = F.coalesce("_target", F.lit(False)), F.coalesce("_gone", F.lit(False))
    by = x.groupBy("version_id").agg(
        F.bool_and(~target | (F.col("kind") == F.col("_b_kind"))).alias("targets_keep_kind"),
        F.bool_and(~lost | target | F.col("hash").isNull()).alias("derived_are_gone"),
        F.bool_and(target | lost | (F.col("hash").eqNullSafe(F.col("_b_hash")))).alias("rest_unchanged"),
    )
    united = lambda c: F.array_sort(c) == F.array_sort(F.array_union(f"parent_{c}", f"own_{c}"))
    v = versions.join(by, "version_id", "left")
    return long_form(
        v,
        "version_id",
        {
            "parent_hash": F.col("parent_version_hash") == F.col("previous_hash"),
            "sources_united": united("source_ids"),
            "scope_united": united("scope"),
            **{c: F.coalesce(c, F.lit(True)) for c in ("targets_keep_kind", "derived_are_gone", "rest_unchanged")},
        },
    )


def unlocatable(anchors: list[DataFrame], located) -> DataFrame:
    """Citations of findings, requirements, relationships and conflicts (kind, owner_id, anchor columns) that no unit
    holds; ``located`` gives quote_ok by owner and place, as ``locate.locate_quotes`` does."""
    every = reduce(DataFrame.unionByName, anchors)
    found = located(every).where("quote_ok").select("kind", "owner_id", "anchor_ord")
    return every.join(found, ["kind", "owner_id", "anchor_ord"], "left_anti")


def parse_rules(sources: DataFrame, outcomes: DataFrame, units: DataFrame) -> DataFrame:
    """(source_id, rule, ok): whether what was parsed of a source is whole. ``outcomes`` has source_id, source_type,
    file_hash, page_count, successful_pages, n_failed, n_units, total_chars, units_digest, coverage and blocked; ``units``
    has source_id, source_type, ord, page, unit_id, text and confidence."""
    text = T.trim_ws(F.col("text"))
    body = F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))
    u = units.groupBy("source_id").agg(
        F.count("*").alias("_n"),
        F.array_join(F.filter(F.transform(body, lambda s: s["t"]), lambda t: t != ""), "\n\n").alias("_content"),
        F.sha2(F.to_json(F.transform(body, lambda s: s["t"])), 256).alias("_digest"),
        F.collect_set("page").alias("_pages"),
        F.count_if(F.col("page").isNull()).alias("_unpaged"),
        F.count_distinct("unit_id").alias("_ids"),
        F.count("unit_id").alias("_named"),
        F.bool_and(text != "").alias("_filled"),
        F.bool_and(F.coalesce(F.col("confidence") > 0, F.lit(False))).alias("_sure"),
        F.collect_set("source_type").alias("_types"),
    )
    s = sources.select("source_id", "source_type", "content")
    o = outcomes.select("source_id", *(F.col(c).alias(f"o_{c}") for c in outcomes.columns if c != "source_id"))
    x = s.join(o, "source_id", "left").join(u, "source_id", "left")
    plain = T.trim_ws(F.regexp_replace("content", "\r\n?", "\n"))
    pages = F.when(F.col("o_page_count").isNull(), (F.size("o_successful_pages") == 0) & (F.size("_pages") == 0)).otherwise(
        (F.array_sort("o_successful_pages") == F.sequence(F.lit(1), F.greatest(F.col("o_page_count"), F.lit(1))))
        & (F.col("o_page_count") > 0)
        & (F.array_sort("_pages") == F.array_sort("o_successful_pages"))
        & (F.col("_unpaged") == 0)
    )
    return long_form(
        x,
        "source_id",
        {
            "content_not_blank": T.trim_ws(F.col("content")) != "",
            "hash_is_sha256": F.col("o_file_hash").rlike("(?i)^[0-9a-f]{64}$"),
            "type_agrees": (F.col("o_source_type") == F.col("source_type")) & (F.col("_types") == F.array("source_type")),
            "no_failures": (F.col("o_n_failed") == 0) & ~F.col("o_blocked") & (F.col("o_coverage") == 1),
            "counts_agree": (F.col("o_n_units") == F.col("_n")) & (F.col("o_total_chars") == F.length("content")),
            "digest_agrees": F.col("o_units_digest") == F.col("_digest"),
            "content_is_rebuilt": plain == T.trim_ws(F.regexp_replace("_content", "\r\n?", "\n")),
            "unit_ids_unique": F.col("_ids") == F.col("_named"),
            "units_filled_and_sure": F.col("_filled") & F.col("_sure"),
            "pages_complete": pages,
        },
    )


def complete(rules: DataFrame, owners: DataFrame, key: str, by: str) -> DataFrame:
    """(by, complete): whether every rule of every entity of ``owners`` (key, by) holds, and there is one."""
    failed = rules.groupBy(key).agg(F.bool_and("ok").alias("ok"))
    return owners.join(failed, key, "left").groupBy(by).agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("complete"))


OCR_FIELDS = ("text", "confidence", "original_ocr_text", "corrected_text", "review_status", "reviewed_at", "reviewed_by")


def ocr_rules(low_pages: DataFrame, units: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_id, rule, ok): low-text pages are exactly the reviewed ones, each review has one unit with equal fields, and
    its correction is the last of its history, or there is none."""
    place = ["unit_id", "source_id", "page"]
    pages = low_pages.select("source_id", "page", F.lit(1).alias("l")).join(reviews.groupBy("source_id", "page").agg(F.count("*").alias("r")), ["source_id", "page"], "full_outer")
    pages = pages.groupBy("source_id").agg(F.lit("pages_reviewed_once").alias("rule"), F.bool_and(F.coalesce((F.col("l") == 1) & (F.col("r") == 1), F.lit(False))).alias("ok"))
    u = units.groupBy(*place).agg(F.count("*").alias("_n"), *(F.first(c).alias(f"u_{c}") for c in OCR_FIELDS))
    x = reviews.join(u, place, "left")
    last = F.element_at("correction_history", -1)
    none = F.col("corrected_text").isNull() & F.col("reviewed_at").isNull() & F.col("reviewed_by").isNull() & (F.size("correction_history") == 0)
    filled = lambda c: T.trim_ws(F.col(c)) != ""
    done = filled("corrected_text") & (F.col("text") == F.col("corrected_text")) & filled("reviewed_by") & T.utc_timestamp_valid(F.col("reviewed_at"))
    done &= F.when(F.size("correction_history") > 0, (last["text"] == F.col("corrected_text")) & (last["by"] == F.col("reviewed_by")) & (last["at"] == F.col("reviewed_at"))).otherwise(False)
    state = F.when(F.col("review_status") == "unreviewed", none).when(F.col("review_status") == "corrected", done).otherwise(False)
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"u_{c}")) for c in OCR_FIELDS))
    by = x.groupBy("source_id").agg(
        F.bool_and(F.coalesce(F.col("_n") == 1, F.lit(False))).alias("unit_of_review"), F.bool_and(same).alias("fields_agree"), F.bool_and(F.coalesce(state, F.lit(False))).alias("correction_is_last")
    )
    each = F.array(*(F.struct(F.lit(c).alias("rule"), F.col(c).alias("ok")) for c in ("unit_of_review", "fields_agree", "correction_is_last")))
    return pages.unionByName(by.select("source_id", F.inline(each)))

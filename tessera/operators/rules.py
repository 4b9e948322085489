"""Rule tables: for every entity and rule a row that says whether it holds.

``validate_findings`` is the composite: eleven rules per finding, in long form, with three outcomes. Text rules compare
claims that were extracted once per text; provenance rules join findings with their parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import locate
from tessera.sources.shared import checkpointed

#: The rules in their order, and closed sets of values.
RULES = (
    "source_id",
    "source_type",
    "locator_page",
    "locator_paragraph",
    "locator_article",
    "quote_match",
    "atomic_structure",
    "modal_strength",
    "dates",
    "numbers",
    "inference_parent",
)
CLAIM_TYPES = ("regulatory_fact", "official_explanation", "ai_inference", "human_judgment", "pending_confirmation")
REVIEW_STATUSES = ("pending", "confirmed", "modified", "deleted")
REQUIRED_TYPE = {"regulatory_fact": "regulatory_text", "official_explanation": "official_interpretation"}
OFFICIAL_LABELS = {
    "official_context:policy_background": "政策背景",
    "official_context:regulatory_intent": "监管意图",
    "official_context:implementation_guidance": "实施说明",
}
OFFICIAL_FORM = "官方解读材料摘录（%s）：“%s”。该摘录仅作为官方说明材料，不建立或覆盖监管文件效力、适用性或其他法律结论，须经人工合规复核。"


#: Rows that may be broadcast once they are counted.
FEW = 100_000


def long_form(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, ok) for each row of ``df``; an unknown outcome is a failure."""
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("ok")) for n, c in rules.items()))
    return df.select(F.col(key), F.explode(each).alias("r")).select(key, "r.rule", "r.ok")


def tallied(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, ok, n): the rows of ``long_form`` counted. Rules are counted side by side and unfolded after, so one row of a key is
    shuffled and not one for each rule."""
    by = df.groupBy(key).agg(F.count("*").alias("_rows"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"_ok_{k}") for k, c in enumerate(rules.values())))
    held = lambda k, ok: F.col(f"_ok_{k}") if ok else F.col("_rows") - F.col(f"_ok_{k}")
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(ok).alias("ok"), held(k, ok).alias("n")) for k, name in enumerate(rules) for ok in (True, False)))
    return by.select(key, F.explode(F.filter(each, lambda x: x["n"] > 0)).alias("r")).select(key, "r.*")


def finding_rules(findings: DataFrame) -> DataFrame:
    """Row rules of findings: what each claim type must cite, and closed values."""
    claim, anchors = F.col("claim_type"), F.col("source_anchors")
    needs = lambda kind, ok: (claim != kind) | ok
    revised = F.size("revision_records") > 0
    return long_form(
        findings,
        "finding_id",
        {
            "fact_cites_regulation": needs("regulatory_fact", F.exists(anchors, lambda a: a["source_type"] == "regulatory_text")),
            "explanation_cites_official": needs("official_explanation", F.exists(anchors, lambda a: a["source_type"] == "official_interpretation")),
            "inference_has_parents": needs("ai_inference", F.size("inference_parents") > 0),
            "judgment_has_revision": needs("human_judgment", revised),
            "deleted_has_revision": (F.col("review_status") != "deleted") | revised,
            "claim_type_known": claim.isin(*CLAIM_TYPES),
            "review_status_known": F.col("review_status").isin(*REVIEW_STATUSES),
            "not_blank": (T.trim_ws(F.col("finding_id")) != "") & (T.trim_ws(F.col("statement")) != ""),
        },
    )


def unique_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that more than one row bears."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def reference_integrity(children: DataFrame, parents: DataFrame, key: str, matches: list[str]) -> DataFrame:
    """``children`` with key_found and fields_match: whether ``parents`` has their key, and equal ``matches`` there."""
    p = parents.select(key, *(F.col(c).alias(f"_p_{c}") for c in matches), F.lit(True).alias("_found"))
    same = F.lit(True)
    for c in matches:
        same &= F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    joined = children.join(p, key, "left")
    found = F.coalesce("_found", F.lit(False))
    return joined.withColumns({"key_found": found, "fields_match": found & same}).drop("_found", *(f"_p_{c}" for c in matches))


def upstream_parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(child, parent, exists, not_self, upstream) of each edge: the parent must stand before the child in ``ord``."""
    c = nodes.select(F.col("node").alias("child"), F.col("ord").alias("child_ord"))
    p = nodes.select(F.col("node").alias("parent"), F.col("ord").alias("parent_ord"))
    return edges.join(c, "child", "left").join(p, "parent", "left").select(
        "child",
        "parent",
        F.col("parent_ord").isNotNull().alias("exists"),
        (F.col("child") != F.col("parent")).alias("not_self"),
        F.coalesce(F.col("parent_ord") < F.col("child_ord"), F.lit(False)).alias("upstream"),
    )


def anchor_key(a: Column) -> Column:
    return F.to_json(F.struct(a["source_id"], a["source_type"], a["page"], a["article"], a["paragraph_index"], a["quote"]), {"ignoreNullFields": "false"})


def parents_of(findings: DataFrame) -> DataFrame:
    """A row per named parent, with the parent's columns as ``p``, or null. Only findings that are named bring their texts: where
    they are at most ``FEW``, their ids are broadcast, and other findings stay where they are."""
    named = findings.select("finding_id", F.posexplode("inference_parents").alias("parent_ord", "parent_id"))
    ids = named.select(F.col("parent_id").alias("finding_id")).distinct()
    asked = findings
    if ids.limit(FEW + 1).count() <= FEW:
        asked = findings.join(F.broadcast(ids), "finding_id", "left_semi")
    known = asked.select(F.col("finding_id").alias("parent_id"), F.struct("statement", "claim_type", "source_anchors").alias("p"))
    return named.join(known, "parent_id", "left")


def has_parents() -> Column:
    return F.coalesce(F.size("inference_parents") > 0, F.lit(False))


def infers() -> Column:
    """Whether a finding is an inference that names a parent."""
    return F.coalesce((F.col("claim_type") == "ai_inference") & has_parents(), F.lit(False))


def with_more(findings: DataFrame) -> DataFrame:
    """``findings`` with ``more``: of inferences the statements and quotes of the parents, in order, else null. Only
    inferences that name parents are joined."""
    parts = F.concat(F.array("p.statement"), F.transform("p.source_anchors", lambda a: a["quote"]))
    named = parents_of(findings.withColumn("inference_parents", F.when(infers(), F.col("inference_parents"))))
    inferred = (
        named.where("p.claim_type is not null")
        .groupBy("finding_id")
        .agg(F.array_sort(F.collect_list(F.struct("parent_ord", parts.alias("t")))).alias("_p"))
        .select("finding_id", F.flatten("_p.t").alias("more"))
    )
    alone = findings.where(~infers()).withColumn("more", F.lit(None).cast("array<string>"))
    return alone.unionByName(findings.where(infers()).join(inferred, "finding_id", "left"))


def evidence_texts(findings: DataFrame) -> DataFrame:
    """(finding_id, evidence): own quotes, and for inferences also the statements and quotes of the parents, in order."""
    own = F.transform("source_anchors", lambda a: a["quote"])
    none = F.array().cast("array<string>")
    return with_more(findings).select("finding_id", F.array_join(F.concat(own, F.coalesce("more", none)), "\n").alias("evidence"))


def parents_judged(findings: DataFrame, located: DataFrame, pairs: DataFrame) -> DataFrame:
    """(finding_id, inference_ok) of findings that name parents."""
    by_finding = located.groupBy("finding_id").agg(F.bool_and("quote_ok").alias("all_located"))
    p = (
        parents_of(findings)
        .join(by_finding.withColumnRenamed("finding_id", "parent_id"), "parent_id", "left")
        .groupBy("finding_id")
        .agg(
            F.count("*").alias("n_parents"),
            F.bool_and(F.col("p").isNotNull() & (F.col("parent_id") != F.col("finding_id"))).alias("parents_exist"),
            F.bool_and(
                F.coalesce(
                    F.col("p.claim_type").isin("regulatory_fact", "pending_confirmation")
                    & (F.size("p.source_anchors") > 0)
                    & F.forall("p.source_anchors", lambda a: a["source_type"] == "regulatory_text")
                    & F.col("all_located"),
                    F.lit(False),
                )
            ).alias("parents_regulatory"),
            F.array_distinct(F.flatten(F.collect_list(F.transform("p.source_anchors", anchor_key)))).alias("parent_keys"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("p.source_anchors", lambda a: a["source_id"].cast("string")))))).alias("parent_sources"),
        )
    )
    named = pairs.select(F.col("official_source_id").alias("source_id"), F.col("primary_source_ids").cast("array<string>").alias("primary_source_ids"))
    paired = (
        locate.explode_anchors(findings.where((F.col("claim_type") == "official_explanation") & has_parents()))
        .join(named, "source_id", "left")
        .groupBy("finding_id")
        .agg(F.collect_list(F.coalesce("primary_source_ids", F.array().cast("array<string>"))).alias("allowed"))
    )
    x = findings.where(has_parents()).join(p, "finding_id", "left").join(paired, "finding_id", "left")
    n = F.coalesce("n_parents", F.lit(0))
    exact = F.forall("allowed", lambda ids: (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.array_sort(ids) == F.col("parent_sources")))
    cited = F.size("source_anchors") > 0
    ok = (
        F.when(F.col("claim_type") == "official_explanation", (n > 0) & F.col("parents_exist") & F.col("parents_regulatory") & F.coalesce(exact, F.lit(False)))
        .when(n == 0, F.col("claim_type") != "ai_inference")
        .when(F.col("claim_type") != "ai_inference", F.col("parents_exist"))
        .otherwise(F.col("parents_exist") & cited & (F.size(F.array_except(F.transform("source_anchors", anchor_key), "parent_keys")) == 0))
    )
    return x.select("finding_id", F.coalesce(ok, F.lit(False)).alias("inference_ok"))


def may_stand_alone() -> Column:
    """Whether a finding without parents may have none."""
    return F.coalesce(~F.col("claim_type").isin("official_explanation", "ai_inference"), F.lit(False))


def provenance(findings: DataFrame, located: DataFrame, pairs: DataFrame) -> DataFrame:
    """(finding_id, inference_ok). An inference names other findings as parents, and cites only what they cite. An
    explanation names regulatory facts or pending findings whose citations are all located, of exactly the sources that
    the official sources it cites are paired with. Others need only name parents that exist. Findings without parents are
    judged by their claim type alone, without a join."""
    alone = findings.where(~has_parents()).select("finding_id", may_stand_alone().alias("inference_ok"))
    return parents_judged(findings, located, pairs).unionByName(alone)


def claim_rules(findings: DataFrame) -> DataFrame:
    """(finding_id, category, modal_ok, dates_ok, numbers_ok, alone_ok): whether statement and evidence agree in obligation words,
    dates and numbers, and whether the finding may have no parents. Dates and numbers must also stand in one quote in the same words around them."""
    quotes, kind = F.transform("source_anchors", lambda a: a["quote"]), F.col("claim_type")
    form = F.create_map(*(F.lit(v) for kv in OFFICIAL_LABELS.items() for v in kv))[F.col("category")]
    excerpt = F.get(F.col("source_anchors"), F.lit(0))["quote"]
    excerpted = (F.size("source_anchors") == 1) & (F.col("statement") == F.format_string(OFFICIAL_FORM, form, excerpt))
    excerpted = F.when(kind == "official_explanation", excerpted).alias("excerpted")
    x = with_more(findings).select("finding_id", "claim_type", "category", excerpted, T.claims_kept(F.col("statement"), kind, quotes, F.col("more")).alias("k"))
    modal = F.when(kind.isin("ai_inference", "human_judgment"), F.lit(True)).when(kind == "official_explanation", F.col("excerpted")).otherwise(F.col("k.modal_kept"))
    return x.select(
        "finding_id",
        "category",
        F.coalesce(modal, F.lit(False)).alias("modal_ok"),
        F.col("k.dates_kept").alias("dates_ok"),
        F.col("k.numbers_kept").alias("numbers_ok"),
        may_stand_alone().alias("alone_ok"),
    )


def validate_findings(findings: DataFrame, sources: DataFrame, units: DataFrame, pairs: DataFrame, structures: DataFrame | None = None) -> DataFrame:
    """(finding_id, rule, rule_ord, status, passed): the rules of all findings. ``structures`` (finding_id, status,
    strength_review), as ``checks.atomic_structure`` gives it, has the outcome for atomic requirements; those without one
    fail, and other findings pass."""
    a = locate.explode_anchors(findings)
    known = a.join(locate.unique_sources(sources), "source_id", "left")
    want = F.create_map(*(F.lit(v) for kv in REQUIRED_TYPE.items() for v in kv))[F.col("claim_type")]
    known = known.select(
        "finding_id",
        (F.coalesce("n_sources", F.lit(0)) == 1).alias("id_ok"),
        F.coalesce((F.col("source_type") == F.col("known_type")) & F.coalesce(F.col("source_type") == want, F.lit(True)), F.lit(False)).alias("type_ok"),
    )
    valid = locate.authorized_units(units, sources, normal="normal_text").select("source_id", "page", "paragraph_index", "article", "normal_text")
    valid = checkpointed(valid)  # its pages and its texts are joined apart
    located = locate.locate_quotes(a, valid)
    e = locate.every(known, claim_rules(findings), "finding_id", ["id_ok", "type_ok"])
    e = locate.every(located, e, "finding_id", ["page_ok", "paragraph_ok", "article_ok", "quote_ok"])
    e = e.join(parents_judged(findings, located, pairs), "finding_id", "left")
    atomic = F.col("category") == "atomic_requirement"
    if structures is None:
        e = e.withColumns({"structure": F.when(atomic, "failed").otherwise("passed"), "review": F.lit(False)})
    else:
        e = e.join(structures.select("finding_id", F.col("status").alias("_s"), F.col("strength_review").alias("_r")), "finding_id", "left")
        e = e.withColumns(
            {"structure": F.when(atomic, F.coalesce("_s", F.lit("failed"))).otherwise("passed"), "review": F.coalesce("_r", F.lit(False))}
        )
    plain = lambda c: F.when(c, "passed").otherwise("failed")
    modal = F.when(~F.col("modal_ok"), "failed").when(atomic & F.col("review"), "manual_review_required").when(atomic, F.col("structure")).otherwise("passed")
    status = {
        "source_id": plain(F.col("id_ok")),
        "source_type": plain(F.col("id_ok") & F.col("type_ok")),
        "locator_page": plain(F.col("page_ok")),
        "locator_paragraph": plain(F.col("paragraph_ok")),
        "locator_article": plain(F.col("article_ok")),
        "quote_match": plain(F.col("quote_ok")),
        "atomic_structure": F.col("structure"),
        "modal_strength": modal,
        "dates": plain(F.col("dates_ok")),
        "numbers": plain(F.col("numbers_ok")),
        "inference_parent": plain(F.coalesce("inference_ok", "alone_ok")),
    }
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(k).alias("rule_ord"), status[n].alias("status")) for k, n in enumerate(RULES)))
    rows = e.select("finding_id", F.explode(each).alias("r")).select("finding_id", "r.*")
    return rows.withColumn("passed", F.col("status") == "passed")


def tilings(fields: DataFrame, texts: DataFrame, in_order: int = 0) -> DataFrame:
    """(req_id, n_tilings): in how many ways the fields of a requirement cover its text exactly once, each once; the fields
    below ``in_order`` must all be there and stand in the order of their numbers.

    ``fields`` has req_id, field (a number from 0) and value; ``texts`` has req_id and text. Each round extends every
    partial cover by one field that starts where the cover ends, so a round is an equi-join on requirement and place; the
    number of rounds is the number of fields. A text whose length is not the sum of its fields' has none."""
    size = fields.groupBy("req_id").agg(F.sum(F.length("value")).alias("total"), F.count("*").alias("n"), F.count_if(F.col("field") < in_order).alias("core"))
    open_ = texts.join(size, "req_id").where((F.length("text") == F.col("total")) & (F.col("n") > 0) & (F.col("core") == in_order))
    open_ = checkpointed(open_)
    most = open_.agg(F.max("n")).first()[0] or 0
    near = fields.join(open_.select("req_id", "text"), "req_id")
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.length("text") - F.length("value"), F.lit(0))),
        lambda i: F.substr(F.col("text"), i + 1, F.length("value")) == F.col("value"),
    )
    spans = near.where("length(value) > 0").select("req_id", F.col("field").cast("int").alias("field"), F.explode(starts).alias("at"), F.length("value").alias("len"))
    spans = checkpointed(spans)
    covers = open_.select("req_id", F.lit(0).alias("at"), F.array().cast("array<int>").alias("used"), F.lit(1).cast("long").alias("ways"), "total")
    whole = F.col("at") == F.col("total")
    fits = ~F.array_contains("used", F.col("field"))
    if in_order:
        fits &= (F.col("field") == 0) | (F.col("field") >= in_order) | F.array_contains("used", F.col("field") - 1)
    for _ in range(most):  # no span starts where a cover is whole, so the left join keeps it as it is
        longer = covers.join(spans, ["req_id", "at"], "left").where(whole | fits)
        longer = longer.select(
            "req_id",
            F.when(whole, F.col("at")).otherwise(F.col("at") + F.col("len")).alias("at"),
            F.when(whole, F.col("used")).otherwise(F.array_sort(F.array_append("used", F.col("field")))).alias("used"),
            "ways",
            "total",
        )
        covers = longer.groupBy("req_id", "at", "used", "total").agg(F.sum("ways").alias("ways"))
    found = covers.where("at = total").groupBy("req_id").agg(F.sum("ways").alias("n_tilings"))
    return texts.select("req_id").join(found, "req_id", "left").select("req_id", F.coalesce("n_tilings", F.lit(0)).cast("long").alias("n_tilings"))

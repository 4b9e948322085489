"""Registered queries of responses, reviews, reports, sources and sessions, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import attest, chunk, evaluate, locate, merge, produce, report, review, rules
from tessera.plans.queries import _MATCHED, _TRIM, _UNITS, _WS, big, corpora, query, rounded, table, units_of
from tessera.sources import ingest, sinks
from tessera.sources.shared import new_path

ANCHORS = "array<struct<source_id:string,source_type:string,quote:string>>"


def cite(kind, quote, source="S"):
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.array(F.struct(F.lit(source).alias("source_id"), kind.alias("source_type"), quote.alias("quote")))


def nothing():
    return F.array().cast("array<string>")


def talk(spark, d):
    """Turns of conversations with an id of their own."""
    t = table(spark, d, "conversations")
    return t.withColumn("id", F.concat_ws("-", "conv_id", "turn"))


# -- labels ------------------------------------------------------------------------------------------------------

_KINDS = ("atomic_requirement", "pending_confirmation:atomic_conflict:1", "document_identity:deadline", "official_context:x", "pending_confirmation:file_profile", "institution_impact:data", "institution_impact:other", "recommended_action:priority", "key_matter:prohibition")


@query(f"""with o as (select o_orderkey, {list(_KINDS)}[o_orderkey % 9 + 1] as c, case when o_orderkey % 4 = 0 then 'ai_inference' when o_orderkey % 4 = 1 then 'regulatory_fact' else 'human_judgment' end as t from orders)
select o_orderkey, case when c = 'atomic_requirement' or c like '%atomic_conflict%' then 'atomic_clauses' when c like 'document_identity:%' or c like 'official_context:%' or c like '%file_profile' then 'document_identity'
    when t = 'ai_inference' or c = 'institution_impact:data' then 'institution_impact' else 'key_matters' end as stage,
  case when c = 'institution_impact:data' then 'data' end as dimension, c = 'institution_impact:other' or (c = 'institution_impact:data' and t <> 'ai_inference') as invalid_impact,
  case when c = 'recommended_action:priority' then 'recommended_action' end as purpose, case t when 'ai_inference' then 'AI推导' when 'regulatory_fact' then '监管原文' else '人工判断' end as label,
  o_orderkey % 10 = 0 as reserved from o""")
def finding_labels(spark, d):
    i = F.col("o_orderkey")
    claim = F.when(i % 4 == 0, "ai_inference").when(i % 4 == 1, "regulatory_fact").otherwise("human_judgment")
    o = table(spark, d, "orders").select(i, F.get(F.array(*map(F.lit, _KINDS)), (i % 9).cast("int")).alias("c"), claim.alias("t"), F.concat(F.when(i % 10 == 0, "SYS-").otherwise("F-"), i).alias("id"))
    c, t = F.col("c"), F.col("t")
    return o.select(
        i, produce.stage_of(c, t).alias("stage"), report.dimension_of(c).alias("dimension"), report.invalid_impact(c, t).alias("invalid_impact"),
        report.purpose_of(c).alias("purpose"), report.claim_label(t).alias("label"), produce.is_reserved(F.col("id")).alias("reserved"),
    )


@query("select doc_id, case doc_id % 4 when 0 then 'should' when 1 then 'must' when 2 then 'strict_prohibit' end as modal, doc_id % 3 = 0 as utc, doc_id % 2 = 0 as in_order from documents")
def small_forms(spark, d):
    """The class of an obligation word, whether a time is UTC, and whether tokens stand in order."""
    i = F.col("doc_id")
    word = F.when(i % 4 == 0, " 应 ").when(i % 4 == 1, "必须").when(i % 4 == 2, "严禁").otherwise(F.col("lang"))
    time = F.concat(F.lit("2026-01-0"), (i % 9 + 1).cast("string"), F.when(i % 3 == 0, "T10:00:00Z").when(i % 3 == 1, "T25:00:00Z").otherwise(" 10:00"))
    told = F.when(i % 2 == 0, F.array(F.lit("a"), F.col("lang"), F.lit("b"))).otherwise(F.array(F.lit("b"), F.col("lang"), F.lit("a")))
    return table(spark, d, "documents").select(i, T.modal_class(word).alias("modal"), T.utc_timestamp_valid(time).alias("utc"), T.in_order(F.array(F.lit("a"), F.lit("b")), told).alias("in_order"))


# -- responses ---------------------------------------------------------------------------------------------------


@query("select conv_id || '-' || turn as id, turn % 2 = 0 and turn % 3 <> 0 as exact from conversations")
def exact_facts(spark, d):
    t = F.col("turn")
    kind = F.when(t % 2 == 0, "regulatory_text").otherwise("official_interpretation")
    quote = F.when(t % 3 == 0, F.lit("")).otherwise(F.col("text"))
    return talk(spark, d).select("id", produce.exact_fact(F.col("text"), cite(kind, quote)).alias("exact"))


@query("""select doc_id::varchar as source_doc, case when doc_id % 5 = 0 then 'reserved id' when doc_id % 5 = 1 then 'not a regulation' when doc_id % 5 = 2 then 'value is not quoted' end as refused from documents""")
def identity_extractions(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(
        F.concat(F.when(i % 5 == 0, "SYS-").otherwise("F-"), i).alias("finding_id"), F.lit("deadline").alias("kind"),
        F.when(i % 5 == 2, F.lit("|nowhere|")).otherwise(F.concat(F.lit("ＱＱ "), F.lit("7"))).alias("value"),
        cite(F.when(i % 5 == 1, "official_interpretation").otherwise("regulatory_text"), F.concat("text", F.lit(" QQ7"))).alias("source_anchors"),
    )
    return produce.identity_findings(x).select(F.substring_index("finding_id", "-", -1).alias("source_doc"), "refused")


@query("""select conv_id || '-' || turn as finding_id, case when turn % 6 = 1 then 'not one official citation' when turn % 6 = 2 then 'excerpt is not the quote' when turn % 6 = 3 then 'parent named twice' when turn % 6 = 4 then 'parent is not paired' end as refused,
case when turn % 6 in (0, 5) then '官方解读材料摘录（监管意图）：“' || text || '”。该摘录仅作为官方说明材料，不建立或覆盖监管文件效力、适用性或其他法律结论，须经人工合规复核。' end as statement from conversations""")
def official_excerpts(spark, d):
    t = F.col("turn")
    own = F.concat(F.lit("p"), "conv_id")
    x = talk(spark, d).select(
        F.col("id").alias("finding_id"), F.lit("regulatory_intent").alias("kind"), F.when(t % 6 == 2, "else").otherwise(F.col("text")).alias("excerpt"),
        cite(F.when(t % 6 == 1, "regulatory_text").otherwise("official_interpretation"), F.col("text")).alias("source_anchors"),
        F.when(t % 6 == 3, F.array(own, own)).when(t % 6 == 4, F.array(F.lit("gone"))).otherwise(F.array(own)).alias("parents"),
    )
    primaries = talk(spark, d).select(own.alias("finding_id"))
    return produce.official_findings(x, primaries).select("finding_id", "refused", "statement")


def impact_items(spark, d):
    i = F.col("o_orderkey")
    o = table(spark, d, "orders")
    items = o.select(
        i.cast("string").alias("item_id"), F.when(i % 5 == 0, "money").otherwise("data").alias("dimension"), F.array((F.when(i % 3 == 0, F.lit(-1)).otherwise(F.col("o_custkey"))).cast("string")).alias("parents"),
        cite("regulatory_text", F.when(i % 7 == 0, "beyond").otherwise("q")).alias("source_anchors"),
    )
    upstream = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("finding_id"), cite("regulatory_text", F.lit("q")).alias("source_anchors"))
    return produce.impacts(items, upstream)


_IMPACT = """i as (select o_orderkey as k, case when o_orderkey % 5 = 0 then 'unknown dimension' when o_orderkey % 3 = 0 or c_custkey is null then 'parent is not upstream'
  when o_orderkey % 7 = 0 then 'cites beyond its parents' end as refused from orders left join customer on c_custkey = o_custkey)"""


@query(f"with {_IMPACT} select k::varchar as finding_id, refused from i")
def structured_impacts(spark, d):
    return impact_items(spark, d)[0].select("finding_id", "refused")


@query(f"with {_IMPACT} select 'rel:' || k as relationship_id, k::varchar as to_finding_id from i where refused is null")
def impact_relationships(spark, d):
    return impact_items(spark, d)[1].select("relationship_id", "to_finding_id")


@query("select event_id as node_id, event_type as stage from events where event_type in ('click', 'error')")
def selected_stages(spark, d):
    plan = table(spark, d, "events").select(F.col("event_id").alias("node_id"), F.col("event_type").alias("stage"))
    return produce.selected_stages(plan, ["click", "error"])


@query("""select conv_id || '-' || turn as node_id, case when turn % 5 = 1 then 'no JSON' when turn % 5 = 2 then 'kind is known' when turn % 5 = 3 then 'text is not empty' end as refused, case when turn % 5 in (0, 4) then length(text)::bigint end as n from conversations""")
def parsed_responses(spark, d):
    t = F.col("turn")
    body = F.to_json(F.struct(F.when(t % 5 == 2, "z").otherwise("a").alias("kind"), F.when(t % 5 == 3, "").otherwise(F.col("text")).alias("said")))
    content = F.when(t % 5 == 1, "no answer").otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n``` done")))
    x = talk(spark, d).select(F.col("id").alias("node_id"), content.alias("content"))
    found = produce.parse_responses(x, "kind string, said string", {"kind is known": F.col("kind").isin("a", "b"), "text is not empty": F.col("said") != ""})
    return found.select("node_id", "refused", F.when(F.col("refused").isNull(), F.length("row.said")).cast("long").alias("n"))


@query("""with x as (select conv_id || '-' || turn as node_id, turn % 7 as k, length(text)::bigint as n from conversations)
select node_id, case when k = 5 then 'no JSON' when k = 6 then 'kind is known' end as refused, case when k < 5 then n end as n from x""")
def noisy_responses(spark, d):
    """Answers with brackets that open nothing before the object that counts, fenced or bare, and an answer of brackets alone."""
    t = F.col("turn") % 7
    body = F.to_json(F.struct(F.when(t == 6, "z").otherwise("a").alias("kind"), F.col("text").alias("said")))
    around = {0: ("see [1, note] then ", ""), 1: ("use { first, then ", " or ]"), 2: ("a {x] } ", ""), 3: ("```JSON\n", "\n```"), 4: ("[NaN] ", " [1]")}
    content = F.when(t == 5, "[[{ no answer ]").otherwise(body)
    for k, (before, after) in around.items():
        content = F.when(t == k, F.concat(F.lit(before), body, F.lit(after))).otherwise(content)
    x = talk(spark, d).select(F.col("id").alias("node_id"), content.alias("content"))
    found = produce.parse_responses(x, "kind string, said string", {"kind is known": F.col("kind").isin("a", "b")})
    return found.select("node_id", "refused", F.when(F.col("refused").isNull(), F.length("row.said")).cast("long").alias("n"))


@query()
def extracted_claims(spark, d):
    """What the rule extractor finds in every document, counted by kind."""
    found = produce.extract(table(spark, d, "documents").select(F.col("doc_id").alias("node_id"), "text"))
    return found.groupBy(F.col("node_id").cast("long").alias("doc_id"), "kind").agg(F.count("*").alias("n"))


@query("""with f as (select l_orderkey as n, l_linenumber as k from lineitem group by all), r as (select l_orderkey as n, l_linenumber as k, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as j from lineitem where l_linenumber <> 3),
c as (select n, k, count(*) as m from r group by all)
select n || '-' || k as requirement_id, rule, ok, count(*)::bigint as rows from r join c using (n, k), (select unnest(['one_to_one', 'finding_is_atomic', 'cites_regulations', 'cites_within', 'lacking_is_pending']) as rule),
lateral (select case rule when 'one_to_one' then m = 1 when 'finding_is_atomic' then k % 4 <> 0 when 'cites_regulations' then k % 5 <> 0 when 'cites_within' then k % 5 <> 0 and k % 6 <> 0 else k % 2 = 0 end as ok) group by all""")
def atomic_responses(spark, d):
    k = F.col("l_linenumber")
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("node_id"), k, F.concat_ws("-", "l_orderkey", k).alias("finding_id"))
    findings = x.distinct().select("node_id", "finding_id", F.when(k % 4 == 0, "x").otherwise("atomic_requirement").alias("category"), F.when(k % 2 == 0, "pending_confirmation").otherwise("regulatory_fact").alias("claim_type"), cite("regulatory_text", F.lit("q")).alias("source_anchors"))
    own = cite(F.when(k % 5 == 0, "official_interpretation").otherwise("regulatory_text"), F.when(k % 6 == 0, "z").otherwise("q"))
    requirements = x.where("l_linenumber <> 3").select("node_id", "finding_id", F.col("finding_id").alias("requirement_id"), own.alias("source_anchors"), F.array(F.lit("object")).alias("missing_facts"))
    return produce.atomic_response_rules(findings, requirements, form=rules.tallied).withColumnRenamed("n", "rows")


@query("""select o_orderkey::varchar as conflict_id, unnest(['sides_known', 'other_side_explains', 'sides_are_paired', 'cites_within_both', 'cites_both_kinds']) as rule,
unnest([c_custkey is not null, o_orderkey % 2 = 0, c_custkey is not null and o_orderkey % 3 <> 0, c_custkey is not null and o_orderkey % 5 <> 0, true]) as ok from orders left join customer on c_custkey = o_custkey""")
def conflict_responses(spark, d):
    i = F.col("o_orderkey")
    o = table(spark, d, "orders")
    reg, off = cite("regulatory_text", F.lit("q")), cite("official_interpretation", F.lit("p"))
    owner = F.col("o_custkey").cast("string")
    conflicts = o.select(i.cast("string").alias("conflict_id"), owner.alias("regulatory_finding_id"), i.cast("string").alias("interpretation_finding_id"), F.when(i % 5 == 0, F.concat(reg, cite("official_interpretation", F.lit("z")))).otherwise(F.concat(reg, off)).alias("source_anchors"))
    current = o.select(i.cast("string").alias("finding_id"), F.when(i % 2 == 0, "official_explanation").otherwise("x").alias("claim_type"), F.when(i % 3 == 0, F.array(F.lit("?"))).otherwise(F.array(owner)).alias("inference_parents"), off.alias("source_anchors"))
    primaries = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("finding_id"), F.lit("regulatory_fact").alias("claim_type"), nothing().alias("inference_parents"), reg.alias("source_anchors"))
    return produce.conflict_response_rules(conflicts, current, primaries)


@query("""select 'C' || o_orderkey as finding_id, o_custkey as project_id, 'pending_confirmation:source_conflict' as category, '待确认：' || o_orderpriority as statement from orders where o_orderkey % 4 = 0
union all select 'SYS-PENDING-FILE-PROFILE', c_custkey, 'pending_confirmation:file_profile', '待确认：上传材料的官方来源状态、发布日期、当前效力/生效或废止状态，以及对具体机构的适用性维度（机构类型、业务范围、地域和主体画像）未由已提供资料完整建立。' from customer""")
def pending_findings(spark, d):
    c = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.concat(F.lit("C"), "o_orderkey").alias("conflict_id"), F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("summary"), F.lit("r").alias("regulatory_finding_id"), F.lit("o").alias("interpretation_finding_id"))
    return produce.pending_findings(c, table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))).drop("inference_parents")


_PAIRS = """p as (select distinct o_custkey as a, o_orderkey % 2000 as b from orders), k as (select c_custkey as i, case when c_custkey % 2 = 0 then 'o' else 'r' end as t from customer),
x as (select p.a, p.b, case when ka.i is null or kb.i is null then 'unknown source' when ka.t <> 'o' then 'not official' when kb.t <> 'r' then 'not a regulation' end as why from p left join k ka on ka.i = p.a left join k kb on kb.i = p.b)"""


@query(f"with {_PAIRS} select a as official_source_id, b as primary_source_id, why from x")
def normalized_pairs(spark, d):
    pairs = table(spark, d, "orders").select(F.col("o_custkey").alias("official_source_id"), (F.col("o_orderkey") % 2000).alias("primary_source_id"))
    kind = F.when(F.col("c_custkey") % 2 == 0, "official_interpretation").otherwise("regulatory_text")
    good, bad = produce.normalized_pairs(pairs, table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), kind.alias("source_type")))
    return good.withColumn("why", F.lit(None).cast("string")).unionByName(bad)


@query("""select c_custkey as source_id, coalesce(bool_and(o_orderkey % 4 <> 0), false) as ok from customer left join orders on o_custkey = c_custkey where c_custkey % 2 = 0 group by c_custkey""")
def pairing_checks(spark, d):
    i = F.col("c_custkey")
    samples = table(spark, d, "customer").select(i.alias("source_id"), F.when(i % 2 == 0, "official_interpretation").otherwise("regulatory_text").alias("source_type"), F.lit("p").alias("primary_source_id"))
    corpora = table(spark, d, "orders").select(F.col("o_orderkey").alias("corpus"), F.col("o_custkey").alias("official_source_id"), F.when(F.col("o_orderkey") % 4 == 0, "q").otherwise("p").alias("primary_source_id"))
    return produce.pairing_checks(samples, corpora)


@query(f"""with {_UNITS}, c as (select source_id, paragraph_index // 3 as chunk, string_agg(text, chr(10) order by paragraph_index) as text from units where paragraph_index % 2 = 0 group by all)
select c.source_id || ':' || chunk as chunk_id, u.source_id, u.paragraph_index from c join units u on u.source_id = c.source_id and contains(c.text, u.text)""")
def chunk_locators(spark, d):
    u = units_of(spark, d)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "text"))), lambda s: s["text"]), "\n")
    c = u.where("paragraph_index % 2 = 0").groupBy("source_id", F.floor(F.col("paragraph_index") / 3).alias("c")).agg(body.alias("text"))
    return produce.chunk_locators(c.select(F.concat_ws(":", "source_id", "c").alias("chunk_id"), "source_id", "text"), u)


@query("""with n as (select conv_id, arg_max(text, turn) as said, list_sort(list(distinct conv_id || '-' || turn)) as ids from conversations group by conv_id),
s as (select conv_id, list_sort(list(distinct sha256(text))) as hs from conversations where turn % 2 = 0 group by conv_id)
select n.conv_id as node_id, sha256(said) as response_hash, sha256('["' || array_to_string(hs, '","') || '"]') as scope_hash, sha256('["' || array_to_string(ids, '","') || '"]') as output_hash from n left join s using (conv_id)""")
def run_log(spark, d):
    t = talk(spark, d).withColumnRenamed("conv_id", "node_id")
    said = t.groupBy("node_id").agg(F.max_by("text", "turn").alias("content"))
    return produce.run_log(t.select("node_id", F.col("id").alias("finding_id")), said, t.where("turn % 2 = 0").select("node_id", "text")).drop("output_ids")


@query("select user_id as node_id, max(event_id) as seq from events where value > 10 group by user_id")
def saved_runs(spark, d):
    """Runs written and read back: those that are valid, the last of each node."""
    path = new_path(spark, "runs")
    table(spark, d, "events").select(F.col("user_id").alias("node_id"), F.col("event_id").alias("seq"), "value").write.parquet(path)
    return produce.saved_runs(spark, path, F.col("value") > 10).select("node_id", "seq")


@query("""with t as (select conv_id, turn, role, text, conv_id * 1000 + turn as ord from conversations), q as (select conv_id, turn, role, dense_rank() over (partition by conv_id order by first) as v from (
  select conv_id, turn, role, min(turn) over (partition by conv_id, role) as first from t)), n as (select conv_id, max(v) as v from q group by conv_id)
select 'findings' as part, (select count(*) from n) + (select sum(v - 1) from n) + (select count(distinct conv_id) from t)::bigint as n union all select 'requirements', (select sum(v) from n)::bigint union all select 'relationships', (select count(*) from n)::bigint""")
def finalized_draft(spark, d):
    """Each conversation is an atomic finding with a requirement per turn; roles differ in structure and become variants."""
    t = table(spark, d, "conversations")
    name = F.col("conv_id").cast("string")
    blank = [F.lit(None).cast("string").alias(c) for c in merge.STRUCTURE if c != "subject"]
    none = F.array().cast(ANCHORS)
    one = t.groupBy("conv_id").agg(F.min("text").alias("statement"))
    shape = lambda df, category, statement, order: df.select(
        name.alias("finding_id"), F.lit("regulatory_fact").alias("claim_type"), category.alias("category"), statement.alias("statement"), none.alias("source_anchors"), nothing().alias("inference_parents"), F.lit(False).alias("required_review"), nothing().alias("revision_records"), order.alias("ord")
    )
    own = F.concat_ws(" ", F.col("statement"), name)
    findings = shape(one, F.lit("atomic_requirement"), own, F.col("conv_id") * 1000)
    pending = shape(one, F.lit("pending_confirmation:file_profile"), own, F.col("conv_id") * 1000 + 999).withColumn("finding_id", F.concat(F.lit("SYS-"), "finding_id"))
    requirements = t.select(F.concat_ws("-", "conv_id", "turn").alias("requirement_id"), name.alias("finding_id"), F.col("role").alias("subject"), *blank, none.alias("source_anchors"), F.lit(0.5).alias("confidence"), F.lit(False).alias("manual_verification_required"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"))
    relationships = one.select(F.concat(F.lit("l"), name).alias("relationship_id"), F.array(name).alias("from_finding_ids"), name.alias("to_finding_id"))
    out = produce.finalize_draft(findings, requirements, relationships, pending)
    n = lambda k: out[k].agg(F.lit(k).alias("part"), F.count("*").alias("n"))
    return n("findings").unionByName(n("requirements")).unionByName(n("relationships"))


@query("select o_orderkey as finding_id from orders where o_orderkey % 6 = 0 and o_orderkey % 4 <> 0")
def kind_changes(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), F.lit("c").alias("category"), F.lit("t").alias("claim_type"))
    new = x.where("finding_id % 6 = 0").withColumn("claim_type", F.when(F.col("finding_id") % 4 == 0, "t").otherwise("u"))
    return produce.kind_changes(new, x)


# -- attestations, reviews ---------------------------------------------------------------------------------------


@query("""select doc_id as finding_id, case when quality = 0 then 'error' when toxic = 1 then 'warning' else 'info' end as severity,
case when quality = 0 then 'quote is absent' when toxic = 1 then 'a person must look' else 'quote is there' end as message from labels""")
def rule_messages(spark, d):
    x = table(spark, d, "labels").select(F.col("doc_id").alias("finding_id"), F.lit("quote_match").alias("rule"), F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "manual_review_required").otherwise("passed").alias("status"))
    return attest.with_messages(x, {"quote_match": ("quote is there", "quote is absent")}, "a person must look").select("finding_id", "severity", "message")


@query("""select 'good' as kind, doc_id::varchar as finding_id from labels where doc_id % 5 = 0 union all select 'issue', case when doc_id % 5 in (1, 2, 3) then doc_id::varchar end from labels where doc_id % 5 <> 0""")
def stored_attestations(spark, d):
    i = F.col("doc_id")
    fields = [i.cast("string").alias("finding_id"), F.when(i % 5 == 4, "no rule").otherwise("quote_match").alias("rule"), F.when(i % 5 == 1, "maybe").otherwise("confirmed").alias("decision"), F.lit("s").alias("source_evidence_hash"), F.lit("f").alias("finding_hash"), F.lit(None).cast("string").alias("atomic_requirement_hash"), F.lit("me").alias("reviewer"), F.when(i % 5 == 2, "today").otherwise("2026-01-01T00:00:00Z").alias("reviewed_at"), F.lit("why").alias("reason")]
    whole, more = (F.to_json(F.struct(*f), {"ignoreNullFields": "false"}) for f in (fields, [*fields, F.lit(1).alias("extra")]))
    good, issues = attest.read_attestations(table(spark, d, "labels").select(F.when(i % 5 == 3, more).otherwise(whole).alias("value")), rules.RULES)
    return good.select(F.lit("good").alias("kind"), "finding_id").unionByName(issues.select(F.lit("issue").alias("kind"), "finding_id"))


@query("""select o_orderkey as finding_id, case when c.c_custkey is null then 'rule does not wait for a person' when o_orderkey % 3 = 0 then 'rule is attested' end as why from orders left join (
select c_custkey from customer where c_custkey % 2 = 0) c on c_custkey = o_custkey""")
def attest_commands(spark, d):
    key = F.col("o_custkey").alias("finding_id")
    # the finding of a command is the customer; the rule says which of its orders
    rule = F.col("o_orderkey").cast("string").alias("rule")
    o = table(spark, d, "orders")
    commands = o.select(key, rule)
    waiting = o.where("o_custkey % 2 = 0").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(key, rule, F.lit("manual_review_required").alias("status"))
    good, bad = review.attest_commands(commands, waiting, o.where("o_orderkey % 3 = 0").select(key, rule))
    both = good.withColumn("why", F.lit(None).cast("string")).unionByName(bad)
    return both.select(F.col("rule").cast("long").alias("finding_id"), "why")


@query("""select o_orderkey as finding_id, case when c_custkey is null then 'unknown finding' when c_custkey % 7 = 0 then 'finding is deleted' when o_orderkey % 5 = 0 then 'reviewer and reason are needed'
when o_orderkey % 5 = 1 then 'time is not UTC' when o_orderkey % 5 = 2 then 'nothing changed' end as why from orders left join customer on c_custkey = o_custkey""")
def review_commands(spark, d):
    i = F.col("o_orderkey")
    commands = table(spark, d, "orders").select(
        F.col("o_custkey").alias("finding_id"), F.lit("modify").alias("action"), F.when(i % 5 == 2, "h").otherwise("n").alias("new_hash"), F.when(i % 5 == 0, " ").otherwise("me").alias("reviewer"), i.cast("string").alias("reason"),
        F.when(i % 5 == 1, "now").otherwise("2026-01-01T00:00:00Z").alias("acted_at"),
    )
    findings = table(spark, d, "customer").select(F.col("c_custkey").alias("finding_id"), F.lit("h").alias("hash"), F.when(F.col("c_custkey") % 7 == 0, "deleted").otherwise("pending").alias("review_status"))
    rows, rejects = review.apply_commands(commands, findings)
    both = rows.select("reason", F.lit(None).cast("string").alias("why")).unionByName(rejects.select("reason", "why"))
    return both.select(F.col("reason").cast("long").alias("finding_id"), "why")


@query("""with t as (select conv_id, turn, sha256(text) as h, lag(sha256(text)) over (partition by conv_id order by turn) as p from conversations), b as (select conv_id, arg_min(h, turn) as first, arg_max(h, turn) as last, max(turn) as m, bool_or(turn % 5 = 4 or h = p or turn % 11 = 6) as bad from t group by conv_id)
select conv_id as finding_id, last as hash, not bad as chain_ok from b""")
def replayed_findings(spark, d):
    """Turns as audits; two of them share a time, some are not linked, some change nothing, and some come before their time."""
    time = F.when(F.col("turn") % 11 == 6, -1).otherwise(F.floor(F.col("turn") / 2))
    t = table(spark, d, "conversations").withColumn("h", F.sha2("text", 256))
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("h").alias("b"))
    log = t.where("turn > 0").join(before, ["conv_id", "turn"], "left")
    log = log.select(F.col("conv_id").alias("finding_id"), F.col("turn").alias("seq"), F.when(F.col("turn") % 5 == 4, "x").otherwise(F.col("b")).alias("before_hash"), F.col("h").alias("after_hash"), time.alias("reviewed_at"))
    first = t.where("turn = 0").select(F.col("conv_id").alias("finding_id"), F.col("h").alias("hash"))
    even = F.col("finding_id") % 2 == 0
    return review.replay(first.where(even), log, first.where(~even))


def reanalysis(spark, d):
    p = F.col("p_partkey").cast("long")
    findings = table(spark, d, "part").select(p.alias("finding_id"), F.col("p_type").alias("category"), F.lit("t").alias("claim_type"), F.sha2("p_name", 256).alias("hash"))
    edges = findings.where("finding_id > 1").select(F.floor(F.col("finding_id") / 3).cast("long").alias("parent"), F.col("finding_id").alias("child"))
    return findings, review.request_reanalysis(findings, edges, findings.where("finding_id % 100 = 7").select("finding_id"))


_GONE = """r(i) as (select p_partkey::bigint from part where p_partkey % 100 = 7 union select p_partkey::bigint from part join r on p_partkey // 3 = i where p_partkey > 1)"""


@query(f"with recursive {_GONE} select p_partkey::bigint as finding_id, sha256(p_name) as hash, p_partkey % 100 = 7 as is_target from part where p_partkey in (select i from r)")
def reanalysis_requests(spark, d):
    return reanalysis(spark, d)[1]


@query(f"""with recursive {_GONE} select p_partkey::bigint as finding_id, case when p_partkey % 100 = 7 and p_partkey % 3 = 0 then 'kind changed' when p_partkey % 100 = 7 and p_partkey % 3 = 1 then 'target is not covered' end as violation
from part where p_partkey not in (select i from r) or p_partkey % 100 = 7""")
def next_version(spark, d):
    findings, gone = reanalysis(spark, d)
    new = findings.where("finding_id % 100 = 7 and finding_id % 3 <> 1").withColumns({"hash": F.lit("new"), "category": F.when(F.col("finding_id") % 3 == 0, "other").otherwise(F.col("category"))})
    return review.apply_reanalysis(findings, gone, new).select("finding_id", "violation")


@query("select c_custkey as project_id, case when c_custkey % 3 = 0 then c_custkey % 5 else 9 end::bigint as step from customer")
def cancelled_requests(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.lit(9).cast("long").alias("step"))
    return review.cancel_request(c, c.where("project_id % 3 = 0").select("project_id", (F.col("project_id") % 5).alias("step_before")))


@query("""with o as (select o_custkey as p, o_orderkey as i, o_orderstatus as s from orders), t as (select p, i from o where i % 9 <> 0 union select p, -1 from o where p % 7 = 0)
select p as project_id, 'stages_allowed' as rule, bool_and(s in ('O', 'F')) as ok from o group by p union all select p, 'sources_allowed', bool_and(p % 5 <> 0) from o group by p
union all select p, 'results_are_targets', bool_and(i % 9 <> 0) and p % 7 <> 0 from o group by p""")
def authorized_results(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("stage"), F.lit("s").alias("source_id"))
    targets = o.where("finding_id % 9 <> 0").select("project_id", "finding_id").unionByName(o.where("project_id % 7 = 0").select("project_id", F.lit(-1).cast("long").alias("finding_id")).distinct())
    return review.authorized_results(o, targets, o.where("project_id % 5 <> 0").select("project_id", "source_id"), ["O", "F"])


@query("""select event_id, event_type = 'click' and event_id % 2 = 0 as changed, case when event_type = 'click' and event_id % 2 = 0 then 'human_review' when event_type = 'click' then 'priority' end as purpose from events""")
def migrated_actions(spark, d):
    i = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "add_human").otherwise("confirm")
    x = table(spark, d, "events").select(i, kind.alias("action"), F.col("user_id").cast("string").alias("finding_id"), F.lit("b").alias("before_hash"), F.lit("a").alias("after_hash"), F.lit("me").alias("reviewer"), F.col("ts").cast("string").alias("acted_at"), F.when((kind == "add_human") & (i % 2 == 1), "priority").alias("purpose"))
    old = review.action_ids(x).withColumn("was", F.col("action_id"))
    return review.migrate_actions(old).select("event_id", (F.col("action_id") != F.col("was")).alias("changed"), "purpose")


@query("select o_orderkey as project_id from orders where o_orderkey % 8 = 0")
def broken_seals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("project_id"), "o_orderstatus", "o_totalprice")
    sealed = review.seal(o, ["o_orderstatus", "o_totalprice"])
    touched = sealed.withColumn("o_totalprice", F.when(F.col("project_id") % 8 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return review.broken_seals(touched, ["o_orderstatus", "o_totalprice"]).select("project_id")


@query("""select o_custkey as project_id, not bool_or(o_orderkey % 50 = 0) as same from orders group by o_custkey""")
def stale_states(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), "o_orderkey", "o_orderstatus", F.lit("one").alias("step"))
    later = o.withColumns({"o_orderstatus": F.when(F.col("o_orderkey") % 50 == 0, "?").otherwise(F.col("o_orderstatus")), "step": F.lit("two")}).repartition(3)
    x = review.state_digests({"findings": o}, leave_out=("step",))
    y = review.state_digests({"findings": later}, leave_out=("step",)).withColumnRenamed("digest", "now")
    return x.join(y, "project_id").select("project_id", (F.col("digest") == F.col("now")).alias("same"))


# -- reports -----------------------------------------------------------------------------------------------------


@query("""select c_custkey as project_id, case when c_custkey % 2 = 0 then 'human_finalized' else 'ai_draft' end as review_status, case when c_custkey % 2 = 1 then 'AI草稿，未经人工复核' end as watermark, c_custkey % 3 <> 0 and count(o_orderkey) > 0 as can_preview
from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def report_states(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(F.count("*").alias("n_eligible"))
    i = F.col("project_id")
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")).join(n, "project_id", "left").fillna(0, ["n_eligible"])
    return report.report_status(x.withColumns({"finalized": i % 2 == 0, "parse_complete": i % 3 != 0})).drop("n_eligible", "finalized", "parse_complete")


@query("""select conv_id || '-' || turn as finding_id from conversations where turn % 6 = 0 or turn % 6 = 5""")
def eligible_findings(spark, d):
    t = F.col("turn") % 6
    x = talk(spark, d).select(
        F.col("id").alias("finding_id"), F.when(t == 1, "deleted").otherwise("confirmed").alias("review_status"), F.when(t == 2, "pending_confirmation").otherwise("regulatory_fact").alias("claim_type"),
        F.when(t == 3, F.lit("api_key = abc")).otherwise(F.lit("plain")).alias("statement"), cite("regulatory_text", F.lit("q")).alias("source_anchors"), F.array().cast("array<struct<change_summary:string>>").alias("revision_records"), F.sha2("text", 256).alias("hash"), "turn",
    )
    resolved = x.select("finding_id", F.lit(True).alias("effective_passed")).unionByName(x.where("turn % 6 = 4").select("finding_id", F.lit(False).alias("effective_passed")))
    return report.eligible(x, resolved, x.select("finding_id", "hash")).select("finding_id")


@query("""select o_custkey as project_id, count(*) filter (o_orderkey % 3 = 0)::bigint as n_top, case when count(*) filter (o_orderkey % 3 = 0) not between 3 and 5 then 'three to five top changes are needed' end as reason from orders group by o_custkey""")
def export_blocks(spark, d):
    x = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.when(F.col("o_orderkey") % 3 == 0, "top_changes").otherwise("dates").alias("section"))
    return report.export_block(x)


@query("select doc_id, case when doc_id % 2 = 0 then 0 else 1 end::bigint as type_order from documents")
def sources_in_order(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "documents").select(i, i.alias("ord"), F.when(i % 2 == 0, "regulatory_text").otherwise("official_interpretation").alias("source_type"))
    return report.by_source_type(x).select("doc_id", F.when(F.col("source_type") == "regulatory_text", 0).otherwise(1).cast("long").alias("type_order"))


@query(f"""with {_MATCHED}, n as (select count(*) filter (lang = 'fr') as ef, (select count(*) from a where lang = 'fr') as af, (select count(*) from m where lang = 'fr') as mf from e)
select round(mf / nullif(af, 0), 9)::double as "precision", round(mf / nullif(ef, 0), 9)::double as recall, (select count(*) from e where lang = 'fr' and doc_id not in (select expected_id from m))::bigint as n_omissions,
 (select count(*) from a where lang = 'de')::bigint as n_unmarked from n""")
def release_reports(spark, d):
    kind = {"fr": "key_matter:prohibition", "de": "institution_impact:data", "en": "atomic_requirement"}
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in kind.items() for x in kv))[F.col("category")], F.lit("other"))
    e, a = (x.withColumns({"category": named, "claim_type": F.lit("regulatory_fact"), "statement": F.sha2("statement", 256)}) for x in corpora(spark, d))
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pages = evaluate.page_accuracy(t, t.where("turn % 7 <> 6"), ["conv_id", "turn"]).withColumn("is_extra", F.lit(False))
    cited = evaluate.citation_validity(a, evaluate.match(e, a, ["category", "statement"]))
    x = evaluate.release_report(e, a, ["category", "statement"], pages, cited)
    return rounded(x.select(F.col("precision_prohibition").alias("precision"), F.col("recall_prohibition").alias("recall"), "n_omissions", "n_unmarked"), ["precision", "recall"])


@query("""select count(*) filter (turn % 7 = 6) as pending, sum(case when turn % 7 = 6 then length(text) else 0 end)::bigint as errors, sum(length(text))::bigint as n_chars from conversations""")
def corpus_accuracy(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    pages = evaluate.page_accuracy(t, t.where("turn % 7 <> 6"), ["conv_id", "turn"])
    pending = evaluate.pending_reviews(pages, pages.select("conv_id", "turn", F.lit(False).alias("is_current")), ["conv_id", "turn"])
    n = pending.where("n_chars > 0").agg(F.count("*").alias("pending"))
    return big(evaluate.corpus_accuracy(pages).select("errors", "n_chars").crossJoin(n), "errors", "n_chars")  # one row each


@query("select source as project_id, count(*)::bigint as n_findings, min(doc_id) as first from documents group by source")
def project_metrics(spark, d):
    m = table(spark, d, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("n_findings"))
    p = table(spark, d, "documents").groupBy(F.col("source").alias("project_id")).agg(F.min("doc_id").alias("first"))
    return review.with_metrics(p, m)


@query("""select '{"a":' || count(*) || ',"b":null}' as value from documents""")
def machine_reports(spark, d):
    return sinks.machine_report(table(spark, d, "documents").agg(F.lit(None).cast("string").alias("b"), F.count("*").alias("a")))


@query("select source as report_type, count(*)::bigint as n from documents group by source")
def written_reports(spark, d):
    path = new_path(spark, "reports")
    sinks.write_report(table(spark, d, "documents").select("doc_id", F.col("source").alias("report_type")), path)
    return spark.read.parquet(path).groupBy("report_type").agg(F.count("*").alias("n"))


# -- sources -----------------------------------------------------------------------------------------------------


@query("select doc_id, case when doc_id % 4 = 3 then null else text end as text from documents")
def decoded_texts(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    raw = F.when(i % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), t.cast("binary"))).when(i % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(i % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))).otherwise(F.concat(F.unhex(F.lit("FF41")), t.cast("binary")))
    return table(spark, d, "documents").select(i, ingest.decoded(raw).alias("text"))


@query("select doc_id as source_id, length(text)::bigint as n_chars from documents where length(text) >= 2000")
def long_texts(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    return big(ingest.long_texts(x, 2000).drop("head"), "n_chars")


@query("""select conv_id as source_id, case when conv_id % 5 = 0 then 'no scan' when conv_id % 5 = 1 then 'another file' when conv_id % 5 = 2 then 'page twice' end as why, case when conv_id % 5 > 2 then count(*) end::bigint as n from conversations group by conv_id""")
def ground_truths(spark, d):
    i = F.col("source_id")
    t = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("source_id")).agg(F.collect_list(F.struct(F.col("turn").alias("page"), "text")).alias("pages"))
    t = t.withColumn("pages", F.when(i % 5 == 2, F.concat("pages", "pages")).otherwise(F.col("pages")))
    good, bad = ingest.bind_ground_truth(t.withColumn("sha256", F.when(i % 5 == 1, "x").otherwise("h")), t.where(i % 5 != 0).select("source_id", F.lit("h").alias("sha256")))
    n = good.groupBy("source_id").agg(F.lit(None).cast("string").alias("why"), F.count("*").alias("n"))
    return n.unionByName(bad.withColumn("n", F.lit(None).cast("long")))


@query(f"""with t as (select conv_id, turn, {_TRIM % "coalesce(text, '')"} as text from conversations)
select conv_id as source_id, turn as page, text, (turn % 3 = 0)::bigint * 1 as n_low, text = '' as failed from t""")
def recognized_pages(spark, d):
    """Turns as recognized pages of one line, a word for each piece between spaces; every third has one symbol of low
    confidence in its first word."""
    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    words = F.transform(F.split("text", " "), lambda w, k: F.struct(F.array(F.struct(w.alias("text"), F.when((F.col("turn") % 3 == 0) & (k == 0), 50.0).otherwise(90.0).alias("confidence"))).alias("symbols")))
    nest = lambda c, name: F.array(F.struct(c.alias(name)))
    x = t.select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), nest(nest(nest(words, "words"), "lines"), "paragraphs").alias("blocks"))
    return big(ingest.flat_ocr(x).select("source_id", "page", "text", "n_low", "failed"), "n_low")


@query("""select conv_id as source_id, turn as page, case when turn % 3 = 0 then 'seen ' || conv_id when turn % 3 = 1 then text else 'fallback' end as text from conversations where turn % 6 <> 5""")
def overridden_pages(spark, d):
    """Pages that recognition replaces, pages that it fails on, and fallback lines for some of these."""
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("page"), F.lit(0).alias("paragraph_index"), "text")
    p = F.col("page") % 3
    ocr = t.where(p != 1).select("source_id", "page", F.when(p == 0, F.concat(F.lit("seen "), "source_id")).otherwise("").alias("text"), (p == 2).alias("failed"))
    units, failed = ingest.override_with_ocr(t, ocr)
    fallback = t.where((p == 2) & (F.col("page") % 6 != 5)).select("source_id", "page", F.lit(" fallback \n\n").alias("text"))
    return ingest.recover_pages(units, failed, fallback)[0].select("source_id", "page", "text")


@query("""with t as (select conv_id, count(*) as n, count(*) filter (turn % 4 = 3) as bad from conversations group by conv_id)
select conv_id as source_id, bad::bigint as n_failed, (bad + 1)::bigint as n_missing, bad > 0 as blocked from t""")
def parse_qualities(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), (F.col("turn") + 1).cast("int").alias("page"), (F.col("turn") % 4 != 3).alias("ok"))
    n = t.groupBy("source_id").agg((F.max("page") + 1).cast("int").alias("page_count"))
    return ingest.parse_quality(t, n).select("source_id", F.col("n_failed").cast("long").alias("n_failed"), F.size("missing").cast("long").alias("n_missing"), "blocked")


@query("select doc_id, case when doc_id % 3 = 0 then 'unknown key' when doc_id % 3 = 1 then 'not an object' end as refused from documents")
def strict_rows(spark, d):
    i = F.col("doc_id")
    body = F.to_json(F.struct(i.alias("doc_id"), "lang"))
    x = table(spark, d, "documents").select(F.when(i % 3 == 0, F.to_json(F.struct(i.alias("doc_id"), F.col("text").alias("more")))).when(i % 3 == 1, F.concat(F.lit("["), body, F.lit("]"))).otherwise(body).alias("value"), i)
    return ingest.strict_json(x, "doc_id long, lang string", ["doc_id", "lang"]).select("doc_id", "refused")


@query("select conv_id, turn, text from conversations")
def message_texts(spark, d):
    t = table(spark, d, "conversations")
    half = F.floor(F.length("text") / 2).cast("int")
    two = F.to_json(F.array(F.struct(F.substr("text", F.lit(1), half).alias("text")), F.struct(F.substr("text", half + 1).alias("text"))))
    one = F.expr("substring(to_json(struct(text as v)), 6, length(to_json(struct(text as v))) - 6)")
    return t.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, two).otherwise(one).alias("content")).select("conv_id", "turn", ingest.message_text("content").alias("text"))


@query("select doc_id, doc_id % 3 <> 0 and doc_id % 5 <> 0 as ok from documents")
def intact_copies(spark, d):
    i, raw = F.col("doc_id"), F.col("text").cast("binary")
    x = table(spark, d, "documents").select(i, F.when(i % 3 == 0, "x").otherwise(F.sha2(raw, 256)).alias("file_hash"), (F.octet_length("text") + F.when(i % 5 == 0, 1).otherwise(0)).alias("size"), raw.alias("content"))
    return sinks.intact(x).select("doc_id", "ok")


@query("select c_custkey as project_id, c_name as v, case when c_custkey % 2 = 0 then 'known id' end as why from customer")
def exchanged_projects(spark, d):
    """Projects exported with the allowed columns alone and read back: known ids are rejected."""
    path = new_path(spark, "export")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("v"), F.lit("secret").alias("token"))
    sinks.export(c, path, ["project_id", "v"])
    good, bad = sinks.import_new(spark, path, "project_id long, v string", c.where("project_id % 2 = 0"))
    return good.withColumn("why", F.lit(None).cast("string")).unionByName(bad.join(c.select("project_id", "v"), "project_id").select("project_id", "v", "why"))


@query("select o_orderkey from orders where o_custkey % 4 <> 0")
def kept_projects(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"))
    return review.drop_projects(o, o.where("project_id % 4 = 0")).select("o_orderkey")


@query("""select conv_id, sha256('[' || string_agg('{"role":"' || role || '","turn":' || turn || '}', ',' order by turn) || ']') as digest from conversations group by conv_id""")
def ordered_digests(spark, d):
    return review.group_digest(table(spark, d, "conversations"), "conv_id", "turn", ["turn", "role"])


@query(f"with {_UNITS} select source_id, paragraph_index, text as quote from units")
def unit_anchors(spark, d):
    u = units_of(spark, d).withColumns({"source_type": F.lit("regulatory_text"), "page": F.lit(None).cast("int"), "article": F.lit(None).cast("string")})
    return locate.order_units(locate.anchors_of_units(u)).select("source_id", "paragraph_index", "quote")


@query("select count(*)::bigint as n from conversations")
def anchor_count(spark, d):
    t = talk(spark, d).groupBy(F.col("conv_id").alias("finding_id")).agg(F.lit("x").alias("claim_type"), F.collect_list(F.struct(F.col("text").alias("quote"))).alias("source_anchors"))
    return locate.explode_anchors(t).agg(F.count("*").alias("n"))


@query("""with f as (select conv_id, role, min(turn) as o from conversations group by all) select conv_id, string_agg(role, ',' order by o) as roles from f group by conv_id""")
def sources_of_chunks(spark, d):
    x = table(spark, d, "conversations").select("conv_id", F.col("role").alias("source_id"), F.col("turn").alias("ord"))
    return chunk.source_ids(x, "conv_id").select("conv_id", F.array_join("source_ids", ",").alias("roles"))


@query("""with s as (select conv_id, text from conversations where turn % 2 = 0 union select conv_id, text from conversations where turn = 1) select conv_id as chunk_id, text from s""")
def scope_texts(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("chunk_id"), "turn", "text")
    return chunk.scope_texts(t.where("turn % 2 = 0"), t.where("turn = 1").select("chunk_id", F.col("text").alias("quote")))


@query("select conv_id as finding_id from conversations group by conv_id having bool_and(turn % 6 <> 5)")
def admitted_findings(spark, d):
    t = table(spark, d, "conversations").select(F.lit("n").alias("node_id"), F.col("conv_id").alias("finding_id"), (F.col("turn") % 6 != 5).alias("authorized"))
    return chunk.admitted(t).select("finding_id")


@query("""select c.conv_id || '-' || c.turn as finding_id, c.text || case when p.text is not null and c.turn % 2 = 1 then chr(10) || p.text || chr(10) || p.text else '' end as evidence from conversations c
left join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1""")
def evidence_texts(spark, d):
    t = talk(spark, d)
    odd = F.col("turn") % 2 == 1
    x = t.select(F.col("id").alias("finding_id"), F.when(odd, "ai_inference").otherwise("regulatory_fact").alias("claim_type"), F.col("text").alias("statement"), cite("regulatory_text", F.col("text")).alias("source_anchors"), F.when(odd, F.array(F.concat_ws("-", "conv_id", F.col("turn") - 1))).otherwise(nothing()).alias("inference_parents"))
    return rules.evidence_texts(x)


@query("""select conv_id as finding_id, min(turn)::bigint as first, count(distinct role)::bigint > 1 as conflict, round(min(1 / (turn + 1)), 9)::double as confidence from conversations group by conv_id""")
def merged_requirements(spark, d):
    t = table(spark, d, "conversations")
    blank = [F.lit(None).cast("string").alias(c) for c in merge.STRUCTURE if c != "subject"]
    x = t.select(F.col("turn").cast("string").alias("requirement_id"), F.concat("conv_id", F.lit("-"), "turn").alias("finding_id"), F.col("role").alias("subject"), *blank, F.array("role").alias("source_anchors"), (1 / (F.col("turn") + 1)).alias("confidence"), F.lit(False).alias("manual_verification_required"), F.col("turn").alias("ord"))
    alias = t.select(F.concat("conv_id", F.lit("-"), "turn").alias("finding_id"), F.col("conv_id").cast("string").alias("canonical_id"))
    m = merge.merge_requirements(x, alias)
    return rounded(m.select(F.col("finding_id").cast("long").alias("finding_id"), F.col("requirement_id").cast("long").alias("first"), "conflict", "confidence"), ["confidence"])


_KEEP = f"[{T.KEEP_BETWEEN}]"
_GAP = f"case when regexp_matches(%s, '{_KEEP}') and regexp_matches(%s, '{_KEEP}') then '%s' else '{_WS}*' end"
_IN_WORD = f"array_to_string(list_transform(range(1, length(w) + 1), lambda i: regexp_escape(w[i]) || case when i < length(w) then {_GAP % ('w[i]', 'w[i + 1]', '')} else '' end), '')"


@query(f"""with q as (select distinct item_id, text, string_split_regex({_TRIM % 'text'}, '{_WS}+') as ws from benchmark where regexp_replace(text, '{_WS}', '', 'g') <> ''),
p as (select item_id, text, array_to_string(list_transform(range(1, len(ws) + 1), lambda k: (list_transform([ws[k]], lambda w: {_IN_WORD}))[1]
  || case when k < len(ws) then {_GAP % ('ws[k][-1]', 'ws[k + 1][1]', _WS + '+')} else '' end), '') as pattern, regexp_replace(text, '{_WS}', '', 'g') as solid from q),
d as (select doc_id, text, regexp_replace(text, '{_WS}', '', 'g') as solid from documents where text is not null),
m as (select doc_id, item_id, d.text, regexp_extract_all(d.text, pattern) as found from d join p on contains(d.solid, p.solid))
select doc_id, item_id as quote_id, (strpos(text, found[1]) - 1)::bigint as start, (strpos(text, found[1]) - 1 + length(found[1]))::bigint as "end", len(found)::bigint as n from m where len(found) > 0""")
def quoted_ranges(spark, d):
    """Where benchmark items stand in documents once both are normalized, by offsets in the documents as they are."""
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return locate.quote_ranges(table(spark, d, "documents").select("doc_id", "text"), quotes)

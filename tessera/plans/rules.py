"""Registered queries of the rule tables and of findings made from responses, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import attest, checks, evaluate, locate, merge, produce, report, review
from tessera.plans.queries import _UNITS, _WS, big, query, sources_of, table, units_of
from tessera.sources.shared import new_path


def anchor(source: str, kind: str, quote):
    return F.array(F.struct(F.lit(source).alias("source_id"), F.lit(kind).alias("source_type"), quote.alias("quote")))


def parts(spark, d) -> DataFrame:
    """Parts as requirements with planted faults."""
    k = F.col("p_partkey")
    null = lambda n, c: F.when(k % n != 0, F.col(c))
    missing = F.concat(
        F.when(k % 5 == 0, F.array(F.lit("subject"))).otherwise(F.array().cast("array<string>")),
        F.when(k % 10 == 0, F.array(F.lit("subject"))).otherwise(F.array().cast("array<string>")),
        F.when(k % 11 == 0, F.array(F.lit("object"))).otherwise(F.array().cast("array<string>")),
    )
    return table(spark, d, "part").select(k.alias("requirement_id"), null(5, "p_brand").alias("subject"), null(7, "p_type").alias("action"), F.col("p_name").alias("object"), missing.alias("missing_facts"))


@query("""select p_partkey as requirement_id, rule, ok from part, (select unnest(['missing_named_once', 'named_is_null', 'core_null_iff_named']) as rule),
lateral (select case rule when 'missing_named_once' then p_partkey % 10 <> 0 when 'named_is_null' then p_partkey % 11 <> 0
  else p_partkey % 11 <> 0 and (p_partkey % 7 <> 0) end as ok)""")
def requirement_rules(spark, d):
    return checks.requirement_rules(parts(spark, d))


_STATUS = """case when k = 13 then 'passed' when k in (3, 9, 10) then 'failed' when k = 0 then 'passed' else 'manual_review_required' end"""


def structured(spark, d):
    """Parts as atomic findings with a requirement each; of fourteen kinds one passes and each of the rest has a fault."""
    k = F.col("p_partkey") % 14
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("finding_id"), k.alias("k"), F.concat(F.lit("sub"), "p_partkey").alias("s"), F.concat(F.lit("act"), "p_partkey").alias("a"), F.col("p_name").alias("o"))
    k = F.col("k")
    force = F.when(k == 2, "应").otherwise("必须")
    quote = F.when(k == 12, F.concat("a", F.lit("必须"), "s", "o")).when(k == 11, F.concat("s", F.lit("必须"), "a", "o", F.lit("more"))).otherwise(F.concat("s", force, "a", "o", F.lit("。")))
    one = F.struct(F.lit("R").alias("source_id"), F.lit("regulatory_text").alias("source_type"), quote.alias("quote"))
    other = F.struct(F.lit("Q").alias("source_id"), F.lit("regulatory_text").alias("source_type"), quote.alias("quote"))
    anchors = F.when(k == 4, F.array(one, other)).otherwise(F.array(one))
    findings = part.select(
        "finding_id", F.when(k == 13, "key_matter:x").otherwise("atomic_requirement").alias("category"), F.when(k == 5, F.lit("else")).otherwise(quote).alias("statement"), anchors.alias("source_anchors")
    )
    field = {"subject": F.when(k != 7, F.col("s")), "strength": F.when(k != 6, force), "action": F.when(k == 8, F.lit("x")).when(k == 9, F.lit("nowhere")).otherwise(F.col("a")), "object": F.col("o")}
    blank = [F.lit(None).cast("string").alias(f) for f in checks.FIELDS if f not in field]
    requirements = part.where("k <> 13").select(
        F.explode(F.when(k == 10, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("n"), "finding_id", "k", *(c.alias(f) for f, c in field.items()), *blank, (k == 1).alias("manual_verification_required"), F.when(k == 3, F.array(other)).otherwise(anchors).alias("source_anchors")
    )
    return findings, requirements


@query(f"select p_partkey::varchar as finding_id, {_STATUS} as status, k in (1, 2) as strength_review from (select p_partkey, p_partkey % 14 as k from part)")
def atomic_structures(spark, d):
    return checks.atomic_structure(*structured(spark, d))


# -- artifact sets -----------------------------------------------------------------------------------------------


def artifacts(spark, d):
    """Orders as findings of four kinds in turn, with requirements, relationships and conflicts, some at fault."""
    i = F.col("o_orderkey")
    o = table(spark, d, "orders").select(i, "o_orderstatus")
    status = F.col("o_orderstatus")
    reg = anchor("R", "regulatory_text", F.lit("q"))
    none = F.array().cast("array<struct<source_id:string,source_type:string,quote:string>>")
    name = i.cast("string")
    kind = i % 4
    findings = o.select(
        name.alias("finding_id"),
        F.when(kind == 0, "atomic_requirement").when(kind == 1, "key_matter:x").when(kind == 2, "institution_impact:data").otherwise("pending_confirmation:source_conflict").alias("category"),
        F.when(kind == 2, "ai_inference").when(kind == 3, "pending_confirmation").otherwise("regulatory_fact").alias("claim_type"),
        F.when((kind == 2) | (kind == 3), F.array((i - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("inference_parents"),
        F.when((i % 12 == 1) | (kind == 3), none).otherwise(reg).alias("source_anchors"),
    )
    own = F.when(i % 20 == 0, anchor("Z", "regulatory_text", F.lit("q"))).otherwise(reg)
    requirements = o.where((kind == 0) & (i % 24 != 0)).select(F.concat(F.lit("r"), i).alias("requirement_id"), name.alias("finding_id"), own.alias("source_anchors"))
    requirements = requirements.unionByName(o.where(i % 16 == 0).select(F.concat(F.lit("s"), i).alias("requirement_id"), name.alias("finding_id"), reg.alias("source_anchors")))
    back = F.when(i % 28 == 2, 5).otherwise(1)
    relationships = o.where((kind == 2) & (i % 20 != 2)).select(F.concat(F.lit("l"), i).alias("relationship_id"), F.array((i - back).cast("string")).alias("from_finding_ids"), name.alias("to_finding_id"), reg.alias("source_anchors"))
    conflicts = o.where(kind == 3).select(name.alias("conflict_id"), (i - 3).cast("string").alias("regulatory_finding_id"), (i - 1).cast("string").alias("interpretation_finding_id"), none.alias("source_anchors"))
    return findings, requirements, relationships, conflicts


@query("""with o as (select o_orderkey as i from orders),
f as (select i, case i % 4 when 0 then 'a' when 1 then 'k' when 2 then 'n' else 'p' end as kind, i % 12 <> 1 and i % 4 <> 3 as cited from o),
r as (select 'r' || i as id, i, i % 20 <> 0 as good from o where i % 4 = 0 and i % 24 <> 0 union all select 's' || i, i, true from o where i % 16 = 0),
l as (select i, case when i % 28 = 2 then 5 else 1 end as back from o where i % 4 = 2 and i % 20 <> 2),
nr as (select i, count(*) as n from r group by i),
all_rows as (
select 'finding' as entity, f.i::varchar as id, unnest(['id_unique', 'requirement_iff_atomic', 'cited_unless_pending', 'relationship_iff_inference']) as rule,
       unnest([true, coalesce(n, 0) = case when kind = 'a' then 1 else 0 end, kind = 'p' or cited, (kind = 'n') = (l.i is not null)]) as ok
from f left join nr using (i) left join l using (i)
union all
select 'requirement', id, unnest(['id_unique', 'of_atomic_finding', 'cites_within']), unnest([true, true, good]) from r
union all
select 'relationship', 'l' || l.i, unnest(['to_inference', 'parents_known', 'parents_declared', 'cites_within_parents', 'cites_what_target_cites']),
       unnest([true, p.i is not null, back = 1, coalesce(p.cited, false), true]) from l left join f p on p.i = l.i - l.back
union all
select 'conflict', f.i::varchar, unnest(['of_fact', 'of_explanation', 'has_pending_finding', 'cites_within_both']), unnest([a.i is not null, false, false, a.i is not null and b.i is not null])
from f left join f a on a.i = f.i - 3 left join f b on b.i = f.i - 1 where f.kind = 'p')
select entity, rule, ok, count(*)::bigint as n, sum(hash_of)::bigint as ids from (select *, regexp_replace(id, '[a-z]', '')::bigint as hash_of from all_rows) group by all""")
def artifact_rules(spark, d):
    found = checks.artifact_rules(*artifacts(spark, d))
    number = F.regexp_replace("id", "[a-z]", "").cast("long")
    return found.groupBy("entity", "rule", "ok").agg(F.count("*").alias("n"), F.sum(number).alias("ids"))


def turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("project_id"), "turn", "role", F.concat_ws("-", "conv_id", "turn").alias("finding_id"))


_ATOMIC = "role = 'user'"


@query(f"""with t as (select conv_id as p, turn, {_ATOMIC} as a from conversations), r as (select p, turn, a from t where turn % 3 <> 2 and (a or turn % 4 = 1))
select p as project_id, 'requirement_of_atomic' as rule, bool_and(a) as ok from r group by p
union all select p, 'atomic_has_requirement', bool_and(turn % 3 <> 2) from t where a group by p
union all select p, 'ends_exist', max(turn) >= 2 from t group by p
union all select p, 'last_node_is_last_run', max(turn) % 2 = 0 from t group by p""")
def checkpoint_rules(spark, d):
    t = turns(spark, d)
    findings = t.withColumn("category", F.when(F.expr(_ATOMIC), "atomic_requirement").otherwise("x"))
    requirements = t.where(f"turn % 3 <> 2 and ({_ATOMIC} or turn % 4 = 1)")
    ends = t.select("project_id", F.concat_ws("-", "project_id", F.lit(2)).alias("finding_id")).distinct()
    nodes = t.select("project_id", F.col("turn").alias("ord"), F.col("finding_id").alias("node_id"))
    return checks.checkpoint_rules(findings, requirements, ends, nodes, nodes.where("ord % 2 = 0"))


@query(f"""with t as (select conv_id as p, turn, role, {_ATOMIC} as a from conversations), n as (select p, count(*) as n, max(turn) as m from t group by p)
select p as project_id, 'finding_ids_unique' as rule, m % 2 = 1 as ok from n
union all select p, 'requirement_ids_unique', true from t where a and turn % 5 <> 4 group by p
union all select p, 'relationship_ids_unique', count(*) = 1 from t where turn > 0 group by p
union all select t.p, 'requirements_pair', bool_and(turn % 5 <> 4 and not (turn = m and m % 2 = 0)) from t join n using (p) where a group by t.p
union all select p, 'targets_inferred', bool_and(not a) from t where turn > 0 group by p""")
def draft_rules(spark, d):
    t = turns(spark, d)
    last = t.groupBy("project_id").agg(F.max("turn").alias("m"))
    x = t.withColumns({"category": F.when(F.expr(_ATOMIC), "atomic_requirement").otherwise("x"), "claim_type": F.when(F.expr(_ATOMIC), "regulatory_fact").otherwise("ai_inference")})
    again = x.join(last, "project_id").where("turn = m and m % 2 = 0").drop("m")
    requirements = t.where(f"turn % 5 <> 4 and {_ATOMIC}").withColumn("requirement_id", F.col("finding_id"))
    relationships = t.where("turn > 0").select("project_id", F.lit("rel").alias("relationship_id"), F.col("finding_id").alias("to_finding_id"))
    return checks.draft_rules(x.unionByName(again), requirements, relationships)


@query(f"""with t as (select conv_id as p, turn, text, {_ATOMIC} as a from conversations), r as (select * from t where turn % 2 = 0 or turn = 7)
select p as corpus, 'finding_ids_unique' as rule, true as ok from t group by p
union all select p, 'requirements_pair', bool_and(turn % 3 <> 2) from t where a group by p
union all select p, 'pages_unique', true from t where turn < 6 group by p
union all select p, 'reviews_unique', true from r group by p
union all select p, 'reviews_have_pages', bool_and(turn < 6) from r group by p
union all select p, 'corrections_are_page_texts', bool_and(turn % 4 <> 2 and turn < 6) from r group by p
union all select p, 'official_sources_paired', p % 3 <> 0 from t group by p""")
def corpus_rules(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("corpus"), "turn", "text", "role", F.concat_ws("-", "conv_id", "turn").alias("finding_id"))
    cited = F.array(F.struct(F.lit("O").alias("source_id"), F.lit("official_interpretation").alias("source_type")))
    findings = t.withColumns({"category": F.when(F.expr(_ATOMIC), "atomic_requirement").otherwise("x"), "source_anchors": cited})
    findings = findings.withColumn("claim_type", F.lit("x"))
    requirements = t.where(f"{_ATOMIC} and turn % 3 <> 2").withColumn("requirement_id", F.col("finding_id"))
    pages = t.where("turn < 6").select("corpus", F.lit("s").alias("source_id"), F.col("turn").alias("page"), "text")
    reviews = t.where("turn % 2 = 0 or turn = 7").select("corpus", F.lit("s").alias("source_id"), F.col("turn").alias("page"), F.lit("corrected").alias("decision"), F.when(F.col("turn") % 4 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("corrected_text"))
    pairs = t.select("corpus", F.when(F.col("corpus") % 3 == 0, "P").otherwise("O").alias("official_source_id")).distinct()
    return checks.corpus_rules(findings, requirements, pages, reviews, pairs)


@query("""with h as (select source, list_sort(list(distinct lang)) as have from documents group by source), w as (select source, list_sort(list(distinct lang)) as want from documents where doc_id % 3 <> 0 group by source)
select coalesce(h.source, w.source) as source, coalesce(have = want and want = ['de', 'en', 'es', 'fr'], false) as ok from h full join w using (source)""")
def manifest_coverage(spark, d):
    x = table(spark, d, "documents").select("source", "lang")
    return checks.exact_coverage(x, table(spark, d, "documents").where("doc_id % 3 <> 0").select("source", "lang"), "source", "lang", ["de", "en", "es", "fr"])


@query("""with s as (select doc_id as i, doc_id % 4 = 1 as official, case when doc_id % 4 = 1 or doc_id % 10 = 3 then doc_id - 1 - doc_id % 2 * (doc_id % 7 // 6) end as primary_id from documents),
x as (select s.i, s.official, s.primary_id, p.i is not null and not p.official as paired from s left join s p on p.i = s.primary_id)
select i as source_id, unnest(['id_unique', 'attachments_iff_modality', 'official_is_paired', 'ground_truth_iff_scan']) as rule,
  unnest([true, i % 6 <> 5, case when official then paired else primary_id is null end, i % 9 <> 8]) as ok from x""")
def sample_rules(spark, d):
    i = F.col("doc_id")
    none = F.lit(None).cast("long")
    x = table(spark, d, "documents").select(
        i.alias("source_id"),
        F.when(i % 4 == 1, "official_interpretation").otherwise("regulatory_text").alias("source_type"),
        F.when((i % 4 == 1) | (i % 10 == 3), i - 1 - i % 2 * F.floor(i % 7 / 6)).otherwise(none).alias("primary_source_id"),
        F.when(i % 6 >= 4, F.array(F.lit("attachment"))).otherwise(F.array(F.lit("text"))).alias("modalities"),
        F.when(i % 6 == 4, 1).otherwise(0).alias("n_attachments"),
        F.when(i % 9 >= 7, "pdf_scan").otherwise("txt").alias("file_type"),
        (i % 9 == 7).alias("has_ground_truth"),
    )
    return checks.sample_rules(x)


@query("""with v as (select c_custkey as i from customer), f as (select o_custkey as i, list(distinct o_orderkey) as ids, bool_and(o_orderstatus <> 'P') as base from orders group by o_custkey)
select v.i as version_id, unnest(['sources_proper', 'scope_proper', 'replaced_proper', 'replaced_exist', 'cites_own_sources', 'directive_names_parent', 'findings_as_analysed']) as rule,
  unnest([v.i % 5 <> 0, v.i % 7 <> 0, true, v.i % 3 = 0 and f.i is not null and list_contains(ids, v.i), f.i is null or v.i % 5 <> 0, v.i % 11 <> 0, coalesce(base, true)]) as ok from v left join f using (i)""")
def version_rules(spark, d):
    i = F.col("c_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderkey").cast("string").alias("finding_id"), "o_orderstatus")
    none = F.array().cast("array<string>")
    versions = table(spark, d, "customer").select(
        i.alias("version_id"),
        F.lit("h").alias("parent_version_hash"),
        F.when(i % 11 == 0, "g").otherwise("h").alias("directive_parent"),
        F.when(i % 5 == 0, none).otherwise(F.array(F.lit("s"))).alias("source_ids"),
        F.when(i % 7 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.array(F.lit("x"))).alias("scope"),
        F.array(F.when(i % 3 == 0, i.cast("string")).otherwise("gone")).alias("replaced_finding_ids"),
    )
    findings = o.select("version_id", "finding_id", F.lit("regulatory_fact").alias("claim_type"), F.when(F.col("o_orderstatus") == "P", "confirmed").otherwise("unreviewed").alias("review_status"), none.alias("revision_records"))
    return checks.version_rules(versions, findings, o.select("version_id", F.lit("s").alias("source_id")))


@query("""with x as (select o_custkey as v, o_orderkey as i, o_orderkey % 6 = 0 as target, o_orderkey % 6 = 1 as gone, o_orderkey % 35 = 0 as kind, o_orderkey % 77 = 2 as changed, o_orderkey % 91 = 1 as kept from orders),
a as (select v, bool_and(not target or not kind) as k, bool_and(not gone or not kept) as g, bool_and(target or gone or not changed) as r from x group by v)
select v as version_id, unnest(['parent_hash', 'sources_united', 'scope_united', 'targets_keep_kind', 'derived_are_gone', 'rest_unchanged']) as rule,
  unnest([v % 13 <> 0, v % 4 <> 0, true, k, g, r]) as ok from a""")
def derived_versions(spark, d):
    i, v = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    row = lambda kind, h: (v.alias("version_id"), i.alias("finding_id"), kind.alias("kind"), h.alias("hash"))
    before = o.select(*row(F.lit("k"), F.lit("1")))
    after = o.where((i % 6 != 1) | (i % 91 == 1)).select(*row(F.when(i % 35 == 0, "other").otherwise("k"), F.when((i % 77 == 2) | (i % 6 == 0), "2").otherwise("1")))
    one = F.array(F.lit("s"))
    versions = o.select(v.alias("version_id")).distinct().select(
        "version_id",
        F.when(F.col("version_id") % 13 == 0, "x").otherwise("h").alias("parent_version_hash"),
        F.lit("h").alias("previous_hash"),
        F.when(F.col("version_id") % 4 == 0, one).otherwise(F.array(F.lit("t"), F.lit("s"))).alias("source_ids"),
        one.alias("parent_source_ids"),
        F.array(F.lit("t")).alias("own_source_ids"),
        one.alias("scope"),
        one.alias("parent_scope"),
        one.alias("own_scope"),
    )
    at = lambda n: o.where(i % 6 == n).select(v.alias("version_id"), i.alias("finding_id"))
    return checks.derived_version_rules(before, after, versions, at(0), at(1))


@query("""with t as (select conv_id, turn, text from conversations)
select case when turn % 3 = 0 then 'finding' when turn % 3 = 1 then 'requirement' else 'conflict' end as kind, conv_id || '-' || turn as owner_id
from t where not (turn % 4 <> 3 and exists (select 1 from t u where u.conv_id = t.conv_id and u.turn = t.turn))""")
def unlocatable_anchors(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("paragraph_index"), "text")
    place = dict(page=F.lit(1), article=F.lit(None).cast("string"))
    units = t.withColumns(place)
    p = F.col("paragraph_index")
    a = t.withColumns(place).select(
        F.when(p % 3 == 0, "finding").when(p % 3 == 1, "requirement").otherwise("conflict").alias("kind"),
        F.concat_ws("-", "source_id", p).alias("owner_id"),
        F.lit(0).alias("anchor_ord"),
        "source_id", "page", "article", "paragraph_index",
        F.when(p % 4 == 3, F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("quote"),
    )
    parts = [a.where(F.col("kind") == k) for k in ("finding", "requirement", "conflict")]
    return checks.unlocatable(parts, lambda x: locate.locate_quotes(x, units, ("kind", "owner_id", "anchor_ord"))).select("kind", "owner_id")


# -- evidence of parsing -----------------------------------------------------------------------------------------


def parsed(spark, d):
    """Documents as sources with the outcome of parsing them; every fault spoils another of the outcomes."""
    docs = sources_of(spark, d)
    s = docs.select("source_id", F.lit("regulatory_text").alias("source_type"), "content", F.col("source").alias("project_id"))
    u = units_of(spark, d).select("source_id", F.lit("regulatory_text").alias("source_type"), F.col("paragraph_index").alias("ord"), F.lit(None).cast("int").alias("page"), F.concat_ws("-", "source_id", "paragraph_index").alias("unit_id"), "text", F.lit(1.0).alias("confidence"))
    i = F.col("source_id")
    digest = F.sha2(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])), 256)
    by = u.groupBy("source_id").agg(F.count("*").alias("n_units"), digest.alias("units_digest"))
    o = s.join(by, "source_id", "left").select(
        "source_id",
        F.when(i % 17 == 0, "official_interpretation").otherwise("regulatory_text").alias("source_type"),
        F.when(i % 7 == 0, "short").otherwise(F.sha2("content", 256)).alias("file_hash"),
        F.lit(None).cast("int").alias("page_count"),
        F.array().cast("array<int>").alias("successful_pages"),
        F.when(i % 11 == 0, 1).otherwise(0).alias("n_failed"),
        (F.coalesce("n_units", F.lit(0)) + F.when(i % 13 == 0, 1).otherwise(0)).alias("n_units"),
        F.length("content").alias("total_chars"),
        "units_digest",
        F.lit(1.0).alias("coverage"),
        F.lit(False).alias("blocked"),
    )
    return s, o, u


_PARSED = f"""{_UNITS}, u as (select source_id, count(*) as n, string_agg(text, chr(10) || chr(10) order by paragraph_index) as content from units group by source_id),
p as (select doc_id as i, source, u.n is not null as has, regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') as body, u.content, text from documents left join u on u.source_id = doc_id),
pr as (select i, source, unnest(['content_not_blank', 'hash_is_sha256', 'type_agrees', 'no_failures', 'counts_agree', 'digest_agrees', 'content_is_rebuilt', 'unit_ids_unique', 'units_filled_and_sure', 'pages_complete']) as rule,
  unnest([body <> '', i % 7 <> 0, i % 17 <> 0 and has, i % 11 <> 0, i % 13 <> 0 and has, has, coalesce(body = content, false), has, has, has]) as ok from p where text is not null)"""


@query(f"with {_PARSED} select i as source_id, rule, ok from pr")
def parse_rules(spark, d):
    return checks.parse_rules(*parsed(spark, d))


@query(f"with {_PARSED} select source as project_id, bool_and(ok) as complete from pr group by source")
def parse_completeness(spark, d):
    s, o, u = parsed(spark, d)
    return checks.complete(checks.parse_rules(s, o, u), s.select("source_id", "project_id"), "source_id", "project_id")


@query("""with t as (select conv_id as i, turn from conversations), r as (select i, turn from t where turn % 4 <> 3)
select i as source_id, 'pages_reviewed_once' as rule, bool_and(turn % 4 <> 3) as ok from t group by i
union all select i, 'unit_of_review', true from r group by i
union all select i, 'fields_agree', bool_and(turn % 5 <> 4) from r group by i
union all select i, 'correction_is_last', bool_and(turn % 6 <> 5) from r group by i""")
def ocr_evidence(spark, d):
    p = F.col("turn")
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), p, "text")
    fixed = p % 2 == 0
    at, by = "2026-01-01T00:00:00Z", "me"
    last = F.struct(F.when(p % 6 == 5, "x").otherwise(F.col("text")).alias("text"), F.lit(by).alias("by"), F.lit(at).alias("at"))
    wrong = (p % 6 == 5) & ~fixed
    common = {
        "unit_id": F.concat_ws("-", "source_id", "turn"),
        "page": p,
        "confidence": F.lit(0.9),
        "original_ocr_text": F.col("text"),
        "corrected_text": F.when(fixed, F.col("text")),
        "review_status": F.when(fixed, "corrected").when(wrong, "other").otherwise("unreviewed"),
        "reviewed_at": F.when(fixed, at),
        "reviewed_by": F.when(fixed, by),
    }
    units = t.withColumns(common)
    reviews = t.where("turn % 4 <> 3").withColumns(common).withColumn("text", F.when((p % 5 == 4) & ~fixed, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    reviews = reviews.withColumn("confidence", F.when((p % 5 == 4) & fixed, 0.5).otherwise(0.9))
    reviews = reviews.withColumn("correction_history", F.when(fixed, F.array(last)).otherwise(F.array().cast("array<struct<text:string,by:string,at:string>>")))
    return checks.ocr_rules(t.select("source_id", p.alias("page")), units, reviews)

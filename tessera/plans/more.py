"""Further registered queries: smaller operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunk, evaluate, locate, merge, report, review, rules
from tessera.plans.queries import _MATCHED, _TRIM, big, corpora, doc_chunks, query, rounded, sources_of, stream_of, table
from tessera.sources import ingest, sinks
from tessera.sources.shared import new_path
from tessera.streaming import logs


@query("select doc_id, 'SRC-' || source || '-' || substr(sha256(text), 1, 20) as source_id from documents")
def source_ids(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", ingest.source_id(F.col("text").cast("binary"), F.col("source")).alias("source_id"))


@query(f"""with b as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '\\n[ \\t\\n\\x0B\\f\\r]*\\n')) as t from documents),
t as (select doc_id, {_TRIM % 't'} as t from b) select doc_id as source_id, count(*)::bigint as n_blocks, sum(length(t))::bigint as n_chars from t where t <> '' group by doc_id""")
def units_by_block(spark, d):
    x = locate.block_units(sources_of(spark, d)).groupBy("source_id")
    return x.agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("n_chars"))


@query("""select doc_id, case when doc_id % 3 = 0 then 'absent' when doc_id % 3 = 1 then 'other bytes'
  when count(*) over (partition by sha256(text)) > 1 then 'used twice' end as why from documents""")
def artifact_checks(spark, d):
    i, own = F.col("doc_id"), F.sha2("text", 256)
    x = table(spark, d, "documents")
    path = F.when(i % 3 == 0, "gone").otherwise(i.cast("string"))
    manifest = x.select("doc_id", path.alias("path"), own.alias("sha256"), (F.length(F.col("text").cast("binary")) + F.when(i % 3 == 1, 1).otherwise(0)).alias("size"))
    files = x.select(i.cast("string").alias("path"), F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    return ingest.verify_artifacts(manifest, files).select("doc_id", "why")


@query("""select doc_id, case when ends_with(name, '.exe') then 'kind is not supported' when n = 0 then 'empty file' when n > 5000 then 'file is too large' end as refused
from (select doc_id, doc_id || case when doc_id % 4 = 0 then '.exe' else '.txt' end as name, strlen(text) as n from documents)""")
def admitted_files(spark, d):
    x = table(spark, d, "documents")
    name = F.concat("doc_id", F.when(F.col("doc_id") % 4 == 0, ".exe").otherwise(".txt"))
    files = x.select("doc_id", name.alias("path"), F.octet_length("text").alias("length"), F.col("text").cast("binary").alias("content"))
    small = F.when(F.col("path").endswith(".exe"), 1).otherwise(F.col("length"))
    return ingest.admit(files.withColumn("length", small), max_bytes=5000).select("doc_id", "refused")


@query(f"""with {_MATCHED} select count(*) filter (doc_id in (select actual_id from m))::bigint as valid, count(*)::bigint as total,
  round(count(*) filter (doc_id in (select actual_id from m)) / count(*), 9)::double as rate from a where lang = 'fr'""")
def citation_validity(spark, d):
    expected, actual = corpora(spark, d)
    kinds = actual.withColumn("claim_type", F.when(F.col("category") == "fr", "regulatory_fact").otherwise("ai_inference"))
    return rounded(evaluate.citation_validity(kinds, evaluate.match(expected, actual, ["category", "statement"])), ["rate"])


@query(f"with {_MATCHED} select doc_id as expected_id from e where lang in ('fr', 'de') and doc_id not in (select expected_id from m)")
def critical_omissions(spark, d):
    expected, actual = corpora(spark, d)
    found = evaluate.match(expected, actual, ["category", "statement"])
    kind = F.when(F.col("category") == "fr", "key_matter:prohibition").when(F.col("category") == "de", "document_identity:deadline").otherwise(F.col("category"))
    return evaluate.omissions(expected.withColumn("category", kind), found)


@query("select doc_id as id from documents where doc_id % 5 = 0 and lang <> 'en'")
def unmarked_inferences(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "institution_impact:data").otherwise("x")
    claim = F.when(F.col("lang") == "en", "ai_inference").otherwise("regulatory_fact")
    return evaluate.unmarked_inferences(table(spark, d, "documents").select(F.col("doc_id").alias("id"), kind.alias("category"), claim.alias("claim_type")))


@query("""with x as (select conv_id, turn, role, dense_rank() over (partition by conv_id order by f) as variant from (
  select conv_id, turn, role, min(turn) over (partition by conv_id, role) as f from conversations))
select conv_id || '-' || turn as requirement_id, conv_id || case when variant > 1 then '~atomic-' || variant else '' end as finding_id, variant > 1 as needs_review from x""")
def requirement_variants(spark, d):
    t = table(spark, d, "conversations")
    blank = [F.lit(None).cast("string").alias(c) for c in merge.STRUCTURE if c != "subject"]
    x = t.select(F.concat_ws("-", "conv_id", "turn").alias("requirement_id"), F.col("conv_id").cast("string").alias("finding_id"), F.col("role").alias("subject"), *blank, F.col("turn").alias("ord"))
    return merge.expand_conflicts(x).select("requirement_id", "finding_id", "needs_review")


@query("""with w as (select conv_id, turn, text, lag(sha256(text)) over (partition by conv_id order by turn) as prev from conversations)
select conv_id, case when turn % 4 = 3 then 'W' else 'V' end || (turn + 1) as version_id, case when turn % 4 = 3 then false else true end as number_ok, turn % 5 <> 4 or prev is null as parent_ok from w""")
def version_chain(spark, d):
    t = table(spark, d, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.sha2("text", 256).alias("_b"))
    n = F.col("turn") + 1
    x = t.join(before, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("project_id"),
        F.when(F.col("turn") % 4 == 3, F.concat(F.lit("W"), n)).otherwise(F.concat(F.lit("V"), n)).alias("version_id"),
        F.sha2("text", 256).alias("version_hash"),
        F.when((F.col("turn") % 5 == 4) & F.col("_b").isNotNull(), "x").otherwise(F.col("_b")).alias("parent_version_hash"),
        F.col("turn").alias("created_at"),
    )
    return review.versions_ok(x).select(F.col("project_id").alias("conv_id"), "version_id", "number_ok", "parent_ok")


@query("""select o_orderkey as finding_id, o_orderstatus as hash from orders o where o_orderkey % 3 = 0 and not exists (
  select 1 from orders p where p.o_orderkey = o.o_orderkey and p.o_orderkey % 2 = 0)""")
def stale_requests(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), F.col("o_orderstatus").alias("hash"))
    return review.stale(x.where("finding_id % 3 = 0"), x.where("finding_id % 2 = 0"))


@query("""with x as (select user_id, event_type, event_id, ts from events), y as (select *, row_number() over (partition by user_id, event_type order by ts desc) as n from x)
select user_id as project_id, event_type as source_type, ts as parsed_at from y where n = 1""")
def upserted_sources(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_type").alias("source_type"), F.col("ts").alias("parsed_at"))
    half = F.col("project_id") % 2 == 0
    return review.upsert_sources(x.where(half), x.where(~half))


@query("""select user_id as project_id, max(event_id) as revision, arg_max(ts, event_id) as updated_at from events group by user_id""")
def latest_sessions(spark, d):
    x = table(spark, d, "events").select(F.col("user_id").alias("project_id"), F.col("event_id").alias("revision"), F.col("ts").alias("updated_at"))
    return sinks.latest_sessions(x)


@query("""with l as (select conv_id, arg_max(text, turn) as last, count(*) as n from conversations group by conv_id)
select conv_id as unit_id, last as text, n::bigint as n_history from l""")
def corrected_units(spark, d):
    t = table(spark, d, "conversations")
    units = t.where("turn = 0").select(F.col("conv_id").alias("unit_id"), "text")
    fixes = t.select(F.col("conv_id").alias("unit_id"), "text", F.col("turn").alias("corrected_at"))
    return review.correct_units(units, fixes).select("unit_id", "text", F.size("history").cast("long").alias("n_history"))


@query("""select max(event_id) + 1 - min(event_id) = count(*) and min(event_id) = 0 as is_prefix, count(*)::bigint as n_done
from events where event_id < (select count(*) // 2 from events)""")
def resume_prefix(spark, d):
    x = table(spark, d, "events").select("event_id", F.col("event_id").alias("ord"))
    n = table(spark, d, "events").agg(F.floor(F.count("*") / 2).alias("half"))
    return chunk.is_prefix(x, x.join(F.broadcast(n), F.col("event_id") < F.col("half")), "event_id")


@query("""with x as (select distinct lang, source from documents), d as (select source, count(*) as n from documents group by source)
select source as project_id, case when min(lang) <> 'de' then 'no regulation' when n % 2 = 0 then 'reanalysis is pending' when n % 3 = 0 then 'quality gate failed' end as reason
from x join d using (source) group by source, n""")
def step_gates(spark, d):
    x = table(spark, d, "documents").groupBy(F.col("source").alias("project_id")).agg(F.count("*").alias("n_findings"), F.min("lang").alias("l"))
    n = F.col("n_findings")
    p = x.select("project_id", "n_findings", (F.col("l") == "de").alias("has_regulation"), (n % 2 == 0).alias("reanalysis_pending"), F.lit(True).alias("parsing_completed"), F.lit(True).alias("reviews_done"), F.lit(True).alias("evidence_ready"), (n % 3 != 0).alias("gate_passed"))
    return report.step_gate(p).select("project_id", "reason")


@query("""select o_orderkey, c_custkey as source_id, coalesce(c_mktsegment, o_custkey::varchar) as source_title from orders left join (
  select c_custkey, c_mktsegment from customer) on c_custkey = o_custkey""")
def titled_items(spark, d):
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    titles = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("title"))
    return report.with_titles(items, titles).select("o_orderkey", "source_id", "source_title")


@query("""select conv_id, sha256(string_agg(text, chr(10) order by turn)) as digest from conversations group by conv_id""")
def conversation_digests(spark, d):
    x = ingest.summarize(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    return x.select("conv_id", F.sha2(F.replace("content", F.lit("\n\n"), F.lit("\n")), 256).alias("digest"))


@query("""with t as (select conv_id, turn, text, length(text) as n from conversations),
p as (select a.conv_id, a.turn, a.text, b.text as chunk from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn - a.turn % 2)
select conv_id || '-' || turn as finding_id, contains(chunk, text) as authorized from p""")
def authorized_anchors(spark, d):
    """Turns as citations; an even turn's text is the scope of itself and of the turn after it."""
    t = table(spark, d, "conversations")
    place = {"source_id": F.col("conv_id"), "page": F.lit(1), "article": F.lit(None).cast("string"), "paragraph_index": F.col("turn")}
    scope_of = F.concat_ws("-", "conv_id", F.col("turn") - F.col("turn") % 2).alias("chunk_id")
    a = t.select(F.lit("n").alias("node_id"), scope_of, F.concat_ws("-", "conv_id", "turn").alias("finding_id"), *(c.alias(k) for k, c in place.items()), F.col("text").alias("quote"))
    scope = t.where("turn % 2 = 0").select(scope_of, "text")
    locators = t.select(scope_of, *(c.alias(k) for k, c in place.items()))
    return chunk.authorize(a, scope, locators).select("finding_id", "authorized")


@query("""with m as (select sum(case when lang = 'en' then 1 else 0 end) as a, count(*) as b from documents)
select 'share: ' || printf('%.2f', a / b * 100) || '%' as value from m""")
def text_summaries(spark, d):
    m = table(spark, d, "documents").agg((F.count_if(F.col("lang") == "en") / F.count("*")).alias("share"))
    return sinks.text_summary(m, ["share"])


@query("""with x as (select date_trunc('day', ts)::timestamp as start, event_type from events)
select start, event_type, count(*)::bigint as n from x group by start, event_type having start + interval 2 day <= (select max(ts) from events)""")
def stream_activity(spark, d):
    s = stream_of(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    base = new_path(spark, "streams/activity")
    out = logs.run_activity(s.select("ts", "event_type"), f"{base}/out", f"{base}/checkpoint")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""select 'P' || conv_id as relationship_id, count(distinct conv_id || '-' || turn)::bigint as n_from from conversations group by conv_id""")
def merged_relationships(spark, d):
    """Each conversation as an inference from its turns, stated once per role."""
    t = table(spark, d, "conversations")
    ids = t.groupBy("conv_id").agg(F.array_sort(F.collect_set(F.concat_ws("-", "conv_id", "turn"))).alias("from_finding_ids"))
    x = ids.join(t.select("conv_id", "role").distinct(), "conv_id").select(F.concat(F.lit("P"), "conv_id").alias("relationship_id"), "from_finding_ids", F.concat(F.lit("T"), "conv_id").alias("to_finding_id"))
    alias = t.select(F.concat_ws("-", "conv_id", "turn").alias("finding_id"), F.concat_ws("-", "conv_id", "turn").alias("canonical_id"))
    return merge.merge_relationships(x, alias).select("relationship_id", F.size("from_finding_ids").cast("long").alias("n_from"))


@query("""select doc_id as finding_id, rule, ok from (select doc_id, lang, length(trim(text)) > 0 as filled from documents) d, (select unnest(
  ['fact_cites_regulation', 'explanation_cites_official', 'inference_has_parents', 'judgment_has_revision', 'deleted_has_revision', 'claim_type_known', 'review_status_known', 'not_blank']) as rule),
lateral (select case rule when 'inference_has_parents' then lang <> 'en' when 'claim_type_known' then lang in ('en', 'de') when 'deleted_has_revision' then doc_id % 4 <> 0
  when 'explanation_cites_official' then lang <> 'de' when 'not_blank' then filled else true end as ok)""")
def finding_row_rules(spark, d):
    claim = F.when(F.col("lang") == "en", "ai_inference").when(F.col("lang") == "de", "official_explanation").otherwise("other")
    x = table(spark, d, "documents").select(
        F.col("doc_id").alias("finding_id"),
        claim.alias("claim_type"),
        F.col("text").alias("statement"),
        F.array(F.struct(F.lit("regulatory_text").alias("source_type"))).alias("source_anchors"),
        F.array().cast("array<string>").alias("inference_parents"),
        F.when(F.col("doc_id") % 4 == 0, "deleted").otherwise("pending").alias("review_status"),
        F.array().cast("array<string>").alias("revision_records"),
    )
    return rules.finding_rules(x)


@query()
def prompt_payloads(spark, d):
    """The JSON that each node's model call gets, as its length and digest."""
    kind = F.when(F.col("source_id") % 2 == 0, "regulatory_text").otherwise("official_interpretation")
    rows = doc_chunks(spark, d).withColumn("chunk_id", F.concat_ws(":", "source_id", "chunk_index"))
    nodes = chunk.node_plan(rows.select("chunk_id", kind.alias("source_type"), "source_id"))
    segs = big(chunk.segments(sources_of(spark, d), 3000, 2), "segment_index")
    texts = chunk.segment_text(sources_of(spark, d), segs).select("source_id", "segment_index", "text")
    found = chunk.prompts(nodes, rows.join(texts, ["source_id", "segment_index"]).select("chunk_id", F.col("segment_index").alias("ord"), "source_id", "text"))
    return found.select("node_id", F.length("payload").cast("long").alias("n_chars"), F.sha2("payload", 256).alias("digest"))


@query()
def placed_lines(spark, d):
    """Words of every document placed on a page, one line of height 10 per line, put together again."""
    lines = locate.line_units(sources_of(spark, d))
    words = lines.select("source_id", "paragraph_index", F.posexplode(F.split("text", f"{T.WS}+")).alias("k", "str"))
    items = words.select(
        "source_id",
        F.lit(1).alias("page"),
        (F.col("paragraph_index") * 100_000 + F.col("k")).alias("idx"),
        "str",
        (F.col("k") * 1000.0).alias("x"),
        (F.col("paragraph_index") * -10.0).alias("y"),
        F.lit(900.0).alias("width"),
        F.lit(8.0).alias("height"),
    )
    return ingest.lines_of_items(items).select("source_id", F.col("line").cast("long").alias("line"), "text")

"""Registered queries over the driver's tables, and SQL that gives the same rows where SQL can.

The tables stand in for the engine's own: documents are sources, their lines are units, conversations are logs, labels
are reviews, orders and parts are keyed rows with parents. Each query runs over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import attest, chunk, evaluate, locate, merge, report, review, rules
from tessera.sources import ingest
from tessera.sources.shared import bounded_batches, checkpointed, new_path
from tessera.streaming import logs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# -- units -------------------------------------------------------------------------------------------------------

_WS = "[" + "\\t\\n\\x0B\\f\\r\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}" + "]"
_TRIM = f"regexp_replace(%s, '^{_WS}+|{_WS}+$', '', 'g')"
_UNITS = f"""
lines as (
  select doc_id, unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) as l,
         generate_subscripts(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10)), 1) as k from documents),
units as (
  select doc_id as source_id, (row_number() over (partition by doc_id order by k) - 1)::bigint as paragraph_index, t as text
  from (select doc_id, k, {_TRIM % 'l'} as t from lines) where t <> '')"""


def sources_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"), "lang", "source")


def units_of(spark: SparkSession, d: str) -> DataFrame:
    return big(locate.line_units(sources_of(spark, d)), "paragraph_index")


@query(f"with {_UNITS} select source_id, paragraph_index, text from units")
def units_by_line(spark, d):
    return units_of(spark, d)


_HEADING = "case when ends_with(text, '.') and length(text) < 30 then text end"
_FILLED = f"""{_UNITS},
filled as (
  select *, last_value({_HEADING} ignore nulls) over (
    partition by source_id order by paragraph_index rows between unbounded preceding and current row) as article from units)"""


def filled_units(spark, d):
    heading = F.when(F.endswith("text", F.lit(".")) & (F.length("text") < 30), F.col("text"))
    return locate.fill_articles(checkpointed(units_of(spark, d)), heading, "source_id", "paragraph_index")


@query(f"with {_FILLED} select source_id, paragraph_index, text, article from filled")
def article_fill(spark, d):
    return filled_units(spark, d)


@query(
    f"select doc_id, length(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g'))::bigint as n_chars from documents "
    f"where length(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) < 12"
)
def low_text_docs(spark, d):
    return big(ingest.low_text(table(spark, d, "documents"), ["doc_id"]), "n_chars")


@query(f"""with {_UNITS}
select source_id, count(*)::bigint as n_units, sum(length(text))::bigint as n_chars,
       string_agg(text, chr(10) || chr(10) order by paragraph_index) as content from units group by source_id""")
def parse_summary(spark, d):
    return big(ingest.summarize(units_of(spark, d), order="paragraph_index"), "n_units", "n_chars")


def planted_anchors(units: DataFrame) -> DataFrame:
    """Each unit as a citation; of every four two are sound, one has another article and one another quote, and every
    seventh points one paragraph further."""
    k, p = F.col("paragraph_index") % 4, F.col("paragraph_index")
    return units.select(
        F.concat_ws("-", "source_id", "paragraph_index").alias("finding_id"),
        F.lit(0).alias("anchor_ord"),
        "source_id",
        "page",
        F.when(p % 7 == 6, p + 1).otherwise(p).alias("paragraph_index"),
        F.when(k == 2, F.concat(F.coalesce("article", F.lit("")), F.lit("x"))).otherwise(F.col("article")).alias("article"),
        F.when(k == 3, F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("quote"),
    )


@query(f"""with {_FILLED},
n as (select *, paragraph_index // 20 as page, coalesce(article, '') as a from filled),
q as (select source_id, page, paragraph_index,
        case when paragraph_index % 7 = 6 then paragraph_index + 1 else paragraph_index end as p,
        case when paragraph_index % 4 = 2 then a || 'x' else a end as art,
        case when paragraph_index % 4 = 3 then text || '#' else text end as quote from n),
j as (select q.source_id, q.quote, q.art, u.source_id is not null as paragraph_ok, u.a, u.text from q left join n u
        on q.source_id = u.source_id and q.page = u.page and q.p = u.paragraph_index)
select source_id, count(*)::bigint as n_quotes, count(*)::bigint as n_page,
       count(*) filter (paragraph_ok)::bigint as n_paragraph,
       count(*) filter (paragraph_ok and replace(a, ' ', '') = replace(art, ' ', ''))::bigint as n_article,
       count(*) filter (paragraph_ok and replace(a, ' ', '') = replace(art, ' ', '') and contains(text, quote))::bigint as n_quote
from j group by source_id""")
def quote_locate(spark, d):
    units = checkpointed(filled_units(spark, d).withColumn("page", F.floor(F.col("paragraph_index") / 20)))
    found = locate.locate_quotes(planted_anchors(units), units)
    by = found.withColumn("source_id", F.substring_index("finding_id", "-", 1).cast("long")).groupBy("source_id")
    n = lambda c: F.count_if(F.col(c)).alias("n_" + c.removesuffix("_ok"))
    return by.agg(F.count("*").alias("n_quotes"), n("page_ok"), n("paragraph_ok"), n("article_ok"), n("quote_ok"))


@query("select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''")
def passage_in_documents(spark, d):
    return locate.passages(table(spark, d, "benchmark"), table(spark, d, "documents"))


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 5 = 0)")
def uncovered_customers(spark, d):
    anchors = table(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("source_id"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"))
    return locate.uncovered(sources, anchors).withColumnRenamed("source_id", "c_custkey")


# -- rules -------------------------------------------------------------------------------------------------------


@query("""select o_orderkey, c_custkey is not null as key_found, coalesce(c_nationkey = o_orderkey % 25, false) as fields_match
from (select o_orderkey, o_custkey from orders) o left join customer c on o.o_custkey = c.c_custkey""")
def source_integrity(spark, d):
    children = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 25).alias("n"))
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("n"))
    return rules.reference_integrity(children, parents, "k", ["n"]).select("o_orderkey", "key_found", "fields_match")


_EDGES = "select doc_id as child, case when doc_id % 5 = 0 then doc_id when doc_id % 5 = 1 then doc_id + 1 when doc_id % 5 = 2 then -1 else doc_id // 2 end as parent from documents"


def doc_edges(docs: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    parent = F.when(i % 5 == 0, i).when(i % 5 == 1, i + 1).when(i % 5 == 2, F.lit(-1)).otherwise(F.floor(i / 2))
    return docs.select(i.alias("child"), parent.cast("long").alias("parent"))


@query(f"""with e as ({_EDGES})
select child, parent, d.doc_id is not null as "exists", child <> parent as not_self, coalesce(d.doc_id < child, false) as upstream
from e left join documents d on d.doc_id = e.parent""")
def upstream_parents(spark, d):
    docs = table(spark, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("ord"))
    return rules.upstream_parents(doc_edges(docs), nodes)


@query("select text, count(*)::bigint as n from documents group by text having count(*) > 1")
def repeated_texts(spark, d):
    return rules.unique_ids(table(spark, d, "documents"), "text")


def planted_findings(spark, d, units):
    """A finding per unit with planted faults: every tenth says a date that it does not quote, is an atomic requirement, or
    is an inference without parents."""
    a = planted_anchors(units).withColumn("source_type", F.lit("regulatory_text"))
    a = a.withColumn("k", F.substring_index("finding_id", "-", -1).cast("long") % 10)
    anchor = F.struct("source_id", "source_type", "page", "article", "paragraph_index", "quote")
    return a.select(
        "finding_id",
        F.when(F.col("k") == 9, "ai_inference").otherwise("regulatory_fact").alias("claim_type"),
        F.when(F.col("k") == 8, "atomic_requirement").otherwise("key_matter:core_requirement").alias("category"),
        F.when(F.col("k") == 5, F.concat("quote", F.lit(" 2031-02-03"))).otherwise(F.col("quote")).alias("statement"),
        F.array(anchor).alias("source_anchors"),
        F.array().cast("array<string>").alias("inference_parents"),
    )


@query(f"""with {_FILLED},
n as (select *, paragraph_index // 20 as page, coalesce(article, '') as a from filled),
q as (select source_id, page, paragraph_index % 20 as k, case when paragraph_index % 7 = 6 then paragraph_index + 1 else paragraph_index end as p,
        case when paragraph_index % 4 = 2 then a || 'x' else a end as art,
        case when paragraph_index % 4 = 3 then text || '#' else text end as quote from n),
j as (select k, u.source_id is not null as p_ok, u.source_id is not null and replace(a, ' ', '') = replace(art, ' ', '') as a_ok,
        u.source_id is not null and replace(a, ' ', '') = replace(art, ' ', '') and contains(text, quote) as q_ok
      from q left join n u on q.source_id = u.source_id and q.page = u.page and q.p = u.paragraph_index),
r as (select unnest(['source_id', 'source_type', 'locator_page', 'locator_paragraph', 'locator_article', 'quote_match', 'atomic_structure',
                    'modal_strength', 'dates', 'numbers', 'inference_parent']) as rule,
         unnest(['passed', 'passed', 'passed', case when p_ok then 'passed' else 'failed' end, case when a_ok then 'passed' else 'failed' end, case when q_ok then 'passed' else 'failed' end,
                 case when k = 8 then 'manual_review_required' when k = 18 then 'failed' else 'passed' end,
                 case when k % 10 = 5 then 'failed' when k = 8 then 'manual_review_required' when k = 18 then 'failed' else 'passed' end,
                 case when k % 10 = 5 then 'failed' else 'passed' end, case when k % 10 = 5 then 'failed' else 'passed' end, case when k % 10 = 9 then 'failed' else 'passed' end]) as status from j)
select rule, status, count(*)::bigint as n from r group by all""")
def validate_findings(spark, d):
    units = checkpointed(filled_units(spark, d).withColumns({"page": F.floor(F.col("paragraph_index") / 20), "source_type": F.lit("regulatory_text")}))
    sources = sources_of(spark, d).withColumn("source_type", F.lit("regulatory_text"))
    pairs = spark.createDataFrame([], "official_source_id long, primary_source_ids array<string>")
    findings = planted_findings(spark, d, units)
    atomic = findings.where("category = 'atomic_requirement'").withColumn("k", F.substring_index("finding_id", "-", -1).cast("long") % 20)
    single = F.col("k") == 8
    structures = atomic.select("finding_id", F.when(single, "manual_review_required").otherwise("failed").alias("status"), single.alias("strength_review"))
    found = rules.validate_findings(findings, sources, units, pairs, structures)
    return found.groupBy("rule", "status").agg(F.count("*").alias("n"))


@query("""with w as (select p_partkey as req_id, [p_brand, p_type, split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] as w from part),
x as (select req_id, w, w[4] || w[1] || w[2] || w[3] as t from w),
i as (select unnest(range(1, 5)) as i),
p as (select a.i as a, b.i as b, c.i as c, d.i as d from i a, i b, i c, i d where len(list_distinct([a.i, b.i, c.i, d.i])) = 4)
select req_id, count(*) filter (w[a] || w[b] || w[c] || w[d] = t)::bigint as n_tilings from x, p group by req_id""")
def exact_tilings(spark, d):
    words = table(spark, d, "part").select(F.col("p_partkey").alias("req_id"), F.array("p_brand", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("w"))
    fields = words.select("req_id", F.posexplode("w").alias("field", "value"))
    texts = words.select("req_id", F.concat(F.col("w")[3], F.col("w")[0], F.col("w")[1], F.col("w")[2]).alias("text"))
    return rules.tilings(fields, texts)


_CRED = r"(?i)(?:(?:^|[^A-Za-z0-9_])(?:sk|pk)-[A-Za-z0-9_-]{8,}|Bearer\s+\S+|api[_ -]?key\s*[:=]\s*\S+|session[-_ ]?secret|credential\s*[:=])"


@query(f"""select 'documents' as origin, count(*)::bigint as n, count(*) filter (regexp_matches(text, '{_CRED}'))::bigint as n_found from documents
union all select 'pages', count(*), count(*) filter (regexp_matches(html, '{_CRED}')) from pages""")
def credential_scan(spark, d):
    found = lambda name, c: table(spark, d, name).agg(
        F.lit(name).alias("origin"), F.count("*").alias("n"), F.count_if(T.has_credentials(F.col(c))).alias("n_found")
    )
    return found("documents", "text").unionByName(found("pages", "html"))


# -- attestations and quality ------------------------------------------------------------------------------------

_STATUS = "case when quality = 0 then 'failed' when toxic = 1 then 'manual_review_required' else 'passed' end"


def label_reviews(spark, d):
    """Validations of labelled documents, attestations of some, and the digests that are current."""
    x = table(spark, d, "labels")
    status = F.when(F.col("quality") == 0, "failed").when(F.col("toxic") == 1, "manual_review_required").otherwise("passed")
    v = x.select(F.col("doc_id").alias("finding_id"), F.lit("quote_match").alias("rule"), status.alias("status"))
    i = F.col("doc_id")
    bind = x.select(i.alias("finding_id"), F.sha2(i.cast("string"), 256).alias("source_evidence_hash"), F.lit("f").alias("finding_hash"), F.lit(None).cast("string").alias("atomic_requirement_hash"))
    a = x.where(i % 3 == 0).select(
        i.alias("finding_id"),
        F.lit("quote_match").alias("rule"),
        F.when(i % 2 == 0, "confirmed").otherwise("rejected").alias("decision"),
        F.sha2(F.when(i % 9 == 0, F.lit("old")).otherwise(i.cast("string")), 256).alias("source_evidence_hash"),
        F.lit("f").alias("finding_hash"),
        F.lit(None).cast("string").alias("atomic_requirement_hash"),
    )
    return v, a, bind


_RESOLVED = f"""r as (select doc_id, {_STATUS} as status, doc_id % 3 = 0 as has, doc_id % 9 = 0 as bad, doc_id % 2 = 0 as yes from labels),
x as (select doc_id as finding_id, 'quote_match' as rule, status,
        case when status = 'failed' then 'failed' when bad then 'attestation_integrity_failed' when has and not yes then 'manual_rejected'
             when status = 'passed' then 'automatic_passed' when not has then 'manual_review_pending' else 'manual_confirmed' end as resolution
      from r),
resolved as (select *, resolution in ('automatic_passed', 'manual_confirmed') as effective_passed from x
      union all select doc_id, 'attestation_integrity', 'failed', 'attestation_integrity_failed', false from r where bad and status = 'failed')"""


@query(f"with {_RESOLVED} select finding_id, rule, status, resolution, effective_passed from resolved")
def rule_resolutions(spark, d):
    return attest.resolve(*label_reviews(spark, d))


@query(f"""with {_RESOLVED} select rule, {', '.join(f"count(*) filter (resolution = '{r}')::bigint as {r}" for r in attest.RESOLUTIONS)} from resolved group by rule""")
def resolution_counts(spark, d):
    return attest.resolution_counts(attest.resolve(*label_reviews(spark, d)), "rule")


@query(f"""with {_RESOLVED}, b as (select finding_id, bool_or(resolution = 'attestation_integrity_failed') as integrity_failed from resolved group by 1)
select finding_id, rule, resolution, integrity_failed from resolved join b using (finding_id) where resolution in ('manual_review_pending', 'manual_rejected')""")
def rule_work_queue(spark, d):
    return attest.work_queue(attest.resolve(*label_reviews(spark, d))).select("finding_id", "rule", "resolution", "integrity_failed")


@query(f"""with {_RESOLVED} select count(distinct case when resolution = 'attestation_integrity_failed' then
  case when rule = 'attestation_integrity' then 'attestation_import' else finding_id || ':' || rule end end)::bigint as n_keys from resolved""")
def integrity_key_count(spark, d):
    return attest.integrity_keys(attest.resolve(*label_reviews(spark, d)))


def quality_flags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project_id"), "lang", "n_chars")
    x = docs.join(table(spark, d, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return x.select(
        "project_id",
        (F.col("lang") == "en").alias("is_fact"),
        (F.col("n_chars") >= 100).alias("has_citation"),
        F.col("quality").isNotNull().alias("is_evidence"),
        good.alias("reverse_passed"),
        F.coalesce(F.col("quality") == 0, F.lit(False)).alias("unsupported"),
        (F.col("lang") == "fr").alias("is_inference"),
        (F.col("n_chars") >= 500).alias("is_marked"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("needs_review"),
        good.alias("is_reviewed"),
    )


_METRICS = """m as (select source as project_id,
  coalesce(count(*) filter (lang = 'en' and n_chars >= 100) / nullif(count(*) filter (lang = 'en'), 0), 0.0)::double as citation_coverage,
  coalesce(count(*) filter (quality = 1) / nullif(count(quality), 0), 0.0)::double as reverse_check_rate,
  count(*) filter (quality = 0)::bigint as unsupported_count,
  coalesce(count(*) filter (lang = 'fr' and n_chars >= 500) / nullif(count(*) filter (lang = 'fr'), 0), 1.0)::double as inference_marking_rate,
  coalesce(count(*) filter (toxic = 1 and quality = 1) / nullif(count(*) filter (toxic = 1), 0), 1.0)::double as review_completion_rate,
  count(*)::bigint as n_findings from documents left join labels using (doc_id) group by source)"""
_RATES = ("citation_coverage", "reverse_check_rate", "inference_marking_rate", "review_completion_rate")
_ROUNDED = ", ".join(f"round({r}, 9) as {r}" for r in _RATES)


def rounded(df: DataFrame, names) -> DataFrame:
    return df.withColumns({r: F.round(r, 9) for r in names})


@query(f"with {_METRICS} select project_id, {_ROUNDED}, unsupported_count, n_findings from m")
def quality_metrics(spark, d):
    return rounded(attest.quality_metrics(quality_flags(spark, d)), _RATES)


@query(f"""with {_METRICS} select project_id, unsupported_count = 0 and n_findings > 0 and {' and '.join(f'{r} = 1' for r in _RATES)} as gate_passed from m""")
def quality_gate(spark, d):
    return attest.quality_gate(attest.quality_metrics(quality_flags(spark, d))).select("project_id", "gate_passed")


# -- merging -----------------------------------------------------------------------------------------------------

_COLLAPSE = f"regexp_replace(regexp_replace(%s, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"""select arg_min(doc_id, doc_id) as doc_id, arg_min(source, doc_id) as source, lang, count(*)::bigint as n_rows
from documents group by lang, {_COLLAPSE % 'text'}""")
def dedup_merge(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source", "lang", "text")
    return merge.first_of(x, [F.col("lang"), merge.text_key("text")], "doc_id").drop("text")


@query(f"""with c as (select doc_id // 2 as finding_id, min(doc_id // 2) over (partition by lang, {_COLLAPSE % 'text'}) as canonical_id from documents)
select finding_id, min(canonical_id) as canonical_id, count(distinct canonical_id) > 1 as conflict from c group by finding_id""")
def merge_aliases(spark, d):
    """Two documents share an id, which is a conflict unless they are one claim."""
    half = F.floor(F.col("doc_id") / 2)
    x = table(spark, d, "documents").select(half.alias("finding_id"), F.col("doc_id").alias("ord"), "lang", "text")
    return merge.aliases(x, [F.col("lang"), merge.text_key("text")])


def turn_findings(spark, d):
    """Turns of conversations as findings: the role is the category, and turns with equal texts are one claim."""
    t = table(spark, d, "conversations")
    anchor = F.struct(F.col("conv_id").cast("string").alias("source_id"), F.col("turn").cast("string").alias("quote"))
    return t.select(
        F.concat_ws("-", "conv_id", "turn").alias("finding_id"),
        F.lit("regulatory_fact").alias("claim_type"),
        F.col("role").alias("category"),
        F.col("text").alias("statement"),
        F.array(anchor).alias("source_anchors"),
        F.array(F.col("role")).alias("inference_parents"),
        (F.col("turn") == 0).alias("required_review"),
        F.array(F.struct(F.col("turn").alias("n"))).alias("revision_records"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
    )


@query(f"""select arg_min(conv_id || '-' || turn, conv_id * 1000 + turn) as finding_id, count(distinct conv_id || '/' || turn)::bigint as n_anchors,
  count(distinct role)::bigint as n_parents, bool_or(turn = 0) as required_review, count(*)::bigint as n_revisions
from conversations group by role, {_COLLAPSE % 'text'}""")
def merge_findings(spark, d):
    x = merge.merge_findings(turn_findings(spark, d))
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return x.select("finding_id", n("source_anchors", "n_anchors"), n("inference_parents", "n_parents"), "required_review", n("revision_records", "n_revisions"))


@query("""with b as (select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey % 7 <> 0),
a as (select o_orderkey, case when o_orderkey % 5 = 0 then 'X' else o_orderstatus end as o_orderstatus, o_totalprice from orders where o_orderkey % 11 <> 0)
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'removed' when b.o_orderkey is null then 'added'
  when a.o_orderstatus = b.o_orderstatus then 'retained' else 'replaced' end as change from a full join b using (o_orderkey)""")
def version_diff(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    after = x.where(k % 11 != 0).withColumn("o_orderstatus", F.when(k % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return merge.diff(x.where(k % 7 != 0), after, "o_orderkey")


# -- evaluation --------------------------------------------------------------------------------------------------


def corpora(spark, d):
    """Labelled good documents against documents of 200 characters and more, by language and text."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("text").alias("statement"), "n_chars")
    good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return docs.join(good, "id", "left_semi"), docs.where("n_chars >= 200")


_MATCHED = """e as (select doc_id, lang, text, row_number() over (partition by lang, text order by doc_id) as n
       from documents where doc_id in (select doc_id from labels where quality = 1)),
a as (select doc_id, lang, text, row_number() over (partition by lang, text order by doc_id) as n from documents where n_chars >= 200),
m as (select e.doc_id as expected_id, a.doc_id as actual_id, e.lang from e join a using (lang, text, n))"""


@query(f"with {_MATCHED} select expected_id, actual_id from m")
def one_to_one_matches(spark, d):
    expected, actual = corpora(spark, d)
    return evaluate.match(expected, actual, ["category", "statement"])


_COUNTED = f"""{_MATCHED},
l as (select lang as category from e union select lang from a),
c as (select category, (select count(*) from m where lang = category) as tp, (select count(*) from a where lang = category) as n_a,
             (select count(*) from e where lang = category) as n_e from l),
s as (select category, tp, n_a - tp as fp, n_e - tp as fn from c
      union all select null, sum(tp), sum(n_a - tp), sum(n_e - tp) from c)"""


@query(f"""with {_COUNTED} select category, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(tp / nullif(tp + fp, 0), 9)::double as "precision",
  round(tp / nullif(tp + fn, 0), 9)::double as recall from s""")
def eval_precision_recall(spark, d):
    expected, actual = corpora(spark, d)
    found = evaluate.match(expected, actual, ["category", "statement"])
    return rounded(evaluate.counts(expected, actual, found, "category"), ["precision", "recall"])


@query()
def ocr_accuracy(spark, d):
    """Whole turns against the turns that follow them, per conversation page."""
    t = table(spark, d, "conversations")
    following = t.select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    return big(evaluate.page_accuracy(t.select("conv_id", "turn", "text"), following, ["conv_id", "turn"]), "errors", "n_chars")


@query(f"""with {_COUNTED},
t as (select tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r, (select count(*) from e where doc_id not in (select expected_id from m)) as n from s where category is null),
f as (select list_concat(
   list_concat(case when p < 0.95 then ['critical_precision_below_95:core_requirement', 'critical_precision_below_95:prohibition', 'critical_precision_below_95:key_date', 'critical_precision_below_95:transition_period'] else [] end,
               case when r < 0.95 then ['critical_recall_below_95:core_requirement', 'critical_recall_below_95:prohibition', 'critical_recall_below_95:key_date', 'critical_recall_below_95:transition_period'] else [] end),
   list_concat(list_concat(case when p < 0.9 then ['atomic_precision_below_90'] else [] end, case when r < 0.85 then ['atomic_recall_below_85'] else [] end),
               case when n > 0 then ['critical_omissions'] else [] end)) as fs from t)
select unnest(fs) as failure from f""")
def release_gate(spark, d):
    expected, actual = corpora(spark, d)
    found = evaluate.match(expected, actual, ["category", "statement"])
    total = evaluate.counts(expected, actual, found, "category").where("category is null")
    kinds = [*evaluate.CRITICAL, "atomic"]
    missing = expected.join(found, expected["id"] == found["expected_id"], "left_anti").agg(F.count("*").alias("n_omissions"))
    one = total.select(*(F.col(m).alias(f"{m}_{k}") for k in kinds for m in ("precision", "recall"))).crossJoin(missing)  # one row each
    row = one.withColumns({"citation_rate": F.lit(1.0), "n_unmarked": F.lit(0), "ocr_accuracy": F.lit(1.0), "ocr_coverage": F.lit(True), "n_pending": F.lit(0)})
    return evaluate.gate(row).select(F.explode("failures").alias("failure"))


# -- chunks and plans --------------------------------------------------------------------------------------------

_SEGMENTS = """g as (select doc_id as source_id, coalesce(length(text), 0) as n, greatest(ceil(coalesce(length(text), 0) / 1000)::bigint, 1) as c from documents),
segs as (select source_id, unnest(range(0, c)) as segment_index, n, c from g)"""


def doc_segments(spark, d):
    return big(chunk.segments(sources_of(spark, d), 3000, 2), "segment_index", "start", "end")


@query(f"""with {_SEGMENTS} select source_id, segment_index::bigint as segment_index, (segment_index * 1000)::bigint as start,
  least((segment_index + 1) * 1000, n)::bigint as "end" from segs""")
def segments(spark, d):
    return doc_segments(spark, d)


_CHUNKS = f"""{_SEGMENTS},
k as (select source_id, unnest(range(0, greatest(c - 2, 1))) as chunk_index, c from g),
chunks as (select source_id, chunk_index::bigint as chunk_index, unnest(range(chunk_index, least(chunk_index + 3, c)))::bigint as segment_index from k)"""


def doc_chunks(spark, d):
    segs = doc_segments(spark, d).withColumns({"doc": F.col("source_id"), "ord": F.col("segment_index")})
    return chunk.chunks(segs, "doc", 3000, 2).drop("doc")


@query(f"with {_CHUNKS} select source_id, chunk_index, segment_index from chunks")
def chunks(spark, d):
    return doc_chunks(spark, d)


@query(f"""with {_CHUNKS}, r as (select distinct source_id || ':' || chunk_index as chunk_id, case when source_id % 2 = 0 then 'regulatory_text' else 'official_interpretation' end as source_type, source_id from chunks),
s as (select unnest([0, 0, 1, 2, 3]) as stage_ord, unnest(['identity', 'identity', 'atomic', 'key_matters', 'impact']) as stage,
  unnest(['regulatory_text', 'official_interpretation', 'regulatory_text', 'regulatory_text', 'regulatory_text']) as source_type)
select stage || ':' || chunk_id || case when stage_ord = 0 and source_type = 'official_interpretation' then ':' || source_id else '' end as node_id, stage,
  stage_ord::int as stage_ord, source_type, chunk_id from r join s using (source_type)""")
def node_plan(spark, d):
    kind = F.when(F.col("source_id") % 2 == 0, "regulatory_text").otherwise("official_interpretation")
    rows = doc_chunks(spark, d).select(F.concat_ws(":", "source_id", "chunk_index").alias("chunk_id"), kind.alias("source_type"), "source_id")
    return chunk.node_plan(rows)


@query("select event_id from events where event_id not in (select event_id from events where value > 50 and event_type <> 'error')")
def resume_remaining(spark, d):
    plan = table(spark, d, "events").select("event_id")
    runs = table(spark, d, "events").select("event_id", (F.col("event_type") != "error").alias("is_valid"), "value").where("value > 50")
    return chunk.remaining(plan, runs, "event_id")


# -- logs --------------------------------------------------------------------------------------------------------


def turn_log(t: DataFrame) -> DataFrame:
    """Turns as audits: a turn's digest after, and the digest before that it names, wrong for every fifth."""
    own = F.sha2(F.col("text"), 256)
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.sha2("text", 256).alias("_before"))
    named = F.when(F.col("turn") % 5 == 4, "x").otherwise(F.coalesce("_before", F.lit("")))
    return t.join(before, ["conv_id", "turn"], "left").select("conv_id", F.col("turn").alias("seq"), named.alias("before_hash"), own.alias("after_hash"), F.col("turn").alias("at"))


_CHAIN = """l as (select conv_id, turn, text, lag(sha256(text)) over w as prev, lag(turn) over w as prev_turn, lag(1) over w is null as first,
   case when turn % 5 = 4 then 'x' else coalesce((select sha256(b.text) from conversations b where b.conv_id = a.conv_id and b.turn = a.turn - 1), '') end as named
  from conversations a window w as (partition by conv_id order by turn)),
c as (select conv_id, turn, text, first or coalesce(prev = named, false) as link_ok, first or coalesce(prev_turn < turn, false) as time_ok from l)"""


@query(f"""with {_CHAIN} select conv_id, count(*)::bigint as n_rows, bool_and(link_ok and time_ok) as chain_ok, sha256(arg_max(text, turn)) as last_hash from c group by conv_id""")
def audit_chain(spark, d):
    log = review.chain(turn_log(table(spark, d, "conversations")), "conv_id", "before_hash", "after_hash", "at")
    return review.chain_summary(log, "conv_id", "after_hash")


@query("""with recursive r(node, depth) as (select 1::bigint, 0 union all select p_partkey::bigint, depth + 1 from part join r on p_partkey // 2 = node where p_partkey > 1)
select node, depth::int as depth from r""")
def closure(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("child")).where("child > 1")
    edges = part.select(F.floor(F.col("child") / 2).cast("long").alias("parent"), "child")
    return review.closure(edges, spark.range(1, 2).withColumnRenamed("id", "node"))


@query("select user_id, arg_max(event_id, ts) as event_id, max(ts) as ts from events group by user_id")
def latest_per_user(spark, d):
    x = table(spark, d, "events").select("user_id", "event_id", "ts")
    return review.latest(x, "user_id", "ts")


@query("""select conv_id, (sum(n) over w - n)::bigint as first, (sum(n) over w)::bigint as last, turn from (select conv_id, turn, length(text)::bigint as n from conversations)
window w as (partition by conv_id order by turn rows between unbounded preceding and current row)""")
def output_slices(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return review.slices(t, F.length("text").cast("long"), "conv_id", "turn").drop("text")


@query("""select o_orderkey, coalesce(m, 0) = o_orderkey % 3 and row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey) = 1 as accepted
from orders left join (select c_custkey, c_custkey % 3 as m from customer) on c_custkey = o_custkey""")
def accepted_revisions(spark, d):
    o = table(spark, d, "orders")
    wanted = (F.col("o_orderkey") % 3).alias("expected_revision")
    c = o.select("o_orderkey", F.col("o_custkey").alias("project_id"), wanted, F.col("o_orderkey").alias("submitted_at"))
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 3).alias("revision"))
    return review.accept_revisions(c, s).select("o_orderkey", "accepted")


@query("""with p as (select source, count(distinct doc_id)::bigint as n, sum(('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint)::bigint as h from documents where lang = 'en' group by source)
select d.doc_id, d.source, coalesce(n, 0) as n_primary, coalesce(h, 0) as primary_digest from documents d left join p using (source) where d.lang = 'es'""")
def project_pairs(spark, d):
    kind = F.when(F.col("lang") == "en", "regulatory_text").when(F.col("lang") == "es", "official_interpretation")
    x = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").cast("string").alias("source_id"), kind.alias("source_type"))
    official, _ = locate.pairs_of_project(x)
    return official.select(F.col("official_source_id").cast("long").alias("doc_id"), F.col("project_id").alias("source"), "n_primary", "primary_digest")


@query("select source as project_id, doc_id as primary_source_id from documents where lang = 'en'")
def project_primaries(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("source_id"), F.when(F.col("lang") == "en", "regulatory_text").otherwise("x").alias("source_type"))
    return locate.pairs_of_project(x)[1]


# -- reports -----------------------------------------------------------------------------------------------------


@query("""select o_orderpriority, o_orderkey, rank from (select o_orderpriority, o_orderkey,
  row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as rank from orders) where rank <= 5""")
def report_topk(spark, d):
    x = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return report.top_per_group(x, ["o_orderpriority"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5).drop("o_totalprice")


def doc_findings(spark, d):
    """Documents as findings: categories by id, claims by language."""
    kinds = ["key_matter:core_requirement", "key_matter:prohibition", "document_identity:deadline", "official_context:policy_background", "institution_impact:data", "applicability", "recommended_action:priority"]
    category = reduce(lambda c, k: c.when(F.col("doc_id") % 7 == k, kinds[k]), range(1, 7), F.when(F.col("doc_id") % 7 == 0, kinds[0]))
    claim = F.when(F.col("lang") == "en", "ai_inference").when(F.col("lang") == "de", "official_explanation").otherwise("regulatory_fact")
    return table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("ord"), category.alias("category"), claim.alias("claim_type"))


_SECTIONED = """f as (select source as project_id, doc_id as ord, ['key_matter:core_requirement', 'key_matter:prohibition', 'document_identity:deadline',
   'official_context:policy_background', 'institution_impact:data', 'applicability', 'recommended_action:priority'][doc_id %% 7 + 1] as category,
   case lang when 'en' then 'ai_inference' when 'de' then 'official_explanation' else 'regulatory_fact' end as claim_type from documents),
s as (select *, unnest(%s) as section_ord from f)
select project_id, section_ord::int as section_ord, item_ord::int as item_ord, ord from (
  select *, row_number() over (partition by project_id, section_ord order by ord) as item_ord from s where %s) where item_ord <= %s"""
_FULL_SQL = " or ".join(
    f"section_ord = {k} and ({c})"
    for k, c in enumerate(
        (
            "category like '%core_requirement%' or category like '%prohibition%'",
            "category like '%document_identity%'",
            "category like '%official_context%'",
            "category like '%applicability%'",
            "category like '%core_requirement%'",
            "category like '%prohibition%'",
            "category = 'document_identity:deadline'",
            "category = 'institution_impact:data' and claim_type = 'ai_inference'",
            "category = 'recommended_action:priority'",
            "false",
            "true",
        )
    )
)
_QUICK_SQL = " or ".join(
    f"section_ord = {k} and ({c})"
    for k, c in enumerate(
        (
            "category like '%key_matter%' or category = 'applicability'",
            "category like '%official_context%'",
            "category like '%key_matter%' or category = 'applicability'",
            "category like '%prohibition%'",
            "category = 'document_identity:deadline'",
            "category = 'applicability' or category = 'institution_impact:data' and claim_type = 'ai_inference'",
            "category = 'recommended_action:priority'",
            "claim_type = 'official_explanation'",
        )
    )
)


@query("with " + _SECTIONED % ("range(0, 11)", _FULL_SQL, "case when section_ord = 0 then 3 else 9223372036854775807 end"))
def full_report(spark, d):
    return report.route(doc_findings(spark, d), report.FULL).select("project_id", "section_ord", "item_ord", "ord")


@query("with " + _SECTIONED % ("range(0, 8)", _QUICK_SQL, "[1, 2, 5, 3, 3, 3, 5, 2][section_ord + 1]"))
def quick_commentary(spark, d):
    return report.route(doc_findings(spark, d), report.QUICK).select("project_id", "section_ord", "item_ord", "ord")


@query("""select doc_id, (case when quality = 0 then -100 else 0 end + case when toxic = 1 then 20 else 0 end + case when doc_id % 2 = 0 and quality <> 0 then 10 else 0 end
  + case when doc_id % 3 = 0 then 5 else 0 end)::int as score from labels""")
def review_queue(spark, d):
    i = F.col("doc_id")
    x = table(spark, d, "labels").select(
        i.alias("ord"),
        F.when(F.col("quality") == 0, "deleted").when(i % 2 == 0, "pending").otherwise("confirmed").alias("review_status"),
        (F.col("toxic") == 1).alias("required_review"),
        F.when(i % 3 == 0, "regulatory_fact").otherwise("ai_inference").alias("claim_type"),
    )
    return report.review_queue(x).select(F.col("ord").alias("doc_id"), "score")


# -- text --------------------------------------------------------------------------------------------------------


@query()
def claim_tokens(spark, d):
    """Dates, numbers, obligation words and the digest of every document."""
    x = table(spark, d, "documents").select("doc_id", T.nfkc("text").alias("t"))
    return x.select(
        "doc_id",
        F.array_join(T.date_tokens("t"), ",").alias("dates"),
        F.array_join(T.number_tokens("t"), ",").alias("numbers"),
        F.size(T.modal_terms(F.col("t"))).cast("long").alias("n_modals"),
        T.digest("t").alias("digest"),
    )


@query()
def normalized_texts(spark, d):
    x = table(spark, d, "documents").select("doc_id", T.nfkc("text").alias("t"))
    x = x.withColumn("s", T.squeeze(F.col("t")))  # once for both forms that need it
    return x.select("doc_id", F.sha2("s", 256).alias("squeezed"), F.sha2(T.without_punctuation(F.col("s")), 256).alias("compact"), F.length(T.strip_ws(F.col("t"))).cast("long").alias("n_solid"))


# -- streams -----------------------------------------------------------------------------------------------------


def stream_of(spark, d, name):
    schema = table(spark, d, name).schema
    one = spark.read.parquet(f"{d}/{name}.parquet").inputFiles()
    whole_dir = any(f"/{name}.parquet/" in f for f in one)
    return logs.read_stream(spark, f"{d}/{name}.parquet" if whole_dir else d, schema, "*.parquet" if whole_dir else f"{name}.parquet")


def _folders(spark, name):
    base = new_path(spark, f"streams/{name}")
    return f"{base}/out", f"{base}/checkpoint"


@query("select event_id, event_type from events")
def stream_without_repeats(spark, d):
    s = stream_of(spark, d, "events")
    twice = s.unionByName(s)
    return logs.run_available(logs.without_repeats(twice.select("event_id", "event_type"), "event_id"), *_folders(spark, "repeats"))


@query(f"with {_UNITS} select source_id, paragraph_index, text from units")
def stream_ingest(spark, d):
    s = stream_of(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("text").alias("content"))
    return logs.run_available(big(logs.ingest_lines(s), "paragraph_index"), *_folders(spark, "ingest"))


@query("""with t as (select conv_id, turn, text, case when turn % 5 = 4 then 'x' else '' end as named from conversations)
select conv_id, turn as seq, turn = (min(turn) over (partition by conv_id)) or turn % 5 <> 4 as link_ok, true as time_ok from t""")
def stream_chain(spark, d):
    s = stream_of(spark, d, "conversations")
    x = s.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.when(F.col("turn") % 5 == 4, "x").otherwise("").alias("before_hash"),
        F.lit("").alias("after_hash"),
        F.timestamp_seconds("turn").alias("ts"),
    )
    return logs.fold_chains(logs.run_available(x, *_folders(spark, "chain")), "conv_id")

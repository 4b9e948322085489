"""Queries of what can be proved again: parsed sources, replayed review logs, sealed versions, protected tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessera.functions import text as T
from tessera.operators import locate, parsing, provenance, review
from tessera.plans.queries import _WS, query, table
from tessera.sources import exchange
from tessera.sources.shared import checkpointed, dealt

# -- evidence of parsing -----------------------------------------------------------------------------------------

NONE = "cast(array() as array<int>)"


def parsed_documents(spark, d) -> dict:
    """Documents as sources with their outcomes; what is wrong with one follows from its id modulo 30."""
    f = F.col("source_id") % 30
    docs = table(spark, d, "documents").where("text is not null")
    sources = docs.select(F.col("doc_id").alias("source_id"), F.when(F.col("lang") == "en", "regulatory_text").otherwise("official_interpretation").alias("source_type"), F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("content"))
    # units are kept, as evidence is asked of them many times; contents are read anew, as they would take as much disk as the documents
    lines = checkpointed(locate.line_units(sources, more=("source_type",)), "zstd")
    ord_ = F.col("paragraph_index")
    units = lines.select(
        "source_id",
        "source_type",
        F.when(f == 19, 1).alias("page"),
        F.lit(None).cast("string").alias("article"),
        F.when(f == 17, 0).otherwise(ord_).alias("paragraph_index"),
        F.when((f == 15) & (ord_ == 0), " ").when(f == 16, "same").otherwise(ord_.cast("string")).alias("unit_id"),
        "text",
        F.lit("text").alias("extraction_method"),
        F.lit(1.0).alias("confidence"),
        ord_.alias("ord"),
    )
    parsed = units.withColumn("owner_id", F.col("source_id"))
    counts = units.groupBy("source_id").agg(F.count("*").alias("n"))
    digests = parsing.unit_digests(parsed).select(F.col("owner_id").alias("source_id"), "digest")
    # of a content only digests and its length are shuffled
    told = sources.select(
        "source_id",
        "source_type",
        parsing.row_hash(*sources.columns).alias("source_hash"),
        F.sha2("content", 256).alias("file_hash"),
        parsing.utf16_length("content").alias("total_characters"),
    )
    x = told.join(counts, "source_id", "left").join(digests, "source_id", "left")
    n, paged = F.coalesce("n", F.lit(0)), f.isin(14, 19)
    outcomes = x.select(
        "source_id",
        F.when(f == 3, "other").otherwise(F.col("source_type")).alias("source_type"),
        F.when(f == 2, "other").otherwise(F.col("source_hash")).alias("source_hash"),
        F.when(f == 1, "short").otherwise(F.col("file_hash")).alias("file_hash"),
        F.when(f == 14, 2).when(f == 19, 1).alias("page_count"),
        F.when(paged, F.array(F.lit(1))).otherwise(F.expr(NONE)).alias("successful_pages"),
        F.when(f == 5, F.array(F.lit(1))).otherwise(F.expr(NONE)).alias("failed_pages"),
        F.when(f == 5, 1).otherwise(0).alias("failed_page_count"),
        F.when(f == 6, F.array(F.lit(1))).otherwise(F.expr(NONE)).alias("ocr_failed_pages"),
        (n + F.when(f == 8, 1).otherwise(0)).alias("parsed_unit_count"),
        (F.col("total_characters") + F.when(f == 9, 1).otherwise(0)).alias("total_characters"),
        F.when(f == 10, "x").otherwise(F.coalesce("digest", F.lit(provenance.NO_ROOT))).alias("ordered_unit_digest"),
        F.when(f == 7, 0.5).otherwise(1.0).alias("extraction_coverage"),
        (f == 4).alias("finalization_blocked"),
    ).where(f != 13)
    return dict(
        sources=sources,
        outcomes=outcomes.withColumn("_k", F.explode(F.when(f == 18, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k"),
        parsed=parsed,
        units=units.withColumn("confidence", F.when((f == 11) & (ord_ == 0), 0.0).otherwise(F.col("confidence"))),
        # no unit here has an article that the next ones would carry on, so units cite themselves as they lie
        citations=parsed.where((T.trim_ws(F.col("text")) != "") & (F.col("owner_id") % 30 != 12)).select("owner_id", "ord", *parsing.ANCHOR[:-1], F.col("text").alias("quote")),
    )


@query(rf"""with s as (select doc_id as i, doc_id % 30 as f, regexp_replace(text, chr(10), chr(10) || chr(10), 'g') as content, lang from documents where text is not null),
l as (select i, f, content, lang, list_filter(list_transform(string_split(regexp_replace(content, '\r\n|\r', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> '') as u from s),
x as (select *, len(u) as n, f <> 13 as has, regexp_replace(regexp_replace(content, '\r\n?', chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g') as plain from l),
r as (select i, lang, [case when plain = '' then 'content_not_blank' end, case when n = 0 then 'has_text_unit' end, case when not has or f = 18 then 'one_outcome' end,
  case when not has or f = 1 then 'hash_is_sha256' end, case when not has or f = 2 then 'source_as_parsed' end, case when not has or f = 3 then 'type_agrees' end, case when not has or f = 4 then 'not_blocked' end,
  case when not has or f = 5 then 'no_failed_pages' end, case when not has or f = 6 then 'no_ocr_failures' end, case when not has or f = 7 then 'fully_extracted' end,
  case when not has or f = 8 then 'counts_agree' end, case when not has or f = 9 then 'characters_agree' end, case when not has or f = 10 then 'digest_agrees' end,
  case when f = 11 and n > 0 then 'units_agree' end, case when plain <> array_to_string(u, chr(10) || chr(10)) then 'content_is_rebuilt' end, case when f = 12 and n > 0 then 'citations_agree' end,
  case when f = 17 and n > 1 then 'locators_unique' end, case when f = 15 and n > 0 then 'unit_ids_filled' end, case when f = 16 and n > 1 then 'unit_ids_unique' end,
  case when not has or f = 14 or f = 19 and n = 0 then 'pages_complete' end, case when f = 11 and n > 0 then 'units_sound' end] as found from x)
select i as source_id, array_to_string(list_filter(found, lambda x: x is not null), ',') as refused from r""")
def whole_parses(spark, d):
    """The rules of parse evidence that each document breaks."""
    return parsing.parse_evidence(**parsed_documents(spark, d)).select("source_id", F.array_join("refused", ",").alias("refused"))


# -- replay of whole snapshots -------------------------------------------------------------------------------------

SNAPSHOT = "struct<finding_id:bigint,claim_type:string,statement:string,review_status:string,source_anchors:array<string>,revision_records:array<struct<by:string,at:string,why:string>>>"


def lines_per_order(spark, d, name: str):
    """(name, n): each order with the number of its lines. Dealt to as many tasks as the session shuffles to: the rows are small, so
    that coalesced tasks would take millions of them, and each is exploded to all its lines."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias(name)).repartition(tasks, name)
    return rows.groupBy(name).agg(F.count("*").alias("n"))


def review_of_orders(spark, d):
    """(baseline, audits, actions): each order as a finding with an audit per line: odd ones change the statement, even ones
    confirm it. What is wrong with the second or third follows from the order's key modulo 10."""
    f = F.col("finding_id") % 10
    n = lines_per_order(spark, d, "finding_id")
    k = F.col("seq")
    at = lambda i: F.when((f == 4) & (i == 3), "2026-01-01T00:00:00Z").otherwise(F.concat(F.lit("2026-01-"), (F.floor(i / 2) + 10).cast("string"), F.lit("T00:00:00Z")))
    said = lambda i: F.concat(F.lit("s"), F.when(i > 0, i - (i + 1) % 2).otherwise(0).cast("string"))
    status = lambda i: F.when(i == 0, "pending").when(i % 2 == 1, "modified").otherwise("confirmed")
    one = lambda i: F.struct(F.concat(F.lit("r"), i.cast("string")).alias("by"), at(i).alias("at"), F.concat(F.lit("w"), i.cast("string")).alias("why"))
    records = lambda i: F.when(i > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(i, F.lit(1).cast("long"))), one)).otherwise(F.array())

    def state(said_: Column, status_: Column, records_: Column) -> Column:
        held = F.struct(F.col("finding_id"), F.lit("fact"), said_, status_, F.array(F.lit("a")), records_)
        return held.cast(SNAPSHOT)

    log = n.select("finding_id", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("seq"))
    before = state(F.when((f == 5) & (k == 3), "q").otherwise(said(k - 1)), status(k - 1), records(k - 1))
    still = (f == 9) & (k == 2)
    a_said = F.when(still | (f == 7) & (k == 3), said(k - 1)).otherwise(said(k))
    a_status, a_records = F.when(still, status(k - 1)).otherwise(status(k)), F.when(still | (f == 6) & (k == 3), records(k - 1)).otherwise(records(k))
    audits = log.select(
        "finding_id", "seq", before.alias("before_snapshot"), state(a_said, a_status, a_records).alias("after_snapshot"),
        F.concat(F.lit("r"), k.cast("string")).alias("reviewer"), F.concat(F.lit("w"), k.cast("string")).alias("reason"), at(k).alias("reviewed_at"),
    )
    hashed = F.when((f == 1) & (k == 2), "x").otherwise(review.snapshot_hash(F.col("before_snapshot")))
    audits = audits.withColumns({"before_hash": hashed, "after_hash": review.snapshot_hash(F.col("after_snapshot"))})
    times = F.when((f == 2) & (k == 2), F.array()).when((f == 3) & (k == 2), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    actions = audits.where(k % 2 == 0).where(~still).withColumn("_i", F.explode(times)).select(
        F.concat_ws("-", "finding_id", "seq", "_i").alias("action_id"), F.lit("confirm").alias("action"), F.lit(None).cast("string").alias("purpose"),
        "finding_id", "before_hash", "after_hash", "before_snapshot", "after_snapshot", "reviewer", "reason", F.col("reviewed_at").alias("acted_at"),
    )
    zero = F.lit(0).cast("long")
    baseline = n.where(f != 8).select("finding_id", state(said(zero), status(zero), F.array().cast("array<struct<by:string,at:string,why:string>>")).alias("snapshot"))
    return baseline, audits, review.action_ids(actions)


@query("""with n as (select l_orderkey as i, l_orderkey % 10 as f, count(*) as n from lineitem group by all),
k as (select i, f, unnest(range(1, n + 1)) as k from n),
p as (select *, case when f = 4 and k = 3 then '2026-01-01T00:00:00Z' else '2026-01-' || (10 + k // 2) || 'T00:00:00Z' end as tm, f = 9 and k = 2 as still from k),
r as (select *, 'r' || k || '@' || tm as rec, list('r' || k || '@' || tm) over (partition by i order by k rows between unbounded preceding and current row) as revs from p),
s as (select *, 's' || case when k > 0 then k - (k + 1) % 2 else 0 end as said, 's' || case when k > 1 then k - 1 - k % 2 else 0 end as said0,
  case when k % 2 = 1 then 'modified' else 'confirmed' end as status, case when k = 1 then 'pending' when k % 2 = 0 then 'modified' else 'confirmed' end as status0, revs[1:k - 1] as revs0 from r),
a as (select *, case when f = 5 and k = 3 then 'q' else said0 end as b_said, status0 as b_status, revs0 as b_revs,
  case when still or f = 7 and k = 3 then said0 else said end as a_said, case when still then status0 else status end as a_status, case when still or f = 6 and k = 3 then revs0 else revs end as a_revs from s),
l as (select *, coalesce(lag(a_said) over w, case when f <> 8 then 's0' end) as p_said, coalesce(lag(a_status) over w, case when f <> 8 then 'pending' end) as p_status,
  coalesce(lag(a_revs) over w, case when f <> 8 then [] end) as p_revs, lag(tm) over w as p_tm, b_said = a_said and a_status in ('confirmed', 'deleted') as status_only,
  case when f = 2 and k = 2 then 0 when f = 3 and k = 2 then 2 else 1 end as decided from a window w as (partition by i order by k))
select i as finding_id, k as seq, array_to_string(list_filter([case when p_said is null then 'known_finding' end, case when f = 1 and k = 2 then 'hashes_recomputed' end,
  case when b_said = a_said and b_status = a_status and b_revs = a_revs then 'something_changed' end,
  case when not coalesce(p_said = b_said and p_status = b_status and p_revs = b_revs, false) then 'continues' end, case when tm < p_tm then 'time_not_fallen' end,
  case when not ((status_only or b_said <> a_said) and a_status = case when status_only then a_status else 'modified' end and a_revs = list_append(b_revs, rec)) then 'change_allowed' end,
  case when status_only and decided <> 1 then 'decided_once' end], lambda x: x is not null), ',') as refused from l""")
def replayed_snapshots(spark, d):
    """The rules that each audit of a review log breaks when the log is replayed from its snapshots."""
    _, audited, _ = review.replay_snapshots(*review_of_orders(spark, d))
    return audited.select("finding_id", "seq", F.array_join("refused", ",").alias("refused"))


# -- provenance --------------------------------------------------------------------------------------------------


@query("""with v as (select o_custkey as p, o_orderkey as i, o_orderkey % 50 as f, lag(o_orderkey % 50) over (partition by o_custkey order by o_orderkey) as before from orders),
n as (select l_orderkey as i, count(*) as n from lineitem group by 1),
x as (select i, null as path, unnest([case when f = 10 then 'directive changed' end, case when f = 11 then 'replacement changed' end, case when f = 12 then 'seal changed' end, case when before = 12 then 'parent is another' end]) as problem from v
  union all select i, case when i % 50 = 7 then 'line/1' when i % 50 = 8 then 'line/2' else 'line/99' end, case when i % 50 = 7 then 'artifact changed' when i % 50 = 8 then 'artifact missing' else 'artifact added' end
  from n where i % 50 in (7, 9) or i % 50 = 8 and n > 1),
w as (select * from x where problem is not null),
c as (select v.p, v.i, (v.i in (select i from w))::int as broken from v),
s as (select i, sum(broken) over (partition by p order by i) - broken as earlier from c)
select p as project_id, i as version_id, path, problem from (select * from w union all select i, null, 'derived from a broken version' from s where earlier > 0) join (select p, i from v) using (i)""")
def changed_versions(spark, d):
    """Orders as versions of their customers and lines as artifacts, sealed, then changed: what verification names."""
    i = F.col("version_id")
    versions = table(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("number"), F.col("o_orderkey").alias("version_id"), F.col("o_orderpriority").alias("directive"), F.col("o_orderstatus").alias("replacement")
    )
    # counts are shuffled, not lines: what is exploded lies together by version
    n = dealt(checkpointed(lines_per_order(spark, d, "version_id")), "version_id")
    one_to_n = F.sequence(F.lit(1).cast("long"), "n")
    path, digest = F.concat(F.lit("line/"), "k"), F.md5(F.concat_ws("-", "version_id", "k"))
    manifest = n.select("version_id", F.explode(one_to_n).alias("k")).select("version_id", path.alias("path"), digest.alias("digest"))
    sealed = provenance.sealed(versions, manifest)
    now = sealed.withColumns(
        {
            "directive": F.when(i % 50 == 10, "else").otherwise(F.col("directive")),
            "replacement": F.when(i % 50 == 11, "else").otherwise(F.col("replacement")),
            "seal": F.when(i % 50 == 12, "else").otherwise(F.col("seal")),
        }
    )
    k, added = F.col("k"), F.array(F.lit(0).cast("long"))
    there = n.select("version_id", F.explode(F.when(i % 50 == 9, F.concat(added, one_to_n)).otherwise(one_to_n)).alias("k")).where(~((i % 50 == 8) & (k == 2)))
    there = there.select("version_id", F.when(k == 0, "line/99").otherwise(path).alias("path"), F.when(k == 0, "new").when((i % 50 == 7) & (k == 1), "else").otherwise(digest).alias("digest"))
    return provenance.verified(now, manifest, there)


# -- claims --------------------------------------------------------------------------------------------------------


@query()
def protected_tokens(spark, d):
    """Dates, numbers and obligation words of every document, by the table function in a lateral join."""
    T.register_protected_tokens(spark)
    texts = table(spark, d, "documents").select("doc_id", T.nfkc("text").alias("text"))
    return spark.sql("select doc_id, t.kind, t.start, t.end, t.token from {texts}, lateral protected_tokens(text) t where t.kind <> 'claim'", texts=texts)


@query("""select event_id, sha256('{"a":' || replace(props, ' ', '') || ',"b":{"x":[100,{"p":"é","q":null}],"y":-0.5}}') as digest from events""")
def canonical_digests(spark, d):
    """Each event's properties within JSON whose keys, numbers, escapes and white space are written in three ways."""
    k, props = F.col("event_id") % 3, F.col("props")
    first = F.concat(F.lit('{"b":{"y":-0.5,"x":[1e2,{"q":null,"p":"é"}]},"a":'), props, F.lit("}"))
    second = F.concat(F.lit('{ "a" : '), props, F.lit(',\n "b": {"x": [100.0, {"p": "\\u00e9", "q": null}], "y": -5E-1}}'))
    third = F.concat(F.lit('{"a":0,"a":'), props, F.lit(',"b":{"x":[100,{"q":null,"p":"é"}],"y":-0.500}}'))
    return table(spark, d, "events").select("event_id", T.json_digest(F.when(k == 0, first).when(k == 1, second).otherwise(third)).alias("digest"))


# -- exchange --------------------------------------------------------------------------------------------------------

_FINDING = StructType().add("finding_id", "long").add("statement", "string")
PROJECT = StructType().add("project_id", "long").add("project_name", "string").add("step", "string").add("findings", ArrayType(_FINDING))


@query("""with c as (select c_custkey as i, c_name as name, c_custkey % 12 as f, exists (select 1 from orders where o_custkey = c_custkey) as has from customer)
select i as ord, case when f = 0 then 'not JSON' when f = 1 then 'not an object' when f = 2 then 'another version' when f = 3 then 'another envelope' when f in (4, 6, 7) or f = 5 and has then 'another payload' when f = 8 then 'known id' end as why,
  case when f > 8 or f = 5 and not has then case when f = 9 then null else name end end as project_name from c""")
def strict_imports(spark, d):
    """Customers with their orders exported as projects, spoiled by their key modulo 12, and read back."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.struct(F.col("o_orderkey").alias("finding_id"), F.col("o_orderpriority").alias("statement"), F.col("o_orderstatus").alias("secret")).alias("x"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.when(F.col("c_custkey") % 12 != 9, F.col("c_name")).alias("project_name"), F.lit("sources").alias("step"))
    rows = c.join(o.groupBy("project_id").agg(F.collect_list("x").alias("findings")), "project_id", "left")
    rows = rows.withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<finding_id:bigint,statement:string,secret:string>>")))
    # a line knows its project by its place alone, as a file would
    lines = exchange.envelopes(rows, PROJECT, "project").select(F.get_json_object("value", "$.project.project_id").cast("long").alias("ord"), "value")
    f, value = F.col("ord") % 12, F.col("value")
    instead = {
        0: F.concat(value, F.lit("}")),
        1: F.concat(F.lit("["), value, F.lit("]")),
        2: F.replace(value, F.lit('"version":1'), F.lit('"version":2')),
        3: F.replace(value, F.lit('"version":1'), F.lit('"version":1,"by":"me"')),
        4: F.replace(value, F.lit('"step":'), F.lit('"token":"t","step":')),
        5: F.replace(value, F.lit('"statement":'), F.lit('"secret":"s","statement":')),
        6: F.replace(value, F.lit('"step":"sources",'), F.lit("")),
        7: F.replace(value, F.lit('"step":"sources"'), F.lit('"step":["sources"]')),
    }
    for k, v in instead.items():
        value = F.when(f == k, v).otherwise(value)
    good, bad = exchange.admit(lines.withColumn("value", value), PROJECT, c.where("project_id % 12 = 8"), "project_id", "project")
    return good.select("ord", F.lit(None).cast("string").alias("why"), "project_name").unionByName(bad.select("ord", "why", F.lit(None).cast("string").alias("project_name")))


@query("""with l as (select user_id, max(event_id) as r, arg_max(ts, event_id) as ts from events group by user_id)
select user_id as project_id, case when r % 5 in (0, 4) then 'name ' || r else user_id::varchar end as project_name, case when r % 5 = 0 then 'review' else 'unknown' end as step, r as revision, ts as updated_at,
  case when r % 5 = 0 then 3 else 0 end::bigint as n_findings from l where r % 5 not in (2, 3)""")
def listed_sessions(spark, d):
    """The latest session of every user; of some the payload is broken or holds little."""
    r = F.col("event_id")
    named = F.concat(F.lit('{"project":{"projectName":"name '), r.cast("string"), F.lit('",'))
    payload = (
        F.when(r % 5 == 0, F.concat(named, F.lit('"workflowStep":"review","findings":[1,{},"x"]}}')))
        .when(r % 5 == 1, '{"project":{"projectName":7}}')
        .when(r % 5 == 2, "null")
        .when(r % 5 == 3, '{"project":')
        .otherwise(F.concat(named, F.lit('"findings":null}}')))
    )
    x = table(spark, d, "events").select(F.col("user_id").alias("project_id"), r.alias("revision"), F.col("ts").alias("updated_at"), payload.alias("payload"))
    found = exchange.listed(x)
    return found.withColumn("n_findings", F.col("n_findings").cast("long"))

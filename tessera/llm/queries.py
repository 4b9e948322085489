"""The registered queries of this subpackage, and SQL for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bin_completion,
    classifier,
    decontamination,
    fill_middle,
    packing,
    pii,
    quality_rules,
    simhash,
    suffix_dedup,
    token_binary,
    url_filters,
    vector_codes,
    warc,
)
from .common import scratch, table

#: The rules of the URL query.
URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "lost_chars",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=1024)


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    files, by_rank = token_binary.write_files(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_binary.read_files(files, path, by_rank, digests=True)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classifier.with_scores(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    files = warc.write_derivatives(table(spark, sf_dir, "pages"), path)
    return warc.read_records(files, path).select(
        warc.field("X-Page-Id").cast("long").alias("page_id"),
        "record_type",
        "record_id",
        "refers_to",
        "target_uri",
        warc.field("Content-Type").alias("content_type"),
        F.length("block").cast("long").alias("content_length"),
        warc.field("WARC-Block-Digest").alias("block_digest"),
        warc.field("WARC-Source-Payload-Digest").alias("payload_digest"),
        warc.field("WARC-Source-Content-Type").alias("source_content_type"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(), 256).alias("restored_sha256"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    digest = F.lit(vector_codes.digest(codebooks)).alias("codebooks_sha256")
    return coded.select("vec_id", "code", "error", "label_error", digest)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_packing": op2_packing,
    "op3_token_binary": op3_token_binary,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_url_filters": op5_url_filters,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_suffix_array": op9_suffix_array,
    "op10_warc": op10_warc,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_vector_codes": op13_vector_codes,
}

_W = r"[^\x20\x09-\x0D]+"

#: One round of the codebooks of op13: entries of the parts assigned by ``entries``; and those that no part chose.
_ROUND = """
n{k} as (
  select k, p, arg_min(e, (d, e)) as e from (
    select parts.k, p, e, sum((x - y) * (x - y)) as d from parts join {entries} using (p, c) group by all) group by all),
m{k} as (
  select p, e, c, sum(x) as s, count(*) as n from n{k} join parts using (k, p) group by all),
b{k} as (
  select p, e, c, coalesce((s - ((s % n) + n) % n) // n, y)::bigint as y from {entries} left join m{k} using (p, e, c)),"""

ORACLE_SQL = {
    "op1_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{_W}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (
  select *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as t from d),
r as (
  select *, row_number() over () as k from g),
p as (
  select k, unnest(t) as x, unnest(range(1, len(t) + 1)) as i from r),
q as (
  select k, i from (select k, i, count(*) over (partition by k, x) as c from p) where c > 1),
c as (
  select k, count(*) as n from (select distinct k, unnest([i, i + 1, i + 2]) as j from q) group by k),
m as (
  select doc_id, text, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         array_to_string(list_filter(string_split(text, chr(10)), lambda x:
           length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) <= 0.08 * greatest(length(x), 1)
           and length(x) - length(regexp_replace(x, '[!?]{{2,}}', '', 'g')) <= 0.03 * greatest(length(x), 1)
           and length(x) - length(regexp_replace(x, '\p{{Lu}}', '', 'g')) <= 0.5 * greatest(length(x), 1)
           and length(x) - length(regexp_replace(x, '[|\x{{bb}}\x{{203a}}]', '', 'g')) < 2
           and not regexp_matches(lower(x), '{"|".join(quality_rules.BOILERPLATE)}')), chr(10)) as clean
  from r left join c using (k))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)
         and length(text) - length(clean) <= 0.3 * length(text) as kept,
       (length(text) - length(clean))::bigint as lost_chars
from m""",
    "op5_url_filters": r"""
with u as (
  select page_id, coalesce(url, '') as url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
rules(verdict, host, path) as (values
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
f as (
  select u.*, r.host || r.path as rule, r.verdict as rv,
         row_number() over (partition by u.k order by length(r.host || r.path) desc, length(r.host) desc) as n
  from (select *, row_number() over () as k from u) u left join rules r
    on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path))
select page_id, host, path, rule, coalesce(rv, 'allow') as verdict from f where n = 1""",
    "op7_decontamination": r"""
with d as (
  select doc_id, row_number() over () as k, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
i as (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as p from b where len(w) > 0),
iw as (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') as g from i),
s as (select distinct n from iw),
dp as (select k, w, n, unnest(range(1, len(w) - n + 2)) as p from d, s),
h as (select dp.k, dp.p, iw.n, iw.item_id from dp join iw on iw.n = dp.n and iw.g = array_to_string(dp.w[dp.p:dp.p + dp.n - 1], ' ')),
hw as (select k, count(distinct j) as n_hit from (select k, unnest(range(p, p + n)) as j from h) group by k),
hi as (select k, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct k, item_id::varchar as id from h) group by k)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hw using (k) left join hi using (k)""",
    "op9_suffix_array": r"""
with d as (select doc_id, row_number() over () as k, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, k, i, md5(substr(h, 2 * i + 1, 100)) as x from (
  select doc_id, k, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as i from d where doc_id is not null)),
f as (select x, min(doc_id) as first_doc from p group by x having min(doc_id) < max(doc_id)),
g as (select k, i from p join f using (x) where first_doc < doc_id),
r as (select k, i, case when i - lag(i) over (partition by k order by i) <= 50 then 0 else 1 end as new from g),
n as (select k, i, sum(new) over (partition by k order by i) as run from r),
s as (select k, run, min(i) as a, max(i) + 50 as b from n group by k, run),
e as (select k, a, b, lag(b, 1, 0) over (partition by k order by a) as kept_from from s),
t as (select k, sum(b - a) as n_removed, count(*) as n_spans, max(b) as last,
             string_agg(substr(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) as kept from e join d using (k) group by k)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
       sha256(from_hex(coalesce(kept || substr(h, 2 * last + 1), h))) as kept_sha256
from d left join t using (k)""",
    "op11_fill_in_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t,
         sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
g as (
  select *, len(t) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
         ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90
              then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
p as (
  select *, array_to_string(t[1:a], '') as prefix, array_to_string(t[a + 1:b], '') as middle,
         array_to_string(t[b + 1:], '') as suffix from c)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(prefix) end::bigint as prefix_chars,
       case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p""",
    "op13_vector_codes": rf"""
with kept as materialized (
  select vec_id, label, row_number() over (order by vec_id, embedding) - 1 as k,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select k, (i // (len(v) // 16))::int as p, (i % (len(v) // 16))::int as c, v[i + 1] as x
  from (select k, v, unnest(range(len(v))) as i from kept)),
b0 as materialized (select p, k as e, c, x as y from parts where k < 64),
{_ROUND.format(k=1, entries="b0")}
{_ROUND.format(k=2, entries="b1")}
{_ROUND.format(k=3, entries="b2")}
a as (
  select n3.k, n3.p, n3.e, sum((x - y) * (x - y)) as d from n3 join parts using (k, p) join b2 using (p, e, c) group by all),
r as (
  select k, string_agg(lower(printf('%02x', e)), '' order by p) as code, sum(d)::bigint as error from a group by k),
w as (select sha256(string_agg(y::varchar, ',' order by p, e, c)) as s from b2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, s as codebooks_sha256
from kept join r using (k), w""",
}

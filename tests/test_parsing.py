"""Each rule of parse evidence broken alone, over sources that are otherwise whole."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import parsing

SOURCES = "project_id string, source_id string, source_type string, content string"
UNITS = "ord int, source_id string, source_type string, page int, article string, paragraph_index int, unit_id string, text string, extraction_method string, confidence double"


def tables(spark, copies=("",)):
    """Of each copy source a without pages, b with two pages, c with one; 😀 is two UTF-16 units."""
    texts = {"a": ["第一条 应当 😀", "second  part", "third"], "b": ["page one", "page two"], "c": ["only"]}
    kinds = {"a": "regulatory_text", "b": "official_interpretation", "c": "regulatory_text"}
    content = {i: "\r\n\r\n".join(t) + "\n" for i, t in texts.items()}
    sources = spark.createDataFrame([("p", f"{n}{i}", kinds[i], content[i]) for n in copies for i in texts], SOURCES)
    rows = [(k, f"{n}{i}", kinds[i], None if i == "a" else k + 1, "第一条" if i == "a" and k == 0 else None, k, f"{i}{k}", t, "text", 0.9) for n in copies for i, ts in texts.items() for k, t in enumerate(ts)]
    units = spark.createDataFrame(rows, UNITS).repartition(3)
    parsed = units.withColumn("owner_id", F.col("source_id"))
    return dict(sources=sources, outcomes=outcomes_of(sources, parsed), parsed=parsed, units=units, citations=parsing.expected_citations(parsed))


def outcomes_of(sources, parsed):
    n, paged = F.col("n"), ~F.col("source_id").endswith("a")
    x = sources.join(parsed.groupBy("source_id").agg(F.count("*").alias("n")), "source_id").join(parsing.unit_digests(parsed).withColumnRenamed("owner_id", "source_id"), "source_id")
    return x.select(
        "project_id", "source_id", "source_type",
        parsing.row_hash(*sources.columns).alias("source_hash"),
        F.sha2("content", 256).alias("file_hash"),
        F.when(paged, n).cast("int").alias("page_count"),
        F.when(paged, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array().cast("array<int>")).alias("successful_pages"),
        F.array().cast("array<int>").alias("failed_pages"),
        F.lit(0).alias("failed_page_count"),
        F.array().cast("array<int>").alias("ocr_failed_pages"),
        n.alias("parsed_unit_count"),
        parsing.utf16_length("content").alias("total_characters"),
        F.col("digest").alias("ordered_unit_digest"),
        F.lit(1.0).alias("extraction_coverage"),
        F.lit(False).alias("finalization_blocked"),
    )


def refused(t):
    return {r.source_id: r.refused for r in parsing.parse_evidence(**t).collect()}


@pytest.fixture(scope="module")
def whole(spark):
    return {k: v.cache() for k, v in tables(spark).items()}



def test_whole_sources(whole):
    assert refused(whole) == {"a": [], "b": [], "c": []}
    cited = {(r.owner_id, r.ord): r.article for r in whole["citations"].collect()}
    assert cited["a", 2] == "第一条" and cited["b", 0] is None


#: Fixed order: table, column, what it becomes, where, and the rules that source a (or b) then breaks.
CASES = [
    ("outcomes", "file_hash", "'xyz'", "source_id = 'a'", {"a": ["hash_is_sha256"]}),
    ("outcomes", "source_hash", "'other'", "source_id = 'a'", {"a": ["source_as_parsed"]}),
    ("outcomes", "source_type", "'official_interpretation'", "source_id = 'a'", {"a": ["type_agrees"]}),
    ("outcomes", "finalization_blocked", "true", "source_id = 'a'", {"a": ["not_blocked"]}),
    ("outcomes", "failed_pages", "array(1)", "source_id = 'a'", {"a": ["no_failed_pages"]}),
    ("outcomes", "failed_page_count", "1", "source_id = 'a'", {"a": ["no_failed_pages"]}),
    ("outcomes", "ocr_failed_pages", "array(1)", "source_id = 'a'", {"a": ["no_ocr_failures"]}),
    ("outcomes", "extraction_coverage", "0.9d", "source_id = 'a'", {"a": ["fully_extracted"]}),
    ("outcomes", "parsed_unit_count", "2", "source_id = 'a'", {"a": ["counts_agree"]}),
    ("outcomes", "total_characters", "total_characters - 1", "source_id = 'a'", {"a": ["characters_agree"]}),
    ("outcomes", "ordered_unit_digest", "'x'", "source_id = 'a'", {"a": ["digest_agrees"]}),
    ("outcomes", "page_count", "3", "source_id = 'b'", {"b": ["pages_complete"]}),
    ("outcomes", "page_count", "0", "source_id = 'b'", {"b": ["pages_complete"]}),
    ("outcomes", "page_count", "cast(null as int)", "source_id = 'b'", {"b": ["pages_complete"]}),
    ("outcomes", "successful_pages", "array(1, 1)", "source_id = 'b'", {"b": ["pages_complete"]}),
    ("outcomes", "successful_pages", "array(1)", "source_id = 'a'", {"a": ["pages_complete"]}),
    ("units", "confidence", "0d", "source_id = 'a' and ord = 1", {"a": ["units_agree", "units_sound"]}),
    ("units", "page", "7", "source_id = 'b' and ord = 1", {"b": ["units_agree", "pages_complete"]}),
    ("units", "text", "' '", "source_id = 'c'", {"c": ["has_text_unit", "units_agree", "units_sound"]}),
    ("units", "source_type", "'x'", "source_id = 'a' and ord = 1", {"a": ["counts_agree", "units_agree"]}),
    ("citations", "quote", "'other'", "owner_id = 'a' and ord = 1", {"a": ["citations_agree"]}),
    ("citations", "article", "cast(null as string)", "owner_id = 'a' and ord = 1", {"a": ["citations_agree"]}),
]


def named(when, k):
    """The condition for one copy."""
    return re.sub(r"(source_id|owner_id) = '(.)'", rf"\1 = '{k}:\2'", when)


def of_copies(found, n):
    out = [{} for _ in range(n)]
    for source, rules in found.items():
        k, i = source.split(":")
        out[int(k)][i] = rules
    return out


def test_every_fault(spark):
    t = tables(spark, [f"{k}:" for k in range(len(CASES))])
    for k, (table, column, value, when, _) in enumerate(CASES):
        t[table] = t[table].withColumn(column, F.when(F.expr(named(when, k)), F.expr(value)).otherwise(F.col(column)))
    for (*case, want), got in zip(CASES, of_copies(refused(t), len(CASES)), strict=True):
        assert got == {"a": [], "b": [], "c": []} | want, case


#: Fixed order: a fault in the session's units and in the outcomes' alike, with digests and citations made anew.
BOTH = [
    ("unit_id", "' '", "source_id = 'a' and ord = 1", {"a": ["unit_ids_filled"]}),
    ("unit_id", "'a0'", "source_id = 'a' and ord = 1", {"a": ["unit_ids_unique"]}),
    ("unit_id", "cast(null as string)", "source_id = 'a'", {}),
    ("paragraph_index", "1", "source_id = 'a'", {"a": ["locators_unique"]}),
    ("text", "'not there'", "source_id = 'a' and ord = 1", {"a": ["content_is_rebuilt", "units_within_content"]}),
    ("text", "'second part'", "source_id = 'a' and ord = 1", {"a": ["content_is_rebuilt"]}),
]


def test_every_fault_of_both(spark):
    t = tables(spark, [f"{k}:" for k in range(len(BOTH))])
    parsed = t["parsed"]
    for k, (column, value, when, _) in enumerate(BOTH):
        parsed = parsed.withColumn(column, F.when(F.expr(named(when, k)), F.expr(value)).otherwise(F.col(column)))
    t |= dict(parsed=parsed, units=parsed.drop("owner_id"), outcomes=outcomes_of(t["sources"], parsed), citations=parsing.expected_citations(parsed))
    for (*case, want), got in zip(BOTH, of_copies(refused(t), len(BOTH)), strict=True):
        assert got == {"a": [], "b": [], "c": []} | want, case


def test_outcomes_and_projects(spark, whole):
    o = whole["outcomes"]
    twice = refused(whole | dict(outcomes=o.unionByName(o.where("source_id = 'a'"))))
    assert twice["a"] == ["one_outcome"]
    gone = refused(whole | dict(outcomes=o.where("source_id <> 'c'")))
    assert {"one_outcome", "hash_is_sha256", "pages_complete", "counts_agree"} <= set(gone["c"]) and gone["a"] == []
    rows = parsing.parse_evidence(**whole)
    units = whole["units"].withColumn("project_id", F.lit("p"))
    judge = lambda s=whole["sources"], o=o, u=units, r=rows: {x.project_id: x.refused for x in parsing.project_evidence(s, o, u, r).collect()}
    assert judge() == {"p": []}
    assert judge(s=whole["sources"].where("source_id = 'b'")) == {"p": ["has_regulatory_source", "outcomes_known", "units_known"]}
    assert judge(u=units.limit(0)) == {"p": ["has_units"]}
    assert judge(u=units.withColumn("source_type", F.lit("x"))) == {"p": ["units_known"]}
    bad = rows.withColumn("refused", F.when(F.col("source_id") == "a", F.array(F.lit("x"))).otherwise(F.col("refused")))
    assert judge(r=bad) == {"p": ["sources_complete"]}
    assert judge(s=whole["sources"].limit(0))["p"][:2] == ["has_sources", "has_regulatory_source"]
    empty = {k: v.limit(0) for k, v in whole.items()}
    assert refused(empty) == {}


OCR = "owner_id string, unit_id string, source_id string, source_type string, page int, text string, confidence double, original_ocr_text string, bounding_box array<double>, ocr_regions array<string>, low_confidence_characters array<string>, corrected_text string, review_status string, reviewed_at string, reviewed_by string, correction_history array<struct<corrected_text:string,reviewed_by:string,reviewed_at:string>>"
NOW = "2026-01-01T00:00:00.000Z"


def recognized(spark, copies=1):
    rows, outcomes = [], []
    for k in range(copies):
        rows.append((f"{k}", "u1", "s", "t", 2, "seen", 0.6, "seen", [0.0, 1.0], ["r"], ["e"], None, "unreviewed", None, None, []))
        rows.append((f"{k}", "u2", "s", "t", 3, "put right", 0.5, "put rihgt", None, [], [], "put right", "corrected", NOW, "me", [("first try", "you", NOW), ("put right", "me", NOW)]))
        outcomes.append((f"{k}", "t", 3, [2, 3]))
    parsed = spark.createDataFrame(rows, OCR).withColumns({"source_id": F.col("owner_id"), "extraction_method": F.lit("ocr")})
    reviews = parsed.drop("extraction_method").withColumns({"method": F.lit("ocr"), "error": F.lit(None).cast("string")})
    return [spark.createDataFrame(outcomes, "source_id string, source_type string, page_count int, low_text_pages array<int>"), parsed, reviews]


#: Fixed order: tables (outcomes, units, reviews), column, what it becomes, where, and the rules that are broken.
OCR_CASES = [
    ([0], "low_text_pages", "array(2, 3, 3)", "true", ["low_pages_unique"]),
    ([0], "low_text_pages", "array(2, 3, 4)", "true", ["low_pages_in_range", "low_pages_reviewed"]),
    ([0], "page_count", "cast(null as int)", "true", ["low_pages_in_range"]),
    ([1], "extraction_method", "'text'", "page = 2", ["a_review_per_unit", "one_unit", "fields_agree", "review_proper"]),
    ([2], "page", "2", "true", ["review_pages_unique", "low_pages_reviewed", "one_unit", "fields_agree", "review_proper"]),
    ([2], "method", "'text'", "page = 2", ["recognized"]),
    ([2], "error", "'failed'", "page = 2", ["recognized"]),
    ([1, 2], "source_type", "'x'", "page = 2", ["of_source"]),
    ([1], "bounding_box", "array(0d, 2d)", "page = 2", ["fields_agree"]),
    ([2], "ocr_regions", "array('q')", "page = 2", ["fields_agree"]),
    ([2], "low_confidence_characters", "array('q')", "page = 2", ["fields_agree"]),
    ([2], "confidence", "0.1d", "page = 2", ["fields_agree"]),
    ([2], "review_status", "'other'", "page = 2", ["review_proper"]),
    ([2], "reviewed_by", "'me'", "page = 2", ["review_proper"]),
    ([1], "reviewed_by", "'else'", "page = 3", ["review_proper"]),
    ([1, 2], "reviewed_at", "'2026-01-01'", "page = 3", ["review_proper"]),
    ([1, 2], "reviewed_at", "'2026-01-01T00:00:00.12Z'", "page = 3", ["review_proper"]),
    ([1, 2], "corrected_text", "' '", "page = 3", ["review_proper"]),
    ([1, 2], "correction_history", "slice(correction_history, 1, 1)", "page = 3", ["review_proper"]),
    ([1, 2], "text", "'put'", "page = 3", ["review_proper"]),
    ([1, 2], "correction_history", "slice(correction_history, 1, 0)", "page = 3", ["review_proper"]),
]


def test_every_ocr_fault(spark):
    tables = recognized(spark, len(OCR_CASES) + 1)
    for k, (which, column, value, when, _) in enumerate(OCR_CASES):
        for i in which:
            mine = (F.col("source_id" if i == 0 else "owner_id") == f"{k}") & F.expr(when)
            tables[i] = tables[i].withColumn(column, F.when(mine, F.expr(value)).otherwise(F.col(column)))
    got = {r.source_id: r.refused for r in parsing.ocr_evidence(*tables).collect()}
    for k, (*case, want) in enumerate([*OCR_CASES, ([],)]):
        assert got[f"{k}"] == want, case


def test_outcomes_without_recognized_pages(spark):
    o, p, r = recognized(spark)
    o = o.withColumn("low_text_pages", F.array().cast("array<int>"))
    assert [x.refused for x in parsing.ocr_evidence(o, p.limit(0), r.limit(0)).collect()] == [[]]


def test_lengths_are_utf16(spark):
    df = spark.createDataFrame([("a😀é",)], "content string")
    assert df.select(parsing.utf16_length("content")).first()[0] == 4
    assert hashlib.sha256(b'{"content":"x"}').hexdigest() == spark.createDataFrame([("x",)], "content string").select(parsing.row_hash("content")).first()[0]

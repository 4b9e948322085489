"""Evidence that sources were parsed whole: outcomes against sources, units and citations, pages, and recognized text.

Every function names the rules that a source breaks. Nothing of a source is gathered in a row but its own text, which is
a row already, and its units' text, which meets it there: else units travel as digests, and those in order are folded, at most
``provenance.FAN`` in a row.
Lengths count UTF-16 units, as whoever wrote the outcomes counted them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import locate, provenance, scan

#: The fields of a unit and of a citation, the rules of a source, of a project, and of recognized pages.
UNIT = ("source_id", "source_type", "page", "article", "paragraph_index", "unit_id", "text", "extraction_method", "confidence")
ANCHOR = ("source_id", "source_type", "page", "article", "paragraph_index", "quote")
SOURCE_RULES = (
    "content_not_blank",
    "has_text_unit",
    "one_outcome",
    "hash_is_sha256",
    "source_as_parsed",
    "type_agrees",
    "not_blocked",
    "no_failed_pages",
    "no_ocr_failures",
    "fully_extracted",
    "counts_agree",
    "characters_agree",
    "digest_agrees",
    "units_agree",
    "content_is_rebuilt",
    "citations_agree",
    "locators_unique",
    "unit_ids_filled",
    "unit_ids_unique",
    "units_are_of_source",
    "units_within_content",
    "ocr_complete",
    "pages_complete",
    "units_sound",
)
PROJECT_RULES = ("has_sources", "has_regulatory_source", "has_units", "outcomes_known", "units_known", "sources_complete")


def row_hash(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def utf16_length(c: str) -> Column:
    return (F.octet_length(F.encode(F.col(c), "UTF-16BE")) / 2).cast("long")


def unit_digests(parsed: DataFrame) -> DataFrame:
    """(owner_id, digest) of each outcome's units in order; ``parsed`` has owner_id, ord and the fields of ``UNIT``."""
    held = parsed.select(F.col("owner_id").alias("version_id"), F.lpad(F.col("ord").cast("string"), 19, "0").alias("path"), row_hash(*UNIT).alias("digest"))
    return provenance.roots(held).select(F.col("version_id").alias("owner_id"), F.col("root").alias("digest"))


def expected_citations(parsed: DataFrame) -> DataFrame:
    """(owner_id, ord and the fields of ``ANCHOR``) of the units that are not blank; an article holds until the next."""
    filled = locate.fill_articles(parsed, F.nullif(T.trim_ws(F.col("article")), F.lit("")), "owner_id", "ord")
    return filled.where(T.trim_ws(F.col("text")) != "").select("owner_id", "ord", *ANCHOR[:-1], F.col("text").alias("quote"))


def digest_of(c: str) -> Column:
    return F.unhex(F.sha2(F.col(c), 256))


def folded(rows: DataFrame, name: str, counted: DataFrame | None = None) -> DataFrame:
    """(owner_id, name): a digest of the digests h of all rows (owner_id, ord, h) in order, by way of digests of ``provenance.FAN``
    rows each. Rows are shuffled once, by their owner."""
    placed = scan.scanned(rows, "owner_id", ["ord", "h"], scan.Wanted(number="_nth"), counted=counted)
    part = F.floor((F.col("_nth") - 1) / provenance.FAN)
    of = lambda at: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "h"))), lambda x: F.hex(x["h"])), ""), 256)
    parts = placed.groupBy("owner_id", part.alias("_part")).agg(F.unhex(of("_nth")).alias("h"))
    return parts.groupBy("owner_id").agg(of("_part").alias(name))


def same_rows(left: DataFrame, right: DataFrame, name: str, counted: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """(owner_id, name): whether the rows (owner_id, ord, h) of both have equal h, one by one in order."""
    a, b = (folded(x, c, n) for x, c, n in zip((left, right), ("_a", "_b"), counted, strict=True))
    return a.join(b, "owner_id", "full_outer").select("owner_id", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias(name))


def _bodies(parsed: DataFrame) -> DataFrame:
    """(owner_id, p_units): an outcome's units in order, with their texts trimmed."""
    unit = F.struct("ord", T.trim_ws(F.col("text")).alias("t"), "source_type", "page", "unit_id", (F.col("source_id") == F.col("owner_id")).alias("own"))
    return parsed.groupBy("owner_id").agg(F.array_sort(F.collect_list(unit)).alias("p_units"))


def _plain(c: Column) -> Column:
    return T.trim_ws(F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c))


def _with_bodies(sources: DataFrame, parsed: DataFrame) -> DataFrame:
    """A row per source with what its content and the units of its outcome say together, without these: contents and texts
    meet here alone, each shuffled once. An id that several sources bear has the units once for each."""
    same_id = Window.partitionBy("source_id")
    s = sources.select("source_id", "source_type", "content", row_hash(*sources.columns).alias("_source_hash"))
    s = s.withColumns({"_k": F.count("*").over(same_id), "_types": F.collect_set("source_type").over(same_id)})
    k, units = F.col("_k"), F.col("p_units")
    every = F.transform(units, lambda u: u["t"])
    # asked after the join, as rows that come from Python no longer count as dealt
    x = s.join(_bodies(parsed).withColumnRenamed("owner_id", "source_id"), "source_id", "left").withColumn("_within", T.texts_within("content", every))
    texts = F.filter(every, lambda t: t != "")
    texts = F.when(k == 1, texts).otherwise(F.flatten(F.transform(texts, lambda t: F.array_repeat(t, F.col("_k").cast("int")))))
    ids = F.filter(F.transform(units, lambda u: u["unit_id"]), lambda i: i.isNotNull())
    inside = F.filter(units, lambda u, i: u["own"] & (u["source_type"] == F.col("source_type")) & F.get("_within", i))
    yes = lambda c: F.coalesce(c, F.lit(True))
    typed = F.forall("_types", lambda t: F.forall("p_units", lambda u: yes(u["source_type"] == t)))
    found = {
        "p_n": F.size(units) * k,
        "p_pages": F.array_sort(F.array_distinct(F.filter(F.transform(units, lambda u: u["page"]), lambda p: p.isNotNull()))),
        "p_ids_filled": F.forall(ids, lambda i: T.trim_ws(i) != ""),
        "p_ids_unique": F.size(F.array_distinct(ids)) == F.size(ids) * k,
        "p_own": F.forall(units, lambda u: yes(u["own"])) & typed,
        "p_inside": F.when(k == 1, F.size(inside)),
    }
    return x.select(
        "source_id",
        "source_type",
        "_source_hash",
        (T.trim_ws(F.col("content")) != "").alias("_filled"),
        utf16_length("content").alias("_length"),
        (_plain(F.when(units.isNotNull(), F.array_join(texts, "\n\n")).otherwise("")) == _plain(F.col("content"))).alias("_rebuilt"),
        *(F.when(units.isNotNull(), c).alias(name) for name, c in found.items()),
    )


def broken(checks: dict[str, Column]) -> Column:
    """The names of checks that do not hold, in order; what is null does not hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))).alias("refused")


def parse_evidence(sources: DataFrame, outcomes: DataFrame, parsed: DataFrame, units: DataFrame, citations: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(source_id, refused): the ``SOURCE_RULES`` that each source breaks.

    ``sources`` has source_id, source_type, content and any other columns; ``outcomes`` source_id, source_type, source_hash
    (``row_hash`` of the source's columns when it was parsed), file_hash, page_count, successful_pages, failed_pages, failed_page_count,
    ocr_failed_pages, parsed_unit_count, total_characters, ordered_unit_digest, extraction_coverage and finalization_blocked;
    ``parsed`` the units of outcomes (owner_id, ord, UNIT) and ``units`` those of the session (ord, UNIT); ``citations``
    those of outcomes (owner_id, ord, ANCHOR). ``ocr`` is what ``ocr_evidence`` gives; a source without a row there is
    complete. A source without an outcome breaks all rules that need one. Of outcomes with one id any is taken, as the source is refused."""
    text = T.trim_ws(F.col("text"))
    # digests and flags are made where rows lie, so no text is shuffled but in ``_with_bodies``
    h = lambda fields: F.unhex(row_hash(*fields)).alias("h")
    held = units.select(
        "source_id",
        "source_type",
        "ord",
        "page",
        (text != "").alias("_text"),
        ((text != "") & F.coalesce((F.col("confidence") > 0) & (F.col("confidence") < float("inf")), F.lit(False))).alias("_sound"),
        h(UNIT),
    )
    session = held.join(sources.select("source_id", F.col("source_type").alias("_type")), "source_id").where("source_type = _type").withColumnRenamed("source_id", "owner_id")
    by_session = session.groupBy("owner_id").agg(
        F.count("*").alias("s_n"),
        F.bool_or("_text").alias("s_text"),
        F.bool_and(F.col("page").isNull()).alias("s_unpaged"),
        F.min("page").alias("s_low"),
        F.max("page").alias("s_high"),
        F.bool_and(F.col("page").isNotNull()).alias("s_paged"),
        F.bool_and("_sound").alias("s_sound"),
    )
    cited = parsed.select("owner_id", "ord", *ANCHOR[:-1], (text != "").alias("_text"), digest_of("text").alias("quote"))
    cited = locate.fill_articles(cited, F.nullif(T.trim_ws(F.col("article")), F.lit("")), "owner_id", "ord").where("_text")
    places = cited.groupBy("owner_id").agg((F.count_distinct(row_hash(*ANCHOR[:-1])) == F.count("*")).alias("c_unique"))
    recorded = citations.withColumn("quote", digest_of("quote"))
    u_same = same_rows(parsed.select("owner_id", "ord", h(UNIT)), session.select("owner_id", "ord", "h"), "u_same", (parsed, units.withColumn("owner_id", F.col("source_id"))))
    c_same = same_rows(*(c.select("owner_id", "ord", h(ANCHOR)) for c in (cited, recorded)), "c_same", (parsed, citations))
    o = outcomes.groupBy("source_id").agg(F.count("*").alias("o_n"), F.first(F.struct(*(c for c in outcomes.columns if c != "source_id"))).alias("o"))
    facts = [by_session, places, unit_digests(parsed), u_same, c_same]
    x = reduce(lambda a, b: a.join(b.withColumnRenamed("owner_id", "source_id"), "source_id", "left"), facts, _with_bodies(sources, parsed).join(o, "source_id", "left"))
    x = x.join(ocr.select("source_id", (F.size("refused") == 0).alias("ocr_ok")), "source_id", "left") if ocr is not None else x.withColumn("ocr_ok", F.lit(None).cast("boolean"))
    n = lambda c: F.coalesce(c, F.lit(0))
    own = F.coalesce("p_pages", F.array().cast("array<int>"))
    count, seen = F.col("o.page_count"), F.col("o.successful_pages")
    unpaged = (F.size(seen) == 0) & F.coalesce("s_unpaged", F.lit(True))
    wanted = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    paged = (count > 0) & (F.array_sort(seen) == wanted) & (F.size(F.array_except(wanted, own)) == 0) & F.coalesce(F.col("s_paged") & (F.col("s_low") >= 1) & (F.col("s_high") <= count), F.lit(True))
    checks = {
        "content_not_blank": F.col("_filled"),
        "has_text_unit": F.col("s_text"),
        "one_outcome": F.col("o_n") == 1,
        "hash_is_sha256": F.col("o.file_hash").rlike("(?i)^[0-9a-f]{64}$"),
        "source_as_parsed": F.col("o.source_hash") == F.col("_source_hash"),
        "type_agrees": F.col("o.source_type") == F.col("source_type"),
        "not_blocked": ~F.col("o.finalization_blocked"),
        "no_failed_pages": (F.size("o.failed_pages") == 0) & (F.col("o.failed_page_count") == F.size("o.failed_pages")),
        "no_ocr_failures": F.size("o.ocr_failed_pages") == 0,
        "fully_extracted": F.col("o.extraction_coverage") == 1,
        "counts_agree": (F.col("o.parsed_unit_count") == n("p_n")) & (F.col("o.parsed_unit_count") == n("s_n")),
        "characters_agree": F.col("o.total_characters") == F.col("_length"),
        "digest_agrees": F.col("o.ordered_unit_digest") == F.coalesce("digest", F.lit(provenance.NO_ROOT)),
        "units_agree": F.coalesce("u_same", F.lit(True)),
        "content_is_rebuilt": F.col("_rebuilt"),
        "citations_agree": F.coalesce("c_same", F.lit(True)),
        "locators_unique": F.coalesce("c_unique", F.lit(True)),
        "unit_ids_filled": F.coalesce("p_ids_filled", F.lit(True)),
        "unit_ids_unique": F.coalesce("p_ids_unique", F.lit(True)),
        "units_are_of_source": F.coalesce("p_own", F.lit(True)),
        "units_within_content": n("p_inside") == n("p_n"),
        "ocr_complete": F.coalesce("ocr_ok", F.lit(True)),
        "pages_complete": F.when(F.col("o_n").isNull(), False).when(count.isNull(), unpaged).otherwise(paged),
        "units_sound": F.coalesce("s_sound", F.lit(True)),
    }
    return x.select("source_id", broken(checks))


def project_evidence(sources: DataFrame, outcomes: DataFrame, units: DataFrame, refused: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, refused): the ``PROJECT_RULES`` that each project breaks. All tables have ``by``; ``refused`` is what
    ``parse_evidence`` gives. Projects are those that a source, an outcome or a unit names."""
    known = sources.select(by, "source_id", F.col("source_type").alias("_type")).distinct()
    s = sources.join(refused, "source_id", "left").groupBy(by).agg(
        F.lit(True).alias("a"), F.bool_or(F.col("source_type") == "regulatory_text").alias("b"), F.bool_and(F.coalesce(F.size("refused") == 0, F.lit(False))).alias("f")
    )
    o = outcomes.join(known, [by, "source_id"], "left").groupBy(by).agg(F.bool_and(F.col("_type").isNotNull()).alias("d"))
    u = units.join(known, [by, "source_id"], "left").groupBy(by).agg(F.lit(True).alias("c"), F.bool_and(F.coalesce(F.col("source_type") == F.col("_type"), F.lit(False))).alias("e"))
    x = s.join(o, by, "full_outer").join(u, by, "full_outer")
    held = [F.col("a"), F.col("b"), F.col("c"), F.coalesce("d", F.lit(True)), F.coalesce("e", F.lit(True)), F.col("f")]
    return x.select(by, broken(dict(zip(PROJECT_RULES, held, strict=True))))


RECOGNIZED = ("text", "confidence", "original_ocr_text", "bounding_box", "ocr_regions", "low_confidence_characters")
REVIEWED = ("corrected_text", "review_status", "reviewed_at", "reviewed_by", "correction_history")
OCR_RULES = ("low_pages_unique", "low_pages_in_range", "a_review_per_unit", "review_pages_unique", "low_pages_reviewed")
REVIEW_RULES = ("one_unit", "recognized", "of_source", "fields_agree", "review_proper")


def ocr_evidence(outcomes: DataFrame, parsed: DataFrame, reviews: DataFrame) -> DataFrame:
    """(source_id, refused): the ``OCR_RULES`` and, over all its reviews, ``REVIEW_RULES`` that each outcome breaks.

    ``outcomes`` has source_id, source_type, page_count and low_text_pages; ``parsed`` and ``reviews`` owner_id, unit_id,
    source_id, source_type, page and the fields of ``RECOGNIZED`` and ``REVIEWED``, ``parsed`` extraction_method besides, ``reviews``
    method and error. Corrections have corrected_text, reviewed_by and reviewed_at, the last one last."""
    o = outcomes.select(F.col("source_id").alias("owner_id"), F.col("source_type").alias("o_type"), "page_count", "low_text_pages")
    pages = reviews.groupBy("owner_id").agg(F.count("*").alias("r_n"), F.array_sort(F.collect_set("page")).alias("r_pages"), F.count_distinct("page").alias("r_distinct"))
    ocr = parsed.where("extraction_method = 'ocr'")
    count = ocr.groupBy("owner_id").agg(F.count("*").alias("u_n"))
    place = ["owner_id", "unit_id", "source_id", "source_type", "page"]
    fields = (*RECOGNIZED, *REVIEWED)
    u = ocr.groupBy(*place).agg(F.count("*").alias("_n"), F.first(F.struct(*fields)).alias("u"))
    same_place = reduce(Column.__and__, (F.col(f"r.{c}").eqNullSafe(F.col(f"v.{c}")) for c in place))
    x = reviews.alias("r").join(u.alias("v"), same_place, "left").select("r.*", "v._n", "v.u").join(o, "owner_id", "left")
    filled = lambda c: F.coalesce(T.trim_ws(F.col(c)) != "", F.lit(False))
    agree = lambda names: reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"u.{c}")) for c in names))
    none = F.col("corrected_text").isNull() & F.col("reviewed_at").isNull() & F.col("reviewed_by").isNull() & (F.size("correction_history") == 0)
    last = F.get(F.col("correction_history"), F.size("correction_history") - 1)
    done = filled("corrected_text") & (F.col("text") == F.col("corrected_text")) & filled("reviewed_by")
    done &= T.utc_timestamp_valid(F.col("reviewed_at")) & F.col("reviewed_at").rlike(r"^[^.]*(\.[0-9]{3})?Z$")
    done &= reduce(Column.__and__, (F.coalesce(last[c] == F.col(c), F.lit(False)) for c in ("corrected_text", "reviewed_by", "reviewed_at")))
    proper = F.when(F.col("review_status") == "unreviewed", none).when(F.col("review_status") == "corrected", done).otherwise(False)
    checks = {
        "one_unit": F.col("_n") == 1,
        "recognized": (F.col("method") == "ocr") & (F.coalesce("error", F.lit("")) == ""),
        "of_source": (F.col("source_id") == F.col("owner_id")) & (F.col("source_type") == F.col("o_type")),
        "fields_agree": agree(RECOGNIZED),
        "review_proper": proper & agree(REVIEWED),
    }
    of_review = x.groupBy("owner_id").agg(*(F.bool_and(F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()))
    y = reduce(lambda a, b: a.join(b, "owner_id", "left"), (pages, count, of_review), o)
    low, zero = F.col("low_text_pages"), lambda c: F.coalesce(c, F.lit(0))
    seen = F.coalesce("r_pages", F.array().cast("array<int>"))
    held = [
        F.size(F.array_distinct(low)) == F.size(low),
        F.forall(low, lambda p: F.coalesce((p >= 1) & (p <= F.col("page_count")), F.lit(False))),
        zero("r_n") == zero("u_n"),
        zero("r_distinct") == zero("r_n"),
        seen == F.array_sort(F.array_distinct(low)),
    ]
    every = dict(zip(OCR_RULES, held, strict=True)) | {name: F.coalesce(name, F.lit(True)) for name in REVIEW_RULES}
    return y.select(F.col("owner_id").alias("source_id"), broken(every))

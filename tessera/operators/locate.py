"""Text units with locators, and citations checked against them.

Citations are resolved by one equi-join on source, type and page; of a source only its units travel through it, never
its content. What all citations of a finding must satisfy is a grouped ``bool_and``, false for a finding without any.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import search
from tessera.functions import text as T
from tessera.operators import scan

UNITS_AT_ONCE = 1_000


def _plain_ends(content: str) -> Column:
    """CRLF and CR as LF; a text without CR is not searched."""
    return F.when(F.contains(content, F.lit("\r")), F.regexp_replace(content, "\r\n|\r", "\n")).otherwise(F.col(content))


def line_units(sources: DataFrame, source_id: str = "source_id", content: str = "content", more: tuple[str, ...] = ()) -> DataFrame:
    """One unit per line that is not blank: source_id, paragraph_index from 0 and text, trimmed, and the source's columns ``more``.
    CRLF and CR end lines."""
    lines = F.split(_plain_ends(content), "\n")
    units = F.filter(F.transform(lines, T.trim_ws), lambda x: x != "")
    return sources.select(F.col(source_id).alias("source_id"), *more, F.posexplode(units).alias("paragraph_index", "text"))


def block_units(sources: DataFrame, source_id: str = "source_id", content: str = "content") -> DataFrame:
    """One unit per block of lines between blank lines."""
    blocks = F.split(_plain_ends(content), f"\n{T.WS}*\n")
    units = F.filter(F.transform(blocks, T.trim_ws), lambda x: x != "")
    return sources.select(F.col(source_id).alias("source_id"), F.posexplode(units).alias("paragraph_index", "text"))


def fill_articles(units: DataFrame, heading: Column, by: str = "source_id", order: str = "ord") -> DataFrame:
    """``units`` with ``article``: the heading of the unit, or the last one before it in its source."""
    return scan.scanned(units, by, order, scan.Wanted(fills={"article": heading}))


def anchors_of_units(units: DataFrame) -> DataFrame:
    """Units that are not blank as citations of themselves."""
    return units.where(T.trim_ws(F.col("text")) != "").select(
        "source_id", "source_type", "page", "article", "paragraph_index", F.col("text").alias("quote")
    )


def explode_anchors(findings: DataFrame) -> DataFrame:
    """A row per citation: finding_id, anchor_ord and the citation's columns."""
    return findings.select("finding_id", "claim_type", F.posexplode("source_anchors").alias("anchor_ord", "a")).select(
        "finding_id", "claim_type", "anchor_ord", "a.*"
    )


def unique_sources(sources: DataFrame) -> DataFrame:
    """A row per source id with the number of rows that bear it and the type of the first."""
    return sources.groupBy("source_id").agg(F.count("*").alias("n_sources"), F.min("source_type").alias("known_type"))


def authorized_units(units: DataFrame, sources: DataFrame, normal: str | None = None) -> DataFrame:
    """Units of a source that is known once, has their type, and contains their text, once both are normalized; ``normal``
    names a column for the normalized text, which ``locate_quotes`` then takes. Units are cut to parts of at most ``UNITS_AT_ONCE`` of a
    source, and the content meets each part in one row, so it is copied neither for each unit nor do all units of a source stand in one row."""
    x = units.withColumn("_text", T.normalize("text"))
    part = F.pmod(F.xxhash64(*units.columns), F.ceil(F.count("*").over(Window.partitionBy("source_id")) / UNITS_AT_ONCE))
    kept = x.withColumn("_part", part).groupBy("source_id", "_part").agg(F.collect_list(F.struct("_text", *units.columns)).alias("_units"))
    single = sources.groupBy("source_id").agg(F.count("*").alias("n"), F.min("source_type").alias("_type"), F.min("content").alias("_raw"))
    single = single.where("n = 1").select("source_id", "_type", T.normalize("_raw").alias("_content"))
    inside = F.filter("_units", lambda u: (u["source_type"] == F.col("_type")) & F.contains(F.col("_content"), u["_text"]))
    more = [F.col("u._text").alias(normal)] if normal else []
    return kept.join(single, "source_id").select(F.explode(inside).alias("u")).select(*(F.col(f"u.{c}") for c in units.columns), *more)


def locate_quotes(anchors: DataFrame, units: DataFrame, keys: tuple[str, ...] = ("finding_id", "anchor_ord")) -> DataFrame:
    """For each citation whether a unit agrees in page, then paragraph, then article, then contains the quote. Texts are
    compared normalized (``functions.text.normalize``); ``anchors`` has source_id, page, paragraph_index, article and quote besides
    ``keys``, and ``units`` may have their normalized text as ``normal_text``.

    Pages are joined as distinct keys and units by paragraph, so a long page is not met by all of its citations."""
    a = anchors.withColumns({"_article": T.normalize(F.coalesce("article", F.lit(""))), "_quote": T.normalize("quote")})
    u = units.select(
        F.col("source_id").alias("u_source"),
        F.col("page").alias("u_page"),
        F.col("paragraph_index").alias("u_paragraph"),
        T.normalize(F.coalesce("article", F.lit(""))).alias("u_article"),
        (F.col("normal_text") if "normal_text" in units.columns else T.normalize("text")).alias("u_text"),
    )
    page = (F.col("source_id") == F.col("p_source")) & F.col("page").eqNullSafe(F.col("p_page"))
    pages = units.select(F.col("source_id").alias("p_source"), F.col("page").alias("p_page")).distinct()
    place = (F.col("source_id") == F.col("u_source")) & F.col("page").eqNullSafe(F.col("u_page"))
    place &= F.col("paragraph_index").eqNullSafe(F.col("u_paragraph"))
    article = F.col("u_source").isNotNull() & (F.col("_article") == F.col("u_article"))
    best = lambda c: F.coalesce(F.max(c), F.lit(False))
    return (
        a.join(u, place, "left")
        .join(pages, page, "left")
        .groupBy(*keys)
        .agg(
            best(F.col("p_source").isNotNull()).alias("page_ok"),
            best(F.col("u_source").isNotNull()).alias("paragraph_ok"),
            best(article).alias("article_ok"),
            best(article & F.contains("u_text", "_quote")).alias("quote_ok"),
        )
    )


def every(rows: DataFrame, owners: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """``owners`` with each check: true if it holds for all of the owner's rows, false if there are none."""
    agg = rows.groupBy(key).agg(*(F.bool_and(c).alias(c) for c in checks))
    joined = owners.join(agg, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in checks})


GRAM, STEP, BLOCK = 16, 8, 64


def pieces_of(blocks: Column, n: int) -> Column:
    """Every piece of ``n`` characters of a text that is cut into blocks of ``BLOCK``, more than ``n`` of them."""
    longer = F.transform(blocks, lambda b, k: F.concat(b, F.coalesce(F.substr(F.get(blocks, k + 1), F.lit(1), F.lit(n - 1)), F.lit(""))))
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.length(b) - n + 1, F.lit(1)))
    cut = F.transform(longer, lambda b: F.transform(starts(b), lambda k: F.substr(b, k, F.lit(n))))
    return F.filter(F.flatten(cut), lambda x: F.length(x) == n)


def passages(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): texts of ``items`` that occur verbatim in ``docs``.

    An occurrence of an item of at least GRAM + STEP - 1 characters has, within its first STEP characters, a place that is
    a multiple of STEP in the document. So documents give their grams of GRAM characters at every STEP, items those at
    their first STEP places, and both meet where grams are equal; only then is the text compared, at the one place where
    the item must stand. Shorter items have no such gram: for each length that one of them has, the documents give all
    their pieces of that length, each once. Equal texts are looked through once. Texts are cut by one pass, as a place in a
    text is found by counting from its start: pieces are taken from cuts, never from places of the whole."""
    i = items.where("text <> ''").select("item_id", F.col("text").alias("item_text")).distinct()
    named = docs.select("doc_id", "text", F.sha2("text", 256).alias("_key")).where("text is not null")
    texts, d = named.select("_key", "text").dropDuplicates(["_key"]), named.select("_key", "doc_id").distinct()
    least = GRAM + STEP - 1
    at = F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(STEP)), lambda k: F.xxhash64(F.substr(F.col("item_text"), k, F.lit(GRAM))))).alias("at", "h")
    asked = i.where(F.length("item_text") >= least).select("item_id", at)
    cut = F.regexp_extract_all("text", F.lit(f"(?s)(.{{{STEP}}})"), 1)
    grams = F.zip_with(F.slice("_cut", 1, F.size("_cut") - 1), F.slice("_cut", 2, F.size("_cut") - 1), lambda a, b: F.xxhash64(F.concat(a, b)))
    found = texts.where(F.length("text") >= least).select("_key", cut.alias("_cut")).select("_key", F.posexplode(grams).alias("_k", "h"))
    found = found.select("_key", "h", (F.col("_k") * STEP).alias("start"))
    near = found.join(asked, "h").select("item_id", "_key", (F.col("start") - F.col("at")).alias("start")).distinct()
    checked = near.join(i, "item_id").join(texts, "_key")
    held = checked.where(F.substr(F.col("text"), F.col("start") + 1, F.length("item_text")) == F.col("item_text")).select("item_id", "_key")
    short = i.where(F.length("item_text") < least)
    for n in sorted(r[0] for r in short.select(F.length("item_text")).distinct().collect()):  # at most least - 1 lengths
        blocks = texts.where(F.length("text") >= n).select("_key", F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{BLOCK}}})"), 1).alias("_cut"))
        mine = blocks.select("_key", F.explode(F.array_distinct(pieces_of(F.col("_cut"), n))).alias("item_text"))
        held = held.unionByName(mine.join(short, "item_text").select("item_id", "_key"))
    return held.distinct().join(d, "_key").select("item_id", "doc_id").distinct()


#: Quotes of about so many characters are one automaton.
BLOCK_CHARS = 4_000_000


def quote_ranges(docs: DataFrame, quotes: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, quote_id, start, end, n) for each text of ``docs`` and quote (quote_id, text) that it holds once both are
    normalized: the offsets of the first occurrence in the text as it is, the end exclusive, and how often it occurs.

    Quotes are dealt by hash into blocks of about ``block_chars``; the driver holds one block at a time, and texts go once
    through the automaton of each block, whatever the number of quotes. Null and blank quotes are never found, equal rows of quotes count once, and
    null texts hold nothing."""
    q = quotes.select("quote_id", "text").where("text is not null").distinct()
    kinds = dict(docs.dtypes)["doc_id"], dict(quotes.dtypes)["quote_id"]
    blocks = max(1, -(-(q.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    schema = f"doc_id {kinds[0]}, quote_id {kinds[1]}, start long, end long, n long"
    id_type = to_arrow_type(quotes.schema["quote_id"].dataType)

    def through(held: list[tuple]) -> DataFrame:
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = search.Quotes(held)
            for batch in batches:
                at, found = [], []
                for k, text in enumerate(batch.column("text")):
                    for quote, span in automaton.ranges(text.as_py() or "").items():
                        at.append(k)
                        found.append((quote, *span))
                owner = batch.column("doc_id").take(pa.array(at, pa.int64()))
                ids = pa.array([f[0] for f in found], id_type)
                yield pa.RecordBatch.from_arrays([owner, ids, *(pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3))], ["doc_id", "quote_id", "start", "end", "n"])

        return docs.select("doc_id", "text").mapInArrow(rows, schema)

    own = F.pmod(F.xxhash64("quote_id", "text"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (through([tuple(r) for r in q.where(own == b).collect()]) for b in range(blocks)))


def uncovered(sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """Sources that no citation names."""
    return sources.join(anchors.select("source_id").distinct(), "source_id", "left_anti")


def order_units(units: DataFrame) -> DataFrame:
    return units.orderBy(F.coalesce("page", F.lit(0)), "paragraph_index")


def pairs_of_project(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each official source with all regulatory sources of its project, as two tables: (project_id, official_source_id,
    n_primary, primary_digest) and the members (project_id, primary_source_id). Their join by project is all pairs; most
    uses need membership or the set's digest, a sum of hashes that is combined before it is shuffled."""
    members = sources.where("source_type = 'regulatory_text'").select("project_id", F.col("source_id").alias("primary_source_id")).distinct()
    part = F.conv(F.substring(F.sha2(F.col("primary_source_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    of = members.groupBy("project_id").agg(F.count("*").alias("n_primary"), F.sum(part).alias("primary_digest"))
    official = sources.where("source_type = 'official_interpretation'").select("project_id", F.col("source_id").alias("official_source_id")).distinct()
    x = official.join(of, "project_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_primary", "primary_digest")})
    return x, members

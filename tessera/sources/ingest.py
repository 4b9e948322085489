"""Files to sources: admission, hashes, decoding, lines from placed text, recognized pages, and parse summaries.

Files come from ``spark.read.format("binaryFile")`` (path, length, content). What is refused keeps its row with the
reason in ``refused``."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Admission limits and the types of each kind, low-text and low-confidence limits.
MAX_BYTES = 25 * 1024 * 1024
MIME = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "txt": "text/plain",
}
LOW_TEXT, LOW_CONFIDENCE, LONG_TEXT = 12, 0.7, 24_000


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def admit(files: DataFrame, mime: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` with kind and refused (null if admitted)."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    told = F.coalesce(F.col(mime), F.lit("")) if mime else F.lit("")
    right = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))[kind]
    latin = F.decode("content", "ISO-8859-1")
    refused = (
        F.when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file is too large")
        .when(right.isNull() | ~told.isin("", "application/octet-stream") & (told != right), "kind is not supported")
        .when((kind == "pdf") & latin.rlike(r"/Encrypt(?![A-Za-z0-9_])"), "encrypted PDF")
        .when((kind == "docx") & (F.hex(F.substring("content", 1, 4)) == "D0CF11E0"), "encrypted DOCX")
    )
    return files.withColumns({"refused": refused, "kind": F.when(right.isNotNull(), kind)})


def source_id(content: Column, source_type: Column) -> Column:
    return F.concat(F.lit("SRC-"), source_type, F.lit("-"), F.substring(F.sha2(content, 256), 1, 20))


def decoded(content: Column) -> Column:
    """Text by its byte order mark, else UTF-8; null if it is not valid."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 2**31 - 1)
    return (
        F.when(head == "EFBBBF", F.when(F.is_valid_utf8(rest(3).cast("string")), rest(3).cast("string")))
        .when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .otherwise(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")))
    )


def lines_of_items(items: DataFrame) -> DataFrame:
    """Lines (source_id, page, line, text, x, y, width, height) of text items (source_id, page, idx, str, x, y, width,
    height). An item belongs to the first line whose height on the page is within 2; lines run down the page, items
    across it; a gap of more than a fifth of the height, and more than 1, between letters or digits is a space."""

    def assemble(page: pa.Table) -> pa.Table:
        page = page.take(np.argsort(page.column("idx").to_numpy(), kind="stable"))
        x, y, width, height = (page.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y", "width", "height"))
        said = np.array([t or "" for t in page.column("str").to_pylist()], object)
        # the line of an item follows from its height alone, as later lines never come first; one without a height is a line of its own
        shown, first, which = np.unique(y, return_index=True, return_inverse=True, equal_nan=False)
        line_of, tops = np.zeros(len(shown), np.int64), []
        heights: list[tuple[float, int]] = []  # of lines, sorted, with their numbers: more than 2 apart, so at most two are near
        for u in np.argsort(first, kind="stable").tolist():
            at, near = float(shown[u]), []
            k = bisect_left(heights, (at - 2 - abs(at) * 1e-12,))
            while k < len(heights) and heights[k][0] - at <= 2:
                near += [heights[k][1]] if abs(heights[k][0] - at) <= 2 else []
                k += 1
            if not near:
                if at == at:
                    insort(heights, (at, len(tops)))
                tops.append(at)
            line_of[u] = min(near, default=len(tops) - 1)
        rank = np.zeros(len(tops), np.int64)
        rank[sorted(range(len(tops)), key=lambda n: -tops[n])] = np.arange(len(tops))
        line = rank[line_of[which]]
        order = np.lexsort((x, line))
        line, x, y, width, height, said = (c[order] for c in (line, x, y, width, height, said))
        starts = np.flatnonzero(np.diff(line, prepend=-1))
        filled = np.flatnonzero(said != "")
        last, now = filled[:-1], filled[1:]
        high = np.where(height[now] > height[last], height[now], height[last])
        wide = x[now] - x[last] - width[last] > np.where(0.2 * high > 1, 0.2 * high, 1.0)
        for k, n in zip(last[wide & (line[last] == line[now])].tolist(), now[wide & (line[last] == line[now])].tolist(), strict=True):
            a, b = said[k][-1], said[n][0]
            if a.isascii() and a.isalnum() and b.isascii() and b.isalnum():
                said[n] = " " + said[n]
        texts = ["".join(part) for part in np.split(said, starts[1:])]
        left, low = np.fmin.reduceat(x, starts), np.fmin.reduceat(y, starts)
        right, top = np.fmax.reduceat(x + width, starts), np.fmax.reduceat(y + height, starts)
        keys = [pa.array([page.column(c)[0].as_py()] * len(starts), page.schema.field(c).type) for c in ("source_id", "page")]
        found = [pa.array(np.arange(len(starts)), pa.int32()), pa.array(texts, pa.string()), *(pa.array(c, pa.float64()) for c in (left, low, right - left, top - low))]
        return pa.table([*keys, *found], names=["source_id", "page", "line", "text", "x", "y", "width", "height"])

    kind = dict(items.dtypes)["source_id"]
    schema = f"source_id {kind}, page int, line int, text string, x double, y double, width double, height double"
    rows = items.select("source_id", F.col("page").cast("int").alias("page"), "idx", "str", "x", "y", "width", "height")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []  # the page that is open, and its rows so far
        for batch in batches:
            keys, done = list(zip(batch.column("source_id").to_pylist(), batch.column("page").to_pylist(), strict=True)), []
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for low, high in pairwise(cuts):
                if held and keys[low] != at:
                    done.append(assemble(pa.Table.from_batches(held)))
                    held = []
                at = keys[low]
                held.append(batch.slice(low, high - low))
            if done:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
        if held:
            yield from assemble(pa.Table.from_batches(held)).to_batches()

    dealt = rows.repartition("source_id", "page").sortWithinPartitions("source_id", "page")
    return dealt.mapInArrow(pages, schema).withColumn("text", T.collapse_ws(F.col("text")))


def low_text(units: DataFrame, keys: list[str], least: int = LOW_TEXT) -> DataFrame:
    """Pages with fewer than ``least`` characters that are not white space: keys and n_chars."""
    n = F.sum(F.length(T.strip_ws(F.coalesce("text", F.lit("")))))
    return units.groupBy(*keys).agg(n.alias("n_chars")).where(F.col("n_chars") < least)


def flat_ocr(pages: DataFrame) -> DataFrame:
    """Symbols of recognized pages (source_id, page, blocks: nested arrays down to symbols of text and confidence):
    page text, confidence from 0 to 1, the number of symbols of low confidence, and failed for pages without text."""
    words = F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda line: line["words"]))))))
    symbols = F.flatten(F.transform(words, lambda w: w["symbols"]))
    text = F.array_join(F.transform(words, lambda w: F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "")), " ")
    sure = lambda s: F.least(F.greatest(s["confidence"] / 100, F.lit(0.0)), F.lit(1.0))
    x = pages.select("source_id", "page", symbols.alias("s"), T.trim_ws(text).alias("text"))
    mean = F.aggregate("s", F.lit(0.0), lambda a, s: a + sure(s)) / F.nullif(F.size("s"), F.lit(0))
    return x.select(
        "source_id",
        "page",
        "text",
        mean.alias("confidence"),
        F.size(F.filter("s", lambda s: sure(s) < LOW_CONFIDENCE)).alias("n_low"),
        (F.col("text") == "").alias("failed"),
    )


def override_with_ocr(units: DataFrame, ocr: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, failed pages): pages that were recognized lose their other units; those that failed are listed."""
    keys = ["source_id", "page"]
    kept = units.join(ocr.select(*keys).distinct(), keys, "left_anti")
    new = ocr.where("not failed").select(*keys, F.lit(0).alias("paragraph_index"), "text", F.lit("ocr").alias("extraction_method"))
    return kept.unionByName(new, allowMissingColumns=True), ocr.where("failed").select(*keys)


def recover_pages(units: DataFrame, failed: DataFrame, fallback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, pages still failed): failed pages get the lines of their fallback text, if it has any."""
    keys = ["source_id", "page"]
    lines = F.filter(F.transform(F.split("text", "\r\n|\r|\n"), T.trim_ws), lambda x: x != "")
    found = fallback.join(failed, keys, "left_semi").select(*keys, F.posexplode(lines).alias("paragraph_index", "text"))
    kept = units.join(found.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(found, allowMissingColumns=True), failed.join(found, keys, "left_anti")


def summarize(units: DataFrame, by: str = "source_id", order: str = "ord") -> DataFrame:
    """Per source: n_units, n_chars, and content, its texts that are not blank with a blank line between them."""
    text = T.trim_ws(F.col("text"))
    x = units.withColumn("_t", text)
    some = F.when(F.col("_t") != "", F.struct(order, F.col("_t").alias("t")))
    return x.groupBy(by).agg(
        F.count("*").alias("n_units"),
        F.coalesce(F.sum(F.length("_t")), F.lit(0)).alias("n_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda s: s["t"]), "\n\n").alias("content"),
    )


def parse_quality(pages: DataFrame, page_counts: DataFrame) -> DataFrame:
    """Per source (pages: source_id, page, ok; page_counts: source_id, page_count): pages that are missing or failed, and
    coverage; blocked if any failed."""
    got = pages.groupBy("source_id").agg(F.collect_set(F.when(F.col("ok"), F.col("page"))).alias("good"), F.count_if(~F.col("ok")).alias("n_failed"))
    want = F.sequence(F.lit(1), F.col("page_count"))
    x = page_counts.join(got, "source_id", "left")
    return x.select(
        "source_id",
        F.coalesce("n_failed", F.lit(0)).alias("n_failed"),
        F.when(F.col("page_count") > 0, F.array_except(want, F.coalesce("good", F.array().cast("array<int>")))).alias("missing"),
        (F.size("good") / F.nullif(F.col("page_count"), F.lit(0))).alias("coverage"),
        (F.coalesce("n_failed", F.lit(0)) > 0).alias("blocked"),
    )


def verify_artifacts(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows (path, sha256, size) with what is wrong, or null: absent, other bytes, or used twice."""
    have = files.select("path", F.sha2("content", 256).alias("_sha"), F.col("length").alias("_size"))
    twice = manifest.groupBy("sha256").agg(F.count("*").alias("_n"))
    x = manifest.join(have, "path", "left").join(twice, "sha256")
    why = (
        F.when(F.col("_sha").isNull(), "absent")
        .when((F.col("_sha") != F.col("sha256")) | (F.col("_size") != F.col("size")), "other bytes")
        .when(F.col("_n") > 1, "used twice")
    )
    return x.withColumn("why", why).drop("_sha", "_size", "_n")


def strict_json(lines: DataFrame, schema: str, allowed: list[str], column: str = "value") -> DataFrame:
    """``lines`` with the parsed ``row`` and ``refused``: no JSON object, or with keys that are not allowed."""
    keys = F.json_object_keys(column)
    parsed = F.from_json(column, schema)
    refused = F.when(keys.isNull(), "not an object").when(F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0, "unknown key")
    return lines.withColumns({"row": parsed, "refused": refused})


def message_text(content: str = "content") -> Column:
    """The text of a stored chat message: a JSON string, or an array of parts with text."""
    parts = F.from_json(content, "array<struct<text:string>>")
    whole = F.from_json(F.concat(F.lit('{"v":'), F.col(content), F.lit("}")), "v string")["v"]
    return F.when(F.trim(content).startswith("["), F.array_join(F.transform(parts, lambda p: p["text"]), "")).otherwise(F.coalesce(whole, F.col(content)))


def long_texts(sources: DataFrame, least: int = LONG_TEXT) -> DataFrame:
    """Sources of at least ``least`` characters, as a manifest's long documents must be, with their first bytes."""
    return sources.where(F.length("content") >= least).select("source_id", F.length("content").alias("n_chars"), F.hex(F.substring(F.col("content").cast("binary"), 1, 5)).alias("head"))


def bind_ground_truth(truths: DataFrame, scans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expected pages, rejects) of ground truth (source_id, sha256, pages: array of page and text) for scans (source_id,
    sha256): another file, no scan, and repeated pages are rejected with ``why``."""
    known = scans.groupBy("source_id").agg(F.min("sha256").alias("_sha"))
    pages = F.transform("pages", lambda p: p["page"])
    x = truths.join(known, "source_id", "left")
    why = (
        F.when(F.col("_sha").isNull(), "no scan").when(F.col("_sha") != F.col("sha256"), "another file").when(F.size(F.array_distinct(pages)) < F.size(pages), "page twice")
    )
    x = x.withColumn("why", why)
    good = x.where("why is null").select("source_id", F.inline("pages"))
    return good, x.where("why is not null").select("source_id", "why")

"""Segments, overlapping chunks, and the plan of extraction nodes over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import scan
from tessera.sources.shared import checkpointed

#: The policy of chunks, and stages with the source types that they read.
MAX_CHARS, OVERLAP = 24_000, 2
STAGES = (
    ("identity", ("regulatory_text", "official_interpretation")),
    ("atomic", ("regulatory_text",)),
    ("key_matters", ("regulatory_text",)),
    ("impact", ("regulatory_text",)),
)


def check_policy(max_chars: int, overlap: int) -> None:
    if not 3 <= max_chars <= MAX_CHARS or overlap != OVERLAP:
        raise ValueError(f"max_chars must be from 3 to {MAX_CHARS}, and overlap {OVERLAP}")


def segments(sources: DataFrame, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, by: str = "source_id", content: str = "content") -> DataFrame:
    """(source_id, segment_index, start, end): pieces of at most max_chars // (overlap + 1) characters; an empty source
    has one empty piece."""
    check_policy(max_chars, overlap)
    size = max(1, max_chars // (overlap + 1))
    n = F.length(F.coalesce(content, F.lit("")))
    count = F.greatest(F.ceil(n / size).cast("int"), F.lit(1))
    cut = sources.select(F.col(by).alias("source_id"), n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("segment_index"))
    return cut.select(
        "source_id",
        "segment_index",
        (F.col("segment_index") * size).alias("start"),
        F.least((F.col("segment_index") + 1) * size, F.col("n")).alias("end"),
    )


def segment_text(sources: DataFrame, segs: DataFrame) -> DataFrame:
    text = F.substr(F.col("content"), F.col("start") + 1, F.col("end") - F.col("start"))
    return segs.join(sources.select("source_id", "content"), "source_id").select(*segs.columns, text.alias("text"))


def _next_starts(placed: DataFrame, group: str, max_chars: int, overlap: int) -> DataFrame:
    """(group, at, stop, next): the chunk that would start at each segment ends before ``stop``, the number of segments that
    end within max_chars of its start; ``next`` is null where no segment is left. The search is a count over
    segment ends and wanted ends in one order."""
    ends = placed.select(group, F.col("_end").alias("_value"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("at"))
    asked = placed.select(group, (F.col("_end") - F.col("_n") + max_chars).alias("_value"), F.lit(1).alias("_kind"), F.col("_at").alias("at"))
    counted = scan.scanned(ends.unionByName(asked), group, ["_value", "_kind", "at"], scan.Wanted(sums={"_within": (F.col("_kind") == 0).cast("long")}))
    stops = counted.where("_kind = 1").select(group, "at", F.greatest("_within", F.col("at") + 1).alias("stop"))
    there = placed.select(F.col(group).alias("_g"), F.col("_at"))
    x = stops.join(there, F.col(group).eqNullSafe(F.col("_g")) & (F.col("stop") == F.col("_at")), "left")
    return x.select(group, "at", "stop", F.when(F.col("_at").isNotNull(), F.greatest(F.col("at") + 1, F.col("stop") - overlap)).alias("next"))


def _walk(jumps: DataFrame, group: str) -> DataFrame:
    """(group, at, chunk_index): what is reached from the first segment of each group along (group, at, to), and after how
    many steps. Pointers double: round k joins what is reached with jumps of 2**k steps, and jumps with themselves."""
    reached, k = checkpointed(jumps.where("at = 0").select(group, "at", F.lit(0).cast("long").alias("chunk_index"))), 0
    jumps = checkpointed(jumps.where("to is not null"))
    while True:
        on = jumps.select(F.col(group).alias("_g"), F.col("at").alias("_from"), F.col("to").alias("_to"))
        step = lambda df, c: df.join(on, F.col(group).eqNullSafe(F.col("_g")) & (F.col(c) == F.col("_from")))  # noqa: B023, E731
        new = checkpointed(step(reached, "at").select(group, F.col("_to").alias("at"), (F.col("chunk_index") + 2**k).alias("chunk_index")))
        if new.isEmpty():
            return reached
        reached, k = reached.unionByName(new), k + 1
        jumps = checkpointed(step(jumps, "to").select(group, "at", F.col("_to").alias("to")))


def chunks(segs: DataFrame, group: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(group, chunk_index, source_id, segment_index): each chunk takes segments while they fit in max_chars, at least one,
    and the next one starts ``overlap`` segments before its end, at least one further. ``segs`` has group, source_id, segment_index, ord, start,
    end; segments of equal ``ord`` go by source_id and segment_index.

    No group is in one task: places and lengths so far are prefix scans, the end of the chunk from each segment is searched
    in them, and which segments start a chunk is found by doubling pointers, in as many rounds as the longest group
    has bits in its number of chunks. Texts are not read."""
    order = ["ord", "source_id", "segment_index"]
    n = (F.col("end") - F.col("start")).cast("long")
    rows = segs.select(group, *order, n.alias("_n"))
    placed = scan.scanned(rows, group, order, scan.Wanted(sums={"_end": F.col("_n")}, number="_at"))
    placed = checkpointed(placed.withColumn("_at", F.col("_at") - 1))
    starts = checkpointed(_next_starts(placed, group, max_chars, overlap))
    found = _walk(starts.select(group, "at", F.col("next").alias("to")), group)
    named = found.select(F.col(group).alias("_g"), F.col("at").alias("_from"), "chunk_index")
    chosen = checkpointed(starts.join(named, F.col(group).eqNullSafe(F.col("_g")) & (F.col("at") == F.col("_from"))).select(group, "at", "stop", "chunk_index"))
    marks = chosen.select(group, F.col("at").alias("_at"), "chunk_index", F.lit(0).alias("_kind"))
    both = marks.unionByName(placed.select(group, "_at", "source_id", "segment_index", F.lit(1).alias("_kind")), allowMissingColumns=True)
    latest = scan.scanned(both, group, ["_at", "_kind"], scan.Wanted(fills={"_last": F.col("chunk_index")})).where("_kind = 1")
    # a segment is in the last chunk that starts before it, and in up to ``overlap`` chunks before that one
    each = latest.select(group, "_at", "source_id", "segment_index", F.explode(F.sequence(F.greatest(F.col("_last") - overlap, F.lit(0)), F.col("_last"))).alias("chunk_index"))
    inside = chosen.select(F.col(group).alias("_g"), F.col("stop"), F.col("chunk_index").alias("_c"))
    x = each.join(inside, F.col(group).eqNullSafe(F.col("_g")) & (F.col("chunk_index") == F.col("_c")) & (F.col("_at") < F.col("stop")))
    return x.select(group, "chunk_index", "source_id", "segment_index")


def node_plan(chunk_rows: DataFrame, stages=STAGES) -> DataFrame:
    """(node_id, stage, stage_ord, source_type, chunk_id): a node per stage and chunk of a type that the stage reads; the
    first stage reads official chunks source by source. ``chunk_rows`` has chunk_id, source_type and source_id."""
    spark = chunk_rows.sparkSession
    wanted = spark.createDataFrame([(k, s, t) for k, (s, types) in enumerate(stages) for t in types], "stage_ord int, stage string, source_type string")
    x = chunk_rows.select("chunk_id", "source_type", "source_id").distinct().join(F.broadcast(wanted), "source_type")
    apart = (F.col("stage_ord") == 0) & (F.col("source_type") == "official_interpretation")
    name = F.concat_ws(":", "stage", "chunk_id", F.when(apart, F.col("source_id").cast("string")))
    return x.select(name.alias("node_id"), "stage", "stage_ord", "source_type", "chunk_id").distinct()


def prompts(nodes: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """(node_id, payload): what a node's model call gets, as JSON. ``chunk_texts`` has chunk_id, ord, source_id, text."""
    body = chunk_texts.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "text"))).alias("units"))
    return nodes.join(body, "chunk_id").select("node_id", F.to_json(F.struct("stage", "chunk_id", "units")).alias("payload"))


def remaining(plan: DataFrame, runs: DataFrame, key: str = "node_id") -> DataFrame:
    """Nodes of the plan that no valid run has completed."""
    return plan.join(runs.where("is_valid").select(key).distinct(), key, "left_anti")


def is_prefix(plan: DataFrame, runs: DataFrame, key: str = "node_id") -> DataFrame:
    """One row: whether the completed nodes are the first ones of the plan (``plan`` has ord from 0)."""
    done = plan.join(runs.select(key).distinct(), key, "left_semi")
    return done.agg((F.coalesce(F.max("ord") + 1, F.lit(0)) == F.count("*")).alias("is_prefix"), F.count("*").alias("n_done"))


def scope_texts(chunk_texts: DataFrame, quotes: DataFrame) -> DataFrame:
    """(chunk_id, text): the texts a node may cite: its chunk's texts, and quotes of the findings paired with it."""
    return chunk_texts.select("chunk_id", "text").unionByName(quotes.select("chunk_id", F.col("quote").alias("text"))).distinct()


def authorize(anchors: DataFrame, scope: DataFrame, locators: DataFrame) -> DataFrame:
    """Citations (node_id, chunk_id, finding_id, …) with authorized: located in the scope, and quoted from it."""
    place = ["source_id", "page", "article", "paragraph_index"]
    same = F.col("a.chunk_id") == F.col("l.chunk_id")
    for c in place:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"l.{c}"))
    a = anchors.withColumn("_k", F.xxhash64(*anchors.columns))
    found = a.alias("a").join(locators.alias("l"), same, "left_semi")
    quoted = found.alias("a").join(scope.alias("s"), (F.col("a.chunk_id") == F.col("s.chunk_id")) & F.contains("s.text", "a.quote"), "left_semi")
    ok = quoted.select("_k").distinct().withColumn("_ok", F.lit(True))
    return a.join(ok, "_k", "left").withColumn("authorized", F.coalesce("_ok", F.lit(False))).drop("_k", "_ok")


def admitted(authorized: DataFrame) -> DataFrame:
    """(node_id, finding_id) of findings all of whose citations are authorized in the node's scope."""
    return authorized.groupBy("node_id", "finding_id").agg(F.bool_and("authorized").alias("ok")).where("ok").drop("ok")


def source_ids(units: DataFrame, by: str, order: str = "ord") -> DataFrame:
    """(by, source_ids): the sources of each chunk, run or version, each once, in order of first sight."""
    first = units.groupBy(by, "source_id").agg(F.min(order).alias("_o"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "source_id"))), lambda s: s["source_id"]).alias("source_ids"))

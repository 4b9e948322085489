"""Queries whose state is kept by Structured Streaming: chains folded per key, repeats and windows with bounded state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.plans.queries import _folders, query, table
from tessera.sources.shared import new_path
from tessera.streaming import folds, logs


def written_log(spark, df, name):
    """(path, stream) of a log that is written first, as its rows need what stands before them."""
    path = new_path(spark, f"streams/{name}")
    df.write.parquet(path)
    return path, logs.read_stream(spark, path, df.schema, files_per_batch=1000)


def review_log(events):
    """Every event as an action of its user, linked to the last one before it that is not planted as broken."""
    own = F.md5(F.col("event_id").cast("string"))
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    sound = F.last(F.when(F.col("event_id") % 37 > 0, own), ignorenulls=True).over(before)
    broken = F.when(F.col("event_id") % 37 == 0, "x").otherwise(F.coalesce(sound, F.lit("")))
    return events.select("user_id", F.col("event_id").alias("seq"), broken.alias("before_hash"), own.alias("after_hash"), "ts")


@query("""with recursive e as (select user_id, event_id as seq, ts, md5(event_id::varchar) as a, event_id % 37 = 0 as planted, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)),
l as (select *, case when planted then 'x' else coalesce(last_value(case when not planted then a end ignore nulls) over (partition by user_id order by n rows between unbounded preceding and 1 preceding), '') end as b from e),
f as (select user_id, seq, n, true as link_ok, true as time_ok, a as head, ts as head_ts from l where n = 1
  union all select l.user_id, l.seq, l.n, l.b = head, l.ts > head_ts, case when l.b = head and l.ts > head_ts then l.a else head end, case when l.b = head and l.ts > head_ts then l.ts else head_ts end
  from f join l on l.user_id = f.user_id and l.n = f.n + 1)
select user_id, seq, link_ok, time_ok, case when link_ok and time_ok then 'accepted' else 'refused' end as sink from f""")
def stream_folds(spark, d):
    """Actions folded per user by state and timers, and what waits at the end as if the log ended there. The delay is the
    log's counted disorder, so no action of the table is late."""
    path, stream = written_log(spark, review_log(table(spark, d, "events")), "actions")
    out, checkpoint = _folders(spark, "folds")
    folded, _ = folds.run_sinks(folds.fold_stream(stream, "user_id", folds.counted_disorder(spark, path)), out, checkpoint)
    return folded.unionByName(folds.closed(spark, checkpoint, "user_id"))


@query("select event_id, event_type from events")
def stream_bounded_repeats(spark, d):
    """Every event comes again an hour later; an id leaves the state after the longest time between repeats."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path, stream = written_log(spark, e.unionByName(e.withColumn("ts", F.expr("ts + interval 1 hour"))), "repeats")
    delay = max(folds.counted_disorder(spark, path), folds.counted_spread(spark.read.parquet(path), "event_id"))
    once = folds.without_repeats(stream, "event_id", "ts", delay)
    return folds.run_bounded(once, *_folders(spark, "bounded-repeats"))[0].select("event_id", "event_type")


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*)::bigint as n from events group by all")
def stream_windows(spark, d):
    """Events per day and type: windows that have closed, and those still in state when the log ends."""
    path, stream = written_log(spark, table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts")), "windows")
    out, checkpoint = _folders(spark, "windows")
    counts = folds.window_counts(stream, "event_type", "ts", "1 day", folds.counted_disorder(spark, path))
    done, _ = folds.run_bounded(counts, out, checkpoint)
    every = done.unionByName(folds.open_windows(spark, checkpoint, "event_type"))
    return every.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")

"""Structured Streaming over append-only logs: chains per key, repeated actions, ingest of new files, windows of activity.

Results do not depend on how files fall into batches: nothing is dropped for being late, windows are summed over all
batches, and chains are judged in the order of time once the backlog has been read."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import locate


def fold_chains(log: DataFrame, key: str, key_type: str = "long") -> DataFrame:
    """Each event (key, seq, before_hash, after_hash, ts) with link_ok and time_ok against the last accepted event of its
    key. A key's events are taken by ts and seq, whatever files or batches they came in, one at a time."""

    def rows(batches):
        known, last_hash, last_ts = None, None, None
        for batch in batches:
            links, times = [], []
            for k, before, after, ts in zip(*(batch.column(c).to_pylist() for c in (key, "before_hash", "after_hash", "ts")), strict=True):
                if known != (k,):
                    known, last_hash, last_ts = (k,), None, None
                time_ok = last_ts is None or ts is not None and ts > last_ts
                link_ok = last_hash is None or before == last_hash
                links.append(link_ok)
                times.append(time_ok)
                if link_ok and time_ok:
                    last_hash, last_ts = after, ts
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("seq"), pa.array(links, pa.bool_()), pa.array(times, pa.bool_())], [key, "seq", "link_ok", "time_ok"])

    x = log.select(F.col(key).cast(key_type).alias(key), F.col("seq").cast("long").alias("seq"), "before_hash", "after_hash", "ts")
    dealt = x.repartition(F.col(key)).sortWithinPartitions(key, F.col("ts").asc_nulls_last(), "seq")
    return dealt.mapInArrow(rows, f"{key} {key_type}, seq long, link_ok boolean, time_ok boolean")


def without_repeats(actions: DataFrame, id_: str = "action_id") -> DataFrame:
    """One row per id. No watermark: no row is too late, and the state holds the ids."""
    return actions.dropDuplicates([id_])


def run_activity(events: DataFrame, out: str, checkpoint: str, kind: str = "event_type", time: str = "ts", width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Events per window and kind, of windows that ended ``delay`` before the last event. Each batch leaves its counts in
    a folder of its own under ``out``; they are summed at the end, so no event is too late to be counted."""
    spark = events.sparkSession

    def counts(batch: DataFrame, k: int) -> None:
        by = batch.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.max(time).alias("last"))
        by.select("w.start", "w.end", kind, "n", "last").write.mode("overwrite").parquet(f"{out}/batch={k}")

    counts(spark.createDataFrame([], events.schema), -1)
    events.writeStream.foreachBatch(counts).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    last = found.agg((F.max("last") - F.expr(f"interval {delay}")).alias("until"))
    by = found.groupBy("start", "end", kind).agg(F.sum("n").alias("n"))
    return by.join(F.broadcast(last), F.col("end") <= F.col("until")).select("start", kind, "n")


def ingest_lines(sources: DataFrame) -> DataFrame:
    """Line units of a stream of sources (source_id, content)."""
    return locate.line_units(sources)


def read_stream(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run ``stream`` over all that is there, into Parquet at ``out``, and read that; a later call goes on from there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)

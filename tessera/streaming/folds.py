"""Folds of append-only logs with state that stays bounded: chains per key in the order of time, repeated ids, windows.

State moves with the watermark, the greatest time seen less a delay. The delay comes from the log: ``counted_disorder`` gives the
greatest span by which a row comes after a later one, in the order in which files are read, so of a log that
is there nothing is late, however its files fall into batches. What comes later still, after its time has been judged, is
kept in a sink of its own and never judged again. Rows still held in state when a run ends are read from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is known of a chain when its next action comes.
NO_HEAD = (None, None)
#: Of an action, and how many of a key go to the state as one row of arrays: a row of its own costs a call for each value.
ACTION = ("ts", "seq", "before_hash", "after_hash")
PACKED = 200
PACKED_ROW = "ts array<long>, seq array<long>, before_hash array<string>, after_hash array<string>"


def counted_disorder(spark: SparkSession, path: str, time: str = "ts", schema: StructType | None = None) -> int:
    """Milliseconds by which a row can come after a later one if files are read in the order of their modification: the
    greatest time of files up to then, less a file's least time. Files of one moment count as read in any order. Only
    times are read, and what is ordered has one row for each file."""
    files = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    at = F.unix_millis(F.col(time).cast("timestamp"))
    per_file = files.groupBy("_metadata.file_path", "_metadata.file_modification_time").agg(F.min(at).alias("low"), F.max(at).alias("high"))
    moments = per_file.groupBy("file_modification_time").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    before = F.max("high").over(Window.orderBy("file_modification_time").rowsBetween(Window.unboundedPreceding, -1))
    high = F.greatest(before, F.when(F.col("n") > 1, F.col("high")))
    found = moments.select((high - F.col("low")).alias("late")).agg(F.max("late")).first()[0]
    return max(found or 0, 0) + 2  # a row at the watermark is late, and times are cut to milliseconds


def counted_spread(log: DataFrame, id_: str, time: str = "ts") -> int:
    """Milliseconds between the first and the last row of an id, at most."""
    at = F.unix_millis(F.col(time).cast("timestamp"))
    return (log.groupBy(id_).agg((F.max(at) - F.min(at)).alias("d")).agg(F.max("d")).first()[0] or 0) + 2


def judged(head: tuple, rows: list) -> tuple[list, tuple]:
    """[(seq, link_ok, time_ok)] of (ts, seq, before, after) rows in order, and the new head (ts, after): the last row that
    is linked to the head before it and later than that."""
    out = []
    for ts, seq, before, after in rows:
        first = head[0] is None
        link_ok, time_ok = first or before == head[1], first or ts > head[0]
        out.append((seq, link_ok, time_ok))
        if link_ok and time_ok:
            head = (ts, after)
    return out, head


def packed(rows: list) -> list[tuple]:
    """Actions as rows of arrays."""
    return [tuple(map(list, zip(*rows[i : i + PACKED], strict=True))) for i in range(0, len(rows), PACKED)]


def packed_by_key(log: DataFrame, key: str, key_type: str) -> DataFrame:
    """(key, arrays of ``ACTION``) of (key, ``ACTION``): rows of equal keys in an Arrow batch put together, at most ``PACKED``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column(key)))
            ends = pc.run_end_encode(batch.column(key)).run_ends.to_pylist()
            starts = [i for a, b in zip([0, *ends], ends, strict=False) for i in range(a, b, PACKED)]
            offsets = pa.array([*starts, batch.num_rows], pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ACTION)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(starts, pa.int64())), *lists], [key, *ACTION])

    return log.select(key, *ACTION).mapInArrow(rows, f"{key} {key_type}, {PACKED_ROW}")


class ChainFold(StatefulProcessor):
    """Per key: the actions that wait for their time as a list of packed rows, and the head of the chain. A timer is set for
    the first action of each batch and, once it has gone off, for the first one that still waits."""

    def __init__(self, key: str):
        self.row = Row(key, "seq", "link_ok", "time_ok", "sink")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PACKED_ROW)
        self.head = handle.getValueState("head", "ts long, after_hash string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, new, first = timerValues.getCurrentWatermarkInMs(), [], None
        for r in rows:
            known = [t for t in r.ts if t is not None]
            if len(known) < len(r.ts) or min(known) // 1000 <= now:
                actions = list(zip(*(r[c] for c in ACTION), strict=True))
                late = [x[0] is None or x[0] // 1000 <= now for x in actions]
                for x in (x for x, out in zip(actions, late, strict=True) if out):
                    yield self.row(key[0], x[1], None, None, "quarantine")
                kept = [x for x, out in zip(actions, late, strict=True) if not out]
                new += packed(kept)
                known = [x[0] for x in kept]
            else:
                new.append(tuple(r[c] for c in ACTION))
            if known:
                first = min(known) if first is None else min(first, *known)
        if new:
            self.pending.appendList(new)
            self.handle.registerTimer(first // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((x for r in self.pending.get() for x in zip(*r, strict=True)), key=itemgetter(0, 1))
        ready, rest = [r for r in held if r[0] // 1000 <= now], [r for r in held if r[0] // 1000 > now]
        found, head = judged(tuple(self.head.get() or NO_HEAD), ready)
        if head[0] is not None:
            self.head.update(head)
        if rest:
            self.pending.put(packed(rest))
            if rest[0][0] // 1000 not in set(self.handle.listTimers()):
                self.handle.registerTimer(rest[0][0] // 1000)
        else:
            self.pending.clear()
        for seq, link_ok, time_ok in found:
            yield self.row(key[0], seq, link_ok, time_ok, "accepted" if link_ok and time_ok else "refused")

    def close(self) -> None:
        pass


def fold_stream(log: DataFrame, key: str, delay_ms: int, key_type: str = "long") -> DataFrame:
    """A stream of (key, seq, link_ok, time_ok, sink) from a stream (key, seq, before_hash, after_hash, ts). Actions of a
    key are judged in the order of ts and seq, once the watermark has passed them. ``sink`` is accepted, refused (not
    linked to the last accepted action, or not later), or quarantine: its time is null or was already passed."""
    at = F.col("ts").cast("timestamp")
    x = log.withColumn("_clock", at).withWatermark("_clock", f"{delay_ms} milliseconds")
    # the clock itself does not go on: late rows are for the fold to set apart, not for Spark to drop
    x = x.select(F.col(key).cast(key_type).alias(key), F.col("seq").cast("long").alias("seq"), "before_hash", "after_hash", F.unix_micros(F.col("_clock")).alias("ts"))
    schema = f"{key} {key_type}, seq long, link_ok boolean, time_ok boolean, sink string"
    return packed_by_key(x, key, key_type).groupBy(key).transformWithState(ChainFold(key), schema, "append", "eventTime")


def run_sinks(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, StreamingQuery]:
    """Run over all that is there. Each batch is written once, under its number, with a folder per sink, so a batch that
    is run again replaces itself and a sink is read without the others; a later call goes on from ``checkpoint``."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def put(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").partitionBy("sink").parquet(f"{out}/batch={k}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return read_sinks(spark, out, stream.schema), query


def read_sinks(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    columns = [f.name for f in schema]
    return spark.read.schema(StructType([*schema.fields]).add("batch", "long")).option("basePath", out).parquet(out).select(*columns)


def waiting(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, ts, seq, before_hash, after_hash): the actions in state that wait for their time."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "pending").load()
    arrays = held.select(F.col(f"key.{key}").alias(key), "list_element.*")
    return arrays.select(key, F.explode(F.arrays_zip(*ACTION)).alias("x")).select(key, "x.*")


def heads(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, ts, after_hash): the last accepted action of each key."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "head").load()
    return held.select(F.col(f"key.{key}").alias(key), "value.*")


def closed(spark: SparkSession, checkpoint: str, key: str, key_type: str = "long") -> DataFrame:
    """What the waiting actions come to if the log ends here: as ``fold_stream`` gives it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, head = None, NO_HEAD
        for batch in batches:
            out, columns = [], (batch.column(c).to_pylist() for c in (key, "kind", *ACTION))
            for k, run in groupby(zip(*columns, strict=True), itemgetter(0)):
                if known != (k,):
                    known, head = (k,), NO_HEAD
                actions = []
                for _, kind, *row in run:
                    if kind == 0:
                        head = (row[0], row[3])  # it comes before all that waits
                    else:
                        actions.append(row)
                found, head = judged(head, actions)
                out += [(k, *x, "accepted" if x[1] and x[2] else "refused") for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((batch.column(key).type, pa.int64(), pa.bool_(), pa.bool_(), pa.string()))], names)

    names = [key, "seq", "link_ok", "time_ok", "sink"]
    held = waiting(spark, checkpoint, key).withColumn("kind", F.lit(1))
    before = heads(spark, checkpoint, key).withColumn("kind", F.lit(0))  # of keys without waiting actions nothing comes
    both = held.unionByName(before, allowMissingColumns=True).repartition(F.col(key)).sortWithinPartitions(key, "kind", "ts", "seq")
    return both.mapInArrow(rows, f"{key} {key_type}, seq long, link_ok boolean, time_ok boolean, sink string")


def without_repeats(actions: DataFrame, id_: str, time: str, delay_ms: int) -> DataFrame:
    """One row per id. An id leaves the state once the watermark has passed it; ``delay_ms`` is the greater of the log's
    counted disorder and the counted spread of an id's rows, so no repeat comes after its id has gone."""
    return actions.withWatermark(time, f"{delay_ms} milliseconds").dropDuplicatesWithinWatermark([id_])


def window_counts(events: DataFrame, kind: str, time: str, width: str, delay_ms: int) -> DataFrame:
    """Rows per window and kind. A window leaves the state once the watermark has passed its end."""
    by = events.withWatermark(time, f"{delay_ms} milliseconds").groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def run_bounded(stream: DataFrame, out: str, checkpoint: str) -> tuple[DataFrame, dict[str, int]]:
    """Run over all that is there, into Parquet, and read it, with what the run counted: rows_dropped (late ones) and
    most_state, the most rows that its state held after a batch."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()
    states = [s for p in query.recentProgress for s in p["stateOperators"]]
    counted = {"rows_dropped": sum(s["numRowsDroppedByWatermark"] for s in states), "most_state": max((s["numRowsTotal"] for s in states), default=0)}
    return spark.read.schema(stream.schema).parquet(out), counted


def open_windows(spark: SparkSession, checkpoint: str, kind: str) -> DataFrame:
    """(start, end, kind, n) of the windows that are still in state."""
    held = spark.read.format("statestore").option("path", checkpoint).load()
    return held.select(F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"), F.col(f"key.{kind}").alias(kind), F.col("value.count").alias("n"))

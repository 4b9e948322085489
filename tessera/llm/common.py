"""What the operators share: the shared folder, tables written between jobs, and digests of columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: At most so many rows and bytes go to a Python worker at once, so its memory does not depend on how long texts are.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has set smaller ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or a folder of this machine where
    the session names none and runs in local mode, as in tests. It is also made the checkpoint folder of a context that has
    none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage: a lost executor costs no more than
    the tasks it ran, and no job behind the table runs twice."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is sorted and never broadcast. By its own estimate Spark broadcasts what was written in
    few bytes: it knows neither how far a file unpacks nor how many rows an explode makes, and all of them would stand in the driver."""
    return df.hint("merge")


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch``, on whatever store it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: A key with more rows than this is hot if it has more than this share of all rows, so at most ``HOT_KEYS`` keys are.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def join_counted(rows: DataFrame, known: DataFrame, key: str, n: str = "n") -> DataFrame:
    """``rows`` left joined with ``known``, which has each key once and in ``n`` how many of the rows have it. The rows of
    hot keys stay where they are, as the at most ``HOT_KEYS`` hot keys are broadcast, and rows without a key are not joined;
    the rest is shuffled. ``rows`` is read three times, so it should be a table as it was written."""
    limit = max(HOT_ROWS, (known.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS)
    named = rows.where(F.col(key).isNotNull())
    first = named.join(F.broadcast(known.where(F.col(n) > limit).withColumn("_hot", F.lit(True))), key, "left")
    hot = first.where("_hot").drop("_hot")
    rest = first.where("_hot is null").select(*rows.columns).join(shuffled(known.where(F.col(n) <= limit)), key, "left")
    bare = rows.where(F.col(key).isNull())
    more = [F.lit(None).cast(f.dataType).alias(f.name) for f in known.schema if f.name != key]
    return hot.unionByName(rest).unionByName(bare.select(*rows.columns, *more)).drop(n)


def text_of(column: str = "text") -> Column:
    """A text column in which a null is the empty text."""
    return F.coalesce(F.col(column), F.lit(""))

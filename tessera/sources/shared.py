"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Of an Arrow batch: the session's 10,000 rows would be 10,000 whole texts in a Python worker, and several copies of them.
BATCH_ROWS, BATCH_BYTES = 2_000, 8_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, unless it has set smaller ones."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it names none and runs in local mode, a folder of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-tessera-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage and computes it once."""
    path = new_path(df.sparkSession, "kept")
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session shuffles to. Tasks that are put together by bytes would take
    millions of small rows, as those are packed tightly and unfold in memory; what is dealt by number stays apart."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

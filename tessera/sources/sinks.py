"""Results to files: report tables, machine and text summaries, allow-listed exports and strict imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_report(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").partitionBy("report_type").parquet(path)


def machine_report(metrics: DataFrame) -> DataFrame:
    """One column of JSON with sorted keys, a line per row."""
    return metrics.select(F.to_json(F.struct(*sorted(metrics.columns)), {"ignoreNullFields": "false"}).alias("value"))


def text_summary(metrics: DataFrame, rates: list[str]) -> DataFrame:
    """A line per rate of each row, in percent, or ``not_evaluable``."""
    shown = [F.concat(F.lit(f"{r}: "), F.coalesce(F.format_string("%.2f%%", F.col(r).cast("double") * 100), F.lit("not_evaluable"))) for r in rates]
    shown = [F.when(F.col(r).isNull(), F.lit(f"{r}: not_evaluable")).otherwise(s) for r, s in zip(rates, shown, strict=True)]
    return metrics.select(F.concat_ws("\n", *shown).alias("value"))


def export(df: DataFrame, path: str, allowed: list[str]) -> None:
    """Only the named columns, as JSON lines."""
    df.select(*allowed).write.mode("overwrite").json(path)


def import_new(spark: SparkSession, path: str, schema: str, existing: DataFrame, key: str = "project_id") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of exported lines: unreadable lines and known ids are rejected."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").json(path)
    bad = rows.where("_corrupt_record is not null").select(key, F.lit("unreadable").alias("why"))
    good = rows.where("_corrupt_record is null").drop("_corrupt_record")
    known = good.join(existing.select(key), key, "left_semi").select(key, F.lit("known id").alias("why"))
    return good.join(existing.select(key), key, "left_anti"), bad.unionByName(known)


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """Of each project the latest revision, the last updated first."""
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("revision")))
    return sessions.withColumn("_n", rank).where("_n = 1").drop("_n").orderBy(F.desc("updated_at"))


def intact(copies: DataFrame) -> DataFrame:
    """Stored copies (file_hash, size, content) with ok."""
    return copies.withColumn("ok", (F.sha2("content", 256) == F.col("file_hash")) & (F.octet_length("content") == F.col("size")))

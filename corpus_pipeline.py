"""The corpus pipeline: each stage reads the Parquet that the one before it wrote, and works on all its rows.

quality classifier (documents that it rejects go), near-duplicates (five-word shingles, a similarity of at least 0.8; the
document with the smallest id of each group stays), benchmark decontamination (hit passages go, and documents that are mostly hits), personal data (spans are
masked), packing (a row per piece of a document). All stages but the last return the columns of ``documents``; further
columns, whatever their names, go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, decontamination, near_copies, packing, pii
from tessera.llm.common import scratch, shuffled, small_batches, table
from tessera.llm.queries import tokenizer_path

#: A document with a lower score goes.
LEAST_QUALITY = 0.7


def new_name(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels of these rows, scores at least ``LEAST_QUALITY``."""
    score = new_name(docs, "score")
    scored = classifier.with_scores(docs, table(spark, sf_dir, "labels"), score=score)
    return scored.where(F.col(score) >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the one with the smallest id, of rows with that id the one with the
    smallest digest of its text, and of repeated rows the one that is least in all columns. Different texts with one id are
    groups of their own. Rows with a null id stay, as no other row can stand for them."""
    small_batches(spark)
    sha = new_name(docs, "sha")
    stay = near_copies.near_copies(docs.select("doc_id", "text")).where("stays").select("doc_id", F.col("sha").alias(sha)).distinct()
    named = docs.where("doc_id is not null").withColumn(sha, near_copies.text_digest()).join(shuffled(stay), ["doc_id", sha], "left_semi")
    one = named.groupBy("doc_id", sha).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; n_chars follows the text."""
    clean = decontamination.remove_hits(docs, table(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows the text."""
    small_batches(spark)
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_path(), end_id=0, capacity=1024)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination_stage),
    ("pii", personal_data),
    ("packing", pack),
]

#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

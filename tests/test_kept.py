"""Rows that are dealt by number stay apart, and rules counted side by side are the rows of the long form counted."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import rules
from tessera.sources.shared import dealt


def test_dealt_rows_are_not_put_together(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert dealt(spark.range(100), "id").rdd.getNumPartitions() == n


def test_tallied_is_the_long_form_counted(spark):
    df = spark.createDataFrame([("a", True, None), ("a", False, True), ("a", True, True), (None, None, False)], "k string, x boolean, y boolean")
    checks = {"one": F.col("x"), "two": F.col("y")}
    want = Counter(tuple(r) for r in rules.long_form(df, "k", checks).collect())
    assert {tuple(r)[:3]: r.n for r in rules.tallied(df, "k", checks).collect()} == dict(want)

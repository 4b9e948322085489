"""Arrow batches of the library's queries are bounded in rows and bytes."""

from tessera.plans import queries


def test_batches_are_bounded(spark, tmp_path):
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]
    spark.range(1).write.parquet(f"{tmp_path}/t.parquet")
    try:
        spark.conf.set(keys[0], "10000")
        queries.table(spark, str(tmp_path), "t")
        assert [int(spark.conf.get(k).removesuffix("b")) for k in keys] == [2_000, 8_000_000]
        spark.conf.set(keys[0], "100")
        queries.table(spark, str(tmp_path), "t")
        assert int(spark.conf.get(keys[0])) == 100
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)

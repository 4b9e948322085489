"""Joins of the near-duplicate searches: nothing is broadcast but what is hinted, however small its files are."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, components, near_copies, simhash


def test_only_hinted_tables_are_broadcast(spark, monkeypatch):
    plans, write = [], common.written
    plan = lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString())

    def written(df, name):
        plan(df)
        return write(df, name)

    for module in (near_copies, simhash, components):
        monkeypatch.setattr(module, "written", written)
    monkeypatch.setattr(F, "broadcast", lambda df: df.hint("merge"))
    text = lambda k: " ".join(f"w{(k // 3) * 100 + i}" for i in range(60)) + f" end{k}"
    docs = spark.createDataFrame([(k, text(k), "xx", "s", 0) for k in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    found = simhash.near_duplicates(docs)
    for df in (kept, found):
        plan(df)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 6, 9] and found.count() == 12
    assert sum("Join" in p for p in plans) > 15 and not [p for p in plans if "Broadcast" in p]

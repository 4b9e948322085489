"""Parse evidence shuffles a source's content once and texts of units once; else digests move."""

from pyspark.sql import functions as F
from test_parsing import tables

from tessera.functions import text as T
from tessera.operators import parsing


def exchanged(df) -> list[list[str]]:
    """The columns of each shuffle of a plan."""
    found, left = [], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            left.append(node.initialPlan())
        if node.nodeName() == "Exchange":
            found.append([node.output().apply(k).name() for k in range(node.output().size())])
        left += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_texts_are_shuffled_once(spark, tmp_path):
    kept = {}
    for name, df in tables(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
    moved = exchanged(parsing.parse_evidence(**kept))
    assert sum("content" in columns for columns in moved) == 1
    assert not [columns for columns in moved if {"text", "_content", "_raw"} & {*columns}]


def test_an_id_of_two_sources_has_units_twice(spark):
    t = tables(spark)
    twice = t | dict(sources=t["sources"].unionByName(t["sources"].where("source_id = 'c'")))
    got = [(r.source_id, r.refused) for r in parsing.parse_evidence(**twice).collect()]
    both = ["counts_agree", "units_agree", "content_is_rebuilt", "unit_ids_unique", "units_within_content"]
    assert sorted(got) == [("a", []), ("b", []), ("c", both), ("c", both)]


def test_texts_within(spark):
    df = spark.createDataFrame([("Ａ，b  c\n第一条", ["a", "A,b c", " c 第", "", None]), (None, ["a"]), ("a", None)], "content string, texts array<string>")
    assert [r[0] for r in df.select(T.texts_within("content", "texts")).collect()] == [[False, True, True, True, None], [None], None]


def test_folded_rows_tell_their_order(spark, monkeypatch):
    monkeypatch.setattr(parsing.provenance, "FAN", 3)
    rows = [(o, k, f"{o}{k}" if o != 3 else f"1{k}") for o in (1, 2, 3) for k in range(10)]
    df = spark.createDataFrame(rows, "owner_id long, ord long, h string").withColumn("h", F.unhex(F.sha2("h", 256))).repartition(3)
    found = {r.owner_id: r.d for r in parsing.folded(df, "d").collect()}
    assert found[1] == found[3] != found[2]
    turned = {r.owner_id: r.d for r in parsing.folded(df.withColumn("ord", -F.col("ord")), "d").collect()}
    assert turned[1] == turned[3] != found[1]

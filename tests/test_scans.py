"""Prefix scans, chunk packing, edit distance and quote search against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import edit, search
from tessera.functions import text as T
from tessera.operators import chunk, locate, review, scan


@pytest.fixture
def wanted(spark):
    return scan.Wanted({"before": F.col("v"), "text_before": F.col("t")}, {"last": F.col("v")}, {"total": F.col("v")}, "nth")


@pytest.fixture
def rows(spark):
    r = random.Random(1)
    data = [(7 if r.random() < 0.4 else r.randint(0, 30) or None, i, r.choice([None, r.randint(-5, 5)]), r.choice([None, "a", "b"]), "clash") for i in range(3000)]
    return spark.createDataFrame(data, "k long, seq long, v long, t string, total string").repartition(5).withColumn("total", F.lit("clash"))


def test_scan_by_ranges_equals_windows(rows, wanted):
    by = Window.partitionBy("k").orderBy("seq")
    now = by.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "k", "seq", "v", "t", F.lag("v").over(by).alias("before"), F.lag("t").over(by).alias("text_before"), F.last("v", True).over(now).alias("last"), F.sum("v").over(now).alias("total"), F.row_number().over(by).cast("long").alias("nth")
    )
    for n in (1, 4, 40):
        got = scan.by_ranges(rows, ["k"], ["seq"], wanted, ranges=n)
        assert got.columns == want.columns and Counter(got.collect()) == Counter(want.collect())
    assert Counter(scan.scanned(rows, "k", "seq", wanted).collect()) == Counter(want.collect())
    assert Counter(scan.scanned(rows, "k", "seq", wanted, hot_rows=100).collect()) == Counter(want.collect())


def test_a_hot_key_spreads(rows):
    dealt = rows.repartitionByRange(16, "k", "seq").where("k = 7").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(dealt) >= 5 and max(r["count"] for r in dealt) < 500


def test_scans_of_nothing(rows, wanted):
    assert scan.by_ranges(rows.limit(0), ["k"], ["seq"], wanted).count() == 0
    assert scan.scanned(rows.limit(0), "k", "seq", wanted).count() == 0


def test_operators_on_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(scan.scanned, "__defaults__", (50,))
    log = [(1, i, f"h{i - 1}" if i % 40 else "x", f"h{i}", i - (i % 30 == 0)) for i in range(200)]
    df = spark.createDataFrame(log, "k long, seq long, b string, a string, at long").repartition(4)
    got = {r.seq: (r.link_ok, r.time_ok) for r in review.chain(df, "k", "b", "a", "at").collect()}
    assert got == {i: (i == 0 or i % 40 > 0, i == 0 or i % 30 > 0) for i in range(200)}
    falling = {r.seq: r.time_ok for r in review.chain(df, "k", "b", "a", "at", rising=False).collect()}
    assert all(falling.values())
    units = df.select(F.col("k").alias("source_id"), F.col("seq").alias("ord"))
    filled = locate.fill_articles(units, F.when(F.col("ord") % 60 == 5, F.concat(F.lit("A"), "ord")))
    assert {r.ord: r.article for r in filled.collect()} == {i: f"A{(i - 5) // 60 * 60 + 5}" if i >= 5 else None for i in range(200)}
    cut = review.slices(df.select("k", "seq"), F.col("seq"), "k", "seq")
    assert all((r.first, r.last) == (r.seq * (r.seq - 1) // 2, r.seq * (r.seq + 1) // 2) for r in cut.collect())


def chunks_brute(lengths, most, overlap):
    out, at = [], 0
    while at < len(lengths):
        stop, size = at, 0
        while stop < len(lengths) and (stop == at or size + lengths[stop] <= most):
            size, stop = size + lengths[stop], stop + 1
        out.append(list(range(at, stop)))
        if stop >= len(lengths):
            break
        at = max(at + 1, stop - overlap)
    return out


@pytest.mark.parametrize("hot", [10**6, 20])
def test_chunks(spark, monkeypatch, hot):
    monkeypatch.setattr(scan.scanned, "__defaults__", (hot,))
    r = random.Random(3)
    groups = {g: [r.choice([0, 0, 1, 5, 30, r.randint(0, 100)]) for _ in range(r.choice([1, 2, 7, 60]))] for g in range(12)} | {None: [10] * 300, 99: [0] * 50}
    rows = [(g, g, k, k, 0, n) for g, lengths in groups.items() for k, n in enumerate(lengths)]
    segs = spark.createDataFrame(rows, "g long, source_id long, segment_index int, ord long, start int, end int").repartition(5)
    want = [(g, c, g, k) for g, lengths in groups.items() for c, ks in enumerate(chunks_brute(lengths, 100, 2)) for k in ks]
    got = [tuple(x) for x in chunk.chunks(segs, "g", 100, 2).collect()]
    assert Counter(got) == Counter(want)
    assert chunk.chunks(segs.limit(0), "g", 100, 2).count() == 0


def distance_brute(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def test_edit_distance(spark):
    r, pairs = random.Random(4), []
    for _ in range(3000):
        letters = r.choice(["ab", "abcdef", "é😀x"])
        a = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        b = "".join(c for c in a if r.random() < 0.8) if r.random() < 0.5 else "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        pairs.append((a, b))
        want, k = distance_brute(a, b), max(abs(len(a) - len(b)), r.randint(0, 30))
        assert edit.distance(a, b, r.choice([0, 1, 5, 40])) == want
        if a and b:
            assert edit.within(a, b, k) == (want if want <= k else None)
    df = spark.createDataFrame([*pairs[:200], (None, "a"), ("a", None)], "a string, b string")
    assert df.where(~edit.edit_distance(0.01)("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0


def test_edit_distance_of_long_texts():
    r = random.Random(5)
    a = "".join(r.choice("abcdefgh ") for _ in range(100_000))
    b = "".join(c if r.random() > 0.004 else r.choice(["", "x"]) for c in a)
    found = edit.distance(a, b, 1000)
    assert 0 < found <= sum(1 for _ in a) * 0.01 and edit.distance(a[:300] + "zzz" + a[300:], a) == 3


PIECES = ["a", "B", "1", " ", "  ", "　", "\n", "，", "第", "一", "Ａ", "ﬁ", "½", "é", "¨", "(", ".", "．", "﻿"]


def test_quote_ranges(spark):
    r = random.Random(6)
    texts = [None, "", *("".join(r.choice(PIECES) for _ in range(r.randint(0, 60))) for _ in range(300))]
    quotes = [None, "", " ", "¨"] + [t[i : i + r.randint(1, 6)] for t in texts[2:200] for i in [r.randint(0, len(t))]]
    docs = spark.createDataFrame([(k if k % 9 else None, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, start string").repartition(3)
    asked = spark.createDataFrame([(f"q{k}", q) for k, q in enumerate(quotes)], "quote_id string, text string")
    want = Counter()
    for k, t in enumerate(texts):
        for i, q in enumerate(quotes):
            span = T.normalized_range(t, q) if t and q else None
            if span:
                want[k if k % 9 else None, f"q{i}", *span] += 1
    for size in (10**6, 50):
        got = locate.quote_ranges(docs, asked, size).collect()
        assert Counter((g.doc_id, g.quote_id, g.start, g.end) for g in got) == want and min(g.n for g in got) == 1 < max(g.n for g in got)
    assert locate.quote_ranges(docs, asked.limit(0)).count() == 0


def test_a_normal_text_has_a_sparse_map():
    held = search.normal("plain words and nothing else " * 1000)
    assert len(held.places) < 5 and held.origin(7) == 7
    held = search.normal("a ,  b")
    assert held.text == "a,b" and [held.origin(k) for k in range(3)] == [0, 2, 5]

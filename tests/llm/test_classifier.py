"""The classifier's parts against brute force, and its accuracy on held-out labels of a given table."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifier, queries


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def texts_of(seed):
    r = random.Random(seed)
    return [" ".join(r.choices(["aa", "bb", "Cc", "d9", "é", "ff", "gg!"], k=r.randint(0, 30))) for _ in range(40)] + [None, "", "one"]


def test_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(classifier, "MOST_COUNTED", 3)
    texts = texts_of(1)
    counts = {}
    for t in texts:
        for w in (t or "").encode().split():
            counts[w] = counts.get(w, 0) + 1
    for size in (1, 3, 100):
        least = min(n for n in [0, *counts.values()] if sum(m > n for m in counts.values()) <= size)
        assert classifier.vocabulary(docs_of(spark, texts), size=size) == sorted(w for w in counts if counts[w] > least)


def test_vectors(spark):
    texts, words = texts_of(2), [b"bb", b"aa"]
    buckets = classifier.Buckets(words)
    places, signs = buckets.index_vectors()
    sums, n = np.zeros((buckets.n, classifier.DIM)), np.zeros(buckets.n)
    for t in texts:
        plain = (t or "").encode().split()
        ids = [words.index(w) if w in words else 2 + zlib.crc32(w) % classifier.TAIL for w in plain]
        assert buckets.ids([(t or "").encode()])[0].tolist() == ids
        shapes = buckets.ids([(t or "").encode()])[1].tolist()
        for row in (ids, shapes):
            for k, x in enumerate(row):
                n[x] += 1
                for y in row[max(0, k - 1) : k] + row[k + 1 : k + 2]:
                    for j in range(classifier.NONZERO):
                        sums[x, places[y, j]] += signs[y, j]
    got = classifier.word_vectors(docs_of(spark, texts), spark.sparkContext.broadcast(words))
    assert np.allclose(got, classifier.vectors_of(buckets, sums, n), atol=1e-6)
    pooled = classifier.pooled([(t or "").encode() for t in texts], buckets, got)
    for t, row in zip(texts, pooled, strict=True):
        ids, shapes, _ = buckets.ids([(t or "").encode()])
        if len(ids):
            want = np.concatenate((got[ids].mean(axis=0), got[ids].std(axis=0), got[shapes].mean(axis=0)))
            assert np.allclose(row, want, atol=2e-3)
        else:
            assert not row.any()


def test_slopes_and_temperature():
    r = np.random.default_rng(1)
    z, y = r.normal(size=(50, 6)), (r.random(50) < 0.5).astype(float)
    weights = [r.normal(size=(6, 4)), r.normal(size=4), r.normal(size=4), r.normal(size=1)]

    def loss(w):
        p = 1 / (1 + np.exp(-(np.tanh(z @ w[0] + w[1]) @ w[2] + w[3])))
        return -np.log(np.where(y == 1, p, 1 - p)).mean() + 0.05 * ((w[0] ** 2).sum() + (w[2] ** 2).sum())

    for k, g in enumerate(classifier.slopes(weights, z, y, 0.1)):
        for at in np.ndindex(g.shape):
            up, down = [[w.copy() for w in weights] for _ in range(2)]
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-5)
    net = classifier.Network(r.normal(size=(300, 3)) + np.repeat([[0.0], [1.0]], 150, axis=0), np.repeat([0.0, 1.0], 150))
    grid = np.geomspace(0.25, 8, 61)
    assert net.temperature in grid and net.trained


def test_rows_are_bounded_after_the_join(spark):
    """An id that very many documents share brings no more rows to the task that learns."""
    docs = spark.range(3000).selectExpr("case when id < 2900 then 4 else id end as doc_id", "concat('w', id % 7, ' x') as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    words = spark.sparkContext.broadcast([b"x"])
    vectors = spark.sparkContext.broadcast(classifier.word_vectors(docs, words))
    both = labels.where("doc_id = 4").selectExpr("doc_id", "explode(array(0, 1)) as quality")
    for some in (labels, both):
        rows = classifier.training_rows(docs, some, words, vectors, max_train=50)
        assert rows.count() <= 50
        classifier.fit(rows)
    assert rows.count() == 50
    assert classifier.with_scores(docs, labels, max_train=50).count() == 3000


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op4_quality_classifier"](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == r.quality for r in rows])
    assert auc > 0.97 and right > 0.9, (auc, right, len(rows))


def test_clashing_columns_repeats_and_long_texts(spark):
    long = "word other " * 100_000
    rows = [(1, "a b", "x", 1), (1, "a b", "x", 1), (2, long, None, 2), (None, None, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, bucket long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    got = classifier.with_scores(docs, labels)
    assert got.columns == ["doc_id", "text", "bucket", "score"]
    rows = got.collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1 and dict(got.dtypes)["score"] == "double"
    assert classifier.with_scores(docs.where(F.lit(False)), labels).count() == 0

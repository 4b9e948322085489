"""The classifier's accuracy on held-out labels, and the pipeline's stages on planted cases."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import classifier, near_copies
from tessera.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path, n=400):
    r = random.Random(1)
    syllables = "ba do ki lu me no pa ri su te vo wa".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(r.randint(60, 150))]
        bad = i % 4 == 1
        text = " ".join(w + r.choice(["$$$", "***", "&&&"]) for w in words) if bad else " ".join(words).capitalize() + "."
        docs.append([i, text])
        labels.append((i, int(not bad), 0))
    item = " ".join(word() for _ in range(20))
    docs[40][1] += " " + item + " and after."
    docs[80][1] += " Write to a.b@c.org or +1 (743) 555-3824."
    copy = docs[120][1].replace(".", "!", 1)
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in [*docs, [n, docs[120][1]], [n + 1, docs[120][1]], [n + 2, None], [n + 3, ""]]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return copy, item


def test_classifier_and_stages(spark, tmp_path):
    _, item = corpus(spark, tmp_path)
    d = str(tmp_path)
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = classifier.with_scores(docs, labels).withColumn("held", classifier.held_out(F.col("doc_id"))).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert {r.doc_id for r in scored if r.held} == {r.doc_id for r in scored if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    right = [(r.score >= 0.7) == (r.doc_id % 4 != 1) for r in scored if r.held and r.doc_id < 400]
    assert sum(right) >= 0.97 * len(right)
    good = corpus_pipeline.quality(spark, docs, d)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert {401, 400, 120, 40, 80} <= kept and not {1, 5, 9} & kept
    one = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, d).collect()}
    assert 120 in one and not {400, 401} & one and 40 in one
    clean = {r.doc_id: r for r in corpus_pipeline.decontamination_stage(spark, docs, d).collect()}
    assert item not in clean[40].text and clean[40].text.endswith("and after.") and clean[0].n_chars == len(clean[0].text)
    masked = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, docs, d).collect()}
    assert masked[80].endswith("Write to <EMAIL> or <PHONE>.") and masked[402] is None
    pieces = corpus_pipeline.run(spark, d).collect()
    assert pieces and {r.doc_id for r in pieces} <= kept and 400 not in {r.doc_id for r in pieces}


def test_clashing_columns_go_through_unchanged(spark, tmp_path):
    corpus(spark, tmp_path, 160)
    d = str(tmp_path)
    names = ("sha", "score", "_score", "row", "node", "of", "stays", "sha_")
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert out.where(" or ".join(f"{c} <> concat('{c} of ', doc_id)" for c in names)).count() == 0 < out.count()


def test_scores_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "x"), (None, None, "y")], "doc_id long, text string, score string")
    for rows, want in (([], 0.5), ([(1, 1)], 1.0), ([(1, None)], 0.5)):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert {r.score for r in classifier.with_scores(docs, labels).collect()} == {want}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert stage(spark, spark.createDataFrame([], DOCS), str(tmp_path)).count() == 0


def test_near_copies_with_changed_words(spark, monkeypatch):
    """Copies of similarity 0.8 and more go, whether their buckets are crowded or not; the rest stays."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(5000)]
    shingles = lambda t: {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
    docs, last, n_copies = [], 0, 0
    for group in range(40):
        base = r.choices(vocabulary, k=r.randint(80, 400))
        docs.append((last := last + 1, base))
        for _ in range(60 if group == 0 else 4):
            copy = list(base)
            for k in r.sample(range(len(base)), r.randint(1, 1 + len(base) // 30)):
                copy[k] = r.choice(vocabulary)
            docs.append((last := last + 1, copy))
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(1, i):
            common = len(sets[i] & sets[j])
            if common and common / len(sets[i] | sets[j]) >= 0.8:
                n_copies += common / len(sets[i] | sets[j]) < 0.95
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert n_copies > 100
    monkeypatch.setattr(corpus_pipeline.near_copies, "CROWDED", 8)
    table = spark.createDataFrame([(i, " ".join(t), "xx", "s", 0) for i, t in docs], DOCS).repartition(3)
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    assert kept == {i for i in root if find(i) == i}


def test_sketches_differ_in_no_more_than_the_sets():
    r = np.random.default_rng(2)
    for n in (0, 5, 140, 3000):
        x, y = (np.unique(r.integers(0, 2**64, n, np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[: n * 9 // 10], y[: n // 10]]))
        apart = int(np.bitwise_count((near_copies.sketch(x) ^ near_copies.sketch(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y)) and near_copies.sketch(x).shape == (near_copies.SKETCH,)


def test_candidates_of_templated_texts(spark):
    """Texts of one template share most words, but none two are alike: hardly any pair is a candidate."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(4000)]
    common = [r.choice(words) for _ in range(140)]
    sentences = [[r.choice(words) for _ in range(14)] for _ in range(50)]
    texts = [" ".join(common + [w for s in r.sample(sentences, 6) for w in s]) for _ in range(600)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(600, texts[0] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chosen = docs.select(near_copies.text_digest().alias("sha")).distinct()
    sets = written(near_copies.shingle_sets(docs, 5, chosen), "sets")
    nodes = sets.select("node", F.col("node").alias("root"))
    pairs = near_copies.prefix_pairs(nodes, sets, near_copies.frequent(sets), 4).count()
    held = {x.node: set(x.hashes) for x in sets.collect()}
    like = sum(len(a & b) >= 0.8 * len(a | b) for a, b in itertools.combinations(held.values(), 2))
    assert 1 <= like <= pairs <= like + 60

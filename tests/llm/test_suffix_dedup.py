"""Substring dedup against brute force."""

import random

import numpy as np
import pytest

from tessera.llm import queries, suffix_dedup


def brute(docs, length):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - length + 1 if i is not None else 0):
            s = b[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = set()
        for k in range(len(b) - length + 1 if i is not None else 0):
            if first[b[k : k + length]] < i:
                gone.update(range(k, k + length))
        out.append((i is not None, i or 0, len(b), len(gone), sum(k - 1 not in gone for k in gone), bytes(c for k, c in enumerate(b) if k not in gone)))
    return sorted(out)


def random_docs(seed, n):
    r = random.Random(seed)
    words = [("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))) for _ in range(300)]
    passages = [" ".join(r.choices(words, k=r.randint(6, 30))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [" ".join(r.choices(words, k=r.randint(0, 25))) if r.random() < 0.5 else r.choice(passages) for _ in range(r.randint(0, 5))]
        t = r.choice(["", " "]).join(parts)
        if docs and r.random() < 0.3:
            t = r.choice(docs)[1] or ""
            for _ in range(r.randint(0, 3)):
                k = r.randint(0, len(t))
                t = t[:k] + r.choice("xyz") + t[k + r.randint(0, 1) :]
        docs.append((i * 3 % (2 * n), t))
    return [*docs, (None, docs[0][1]), (5, None), (7, ""), (9, "a" * 400), (11, "b" + "a" * 200), (9, "a" * 400), (13, "x" * 49), (14, "x" * 50), (15, "x" * 50)]


@pytest.mark.parametrize(("seed", "batches", "size", "hot"), [(1, 4, 600, 20_000), (2, 1, 10**9, 20_000), (3, 6, 2000, 3), (1, 15, 2000, 0)])
def test_remove_repeats(spark, seed, batches, size, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_HITS", hot)
    docs = random_docs(seed, 60)
    table = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, start string").repartition(3)
    rows = suffix_dedup.remove_repeats(table, 50, batches, size).collect()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, sum(b - a for a, b in r.spans), len(r.spans), bytes(r.kept)) for r in rows)
    assert got == brute(docs, 50)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op9_suffix_array"](spark, str(tmp_path)).collect() == []


def test_runs_of_nul_bytes(spark):
    r = random.Random(5)
    part = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = [part(20) + "\0" * n + part(20) for n in (15, 16, 17, 40, 120)]
    docs = [(i, part(30) + shared[i % 5] + part(30)) for i in range(15)] + [(20, "\0" * 60), (21, "x" + "\0" * 60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = suffix_dedup.remove_repeats(table, 50, 2, 2000).collect()
    got = sorted((True, x.doc_id, x.n_bytes, sum(b - a for a, b in x.spans), len(x.spans), bytes(x.kept)) for x in rows)
    assert got == brute(docs, 50)


def test_heads_are_in_suffix_order():
    r = random.Random(7)
    texts = ["".join(r.choice("ab") for _ in range(400)).encode() for _ in range(3)]
    s = suffix_dedup.Slice(texts, 50)
    (high, low, docs, _), _ = suffix_dedup._scan(*s.heads(), np.array([1, 2, 3])[s.rows], np.zeros(len(s.rows), np.uint8))
    heads = [int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big") for a, b in zip(high, low, strict=True)]
    data = b"".join(texts)
    assert heads == sorted({data[k : k + 16] for k in s.anchors.tolist()}) and len(heads) > 20
    pairs = zip(heads, heads[1:], strict=False)
    assert suffix_dedup.common_prefix(high, low).tolist() == [next(k for k in range(17) if k == 16 or a[k] != b[k]) for a, b in pairs]
    assert suffix_dedup.head_hashes(high, low).tolist() == [int(suffix_dedup.gram_hashes(np.frombuffer(h + bytes(16), np.uint8))[0]) for h in heads]


def test_levels_grow_like_a_binary_counter(spark, monkeypatch):
    """After fifteen batches four levels are alive, of 8, 4, 2 and 1 batches."""
    ranks = []
    for k in range(1, 101):
        kept, rank = suffix_dedup.levels_after(ranks)
        ranks = [*ranks[:kept], rank]
        assert sum(2**r for r in ranks) == k and ranks == sorted(set(ranks), reverse=True)
        assert k != 15 or ranks == [3, 2, 1, 0]
    dropped = []
    monkeypatch.setattr(suffix_dedup, "drop", lambda spark, path: dropped.append(path))
    docs = spark.createDataFrame([(i, f"document {i} " * 12) for i in range(60)], "doc_id long, text string").repartition(2)
    suffix_dedup.hits(docs, 50, 15, 4)
    levels = [p for p in dropped if p.endswith("/of=level")]
    assert len(levels) == len(set(levels)) == 15


def test_long_and_clashing(spark):
    long = "".join(random.Random(9).choice("abcdefgh ") for _ in range(300_000))
    docs = [(1, long), (2, "x" + long[1000:200_000] + "y"), (2, "x" + long[1000:200_000] + "y"), (3, None)]
    table = spark.createDataFrame([(i, t, b"k", 1) for i, t in docs], "doc_id long, text string, key binary, window long")
    rows = sorted((r.doc_id, r.n_bytes, sum(b - a for a, b in r.spans)) for r in suffix_dedup.remove_repeats(table).collect())
    assert rows == [(1, 300_000, 0), (2, 199_002, 199_000), (2, 199_002, 199_000), (3, 0, 0)]

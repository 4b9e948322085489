"""Tokens, packing and token files against the library's own encoding of whole texts."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, queries, token_binary, tokens
from tessera.llm.common import scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, start string, length long"


LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def whole(text, end):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, end]


def random_texts(seed, n):
    r = random.Random(seed)
    parts = ["the", "Éa", "it's", "22", "…", "<|endoftext|>", " ", "\x1c", "\x85", "　", " ", "  ", "   ", "\n", " \n ", "\t", "\r\n", "a.b", "😀", "un", "ing"]
    return ["".join(r.choice(parts) + r.choice(["", " ", " "]) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_encoder_equals_library():
    texts = random_texts(1, 3000)
    enc = tokens.Encoder(PATH)
    for _ in range(2):
        for t, ids in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole(t, 0)[:-1], repr(t)


def docs_of(spark, texts):
    rows = [(i // 2 * 3 if i % 7 else None, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


TEXTS = [*random_texts(2, 60), None, "", "long text " * 900, "long text " * 900, "word " * 40]


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    docs = docs_of(spark, TEXTS)
    rows = packing.pack(docs, PATH, 0, capacity, keep_ids=True).collect()
    sequences = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length, bytes(r.ids)))
    for s in sequences.values():
        s.sort()
        assert [o for o, _, _ in s] == np.cumsum([0] + [n for _, n, _ in s])[:-1].tolist()
        assert sum(n for _, n, _ in s) <= capacity
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / capacity + 1
    want = sorted(np.array(whole(t, 0), "<u4").tobytes()[4 * k : 4 * (k + capacity)] for t in TEXTS for k in range(0, len(whole(t, 0)), capacity))
    assert sorted(bytes(r.ids) for r in rows) == want
    assert packing.pack(docs.limit(0), PATH).count() == 0
    joined = packing.sequences(packing.pack(docs, PATH, 0, capacity, keep_ids=True)).collect()
    assert sum(len(r.ids) for r in joined) == 4 * total


def test_patterns_use_each_piece_once():
    r = random.Random(3)
    for size in (1, 5, 60, 1023):
        want = {r.randint(1, 1023): r.randint(1, 50) for _ in range(size)}
        used = defaultdict(int)
        for p in packing.patterns(dict(want), 1024):
            assert sum(w * n for w, n in zip(p.lengths, p.counts, strict=True)) <= 1024
            for w, n in zip(p.lengths, p.counts, strict=True):
                used[w] += n * p.times
        assert used == want


def test_numbers_round_trip():
    r = random.Random(4)
    docs = [[r.choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)] for n in (0, 1, 3, 4, 5, 0, 40)]
    for some in (docs, docs[:1], [[1, 2, 3]], [d and [1, 300] for d in docs], []):
        counts = np.array([len(d) for d in some], np.int64)
        control, data, n_control, n_data = token_binary.encode_numbers(np.array([x for d in some for x in d], np.uint32), counts)
        assert (n_control.sum(), n_data.sum()) == (len(control), len(data))
        assert token_binary.decode_numbers(control, data, counts).tolist() == [x for d in some for x in d]
        at, of = 0, 0
        for d, n, m in zip(some, n_control, n_data, strict=True):
            assert token_binary.decode_numbers(control[of : of + n], data[at : at + m], np.array([len(d)])).tolist() == d
            at, of = at + m, of + n


def test_token_files(spark):
    docs, path = docs_of(spark, TEXTS), scratch(spark, "test-tokens")
    files, by_rank = token_binary.write_files(docs, path, PATH, 2, part_ids=2000, file_ids=500)
    rows = token_binary.read_files(files, path, by_rank).collect()
    assert files.count() > 5
    rows.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    want = sorted((d.doc_id is not None, d.doc_id or 0, np.array(whole(d.text, 2), "<u4").tobytes()) for d in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in rows) == want


def test_token_files_with_hot_ids(spark):
    """An id, and the rows without one, that fill many parts are dealt to all of them."""
    texts = [f"text {k} " * 20 for k in range(200)]
    rows = [(7 if k < 90 else None if k < 140 else k, t) for k, t in enumerate(texts)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch(spark, "hot-tokens")
    files, by_rank = token_binary.write_files(docs, path, PATH, 2, part_ids=1000)
    sizes = [r.n for r in files.groupBy("part").agg({"n_ids": "sum"}).toDF("part", "n").collect()]
    assert len(sizes) > 8 and max(sizes) < 4 * sum(sizes) / len(sizes)
    got = sorted(token_binary.read_files(files, path, by_rank).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted((i or 0, np.array(whole(t, 2), "<u4").tobytes()) for i, t in rows)
    assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == want
    crc = token_binary.read_files(files, path, by_rank, digests=True).collect()
    assert sorted((r.start, r.ids_crc32) for r in crc) == [(r.start, zlib.crc32(r.ids)) for r in got]
    with pytest.raises(TypeError):
        token_binary.write_files(docs.selectExpr("'a' as doc_id", "text"), path, PATH)


@pytest.mark.parametrize("name", ["op2_packing", "op3_token_binary"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []

"""Fill-in-the-middle, best-fit packing and vector codes against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bin_completion, fill_middle, queries, vector_codes

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
PARTS = ["the", "Ab", "zz" * 150, "é", "😀", " ", "\n", "[", "@", "`{", "<", "P>", "<S", "\x00", "1"]


def texts(seed, n, longest=50):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("size", "error"), [(1_000_000, 100), (7, 3), (1, 1)])
def test_rank_index_is_exact(size, error):
    for t in [*texts(1, 300), "a" * 5000, " " * 5000, "x " * 3000]:
        want = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", t))]
        index = fill_middle.RankIndex.of(t, error, size)
        assert [index.offset(k) for k in range(len(index))] == want


def test_segments_are_bounded():
    index = fill_middle.RankIndex.of("ab " * 200_000)
    assert len(index.first) < 20 and index.residuals.dtype == np.int8 and abs(index.residuals.astype(int)).max() <= 101
    with pytest.raises(ValueError):
        fill_middle.RankIndex.of("a", error=101)


def fim_brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if h4 % 100 < 20 else "psm", len(prefix), len(middle), out, text


def test_fill_in_middle(spark):
    every = [None, "", "with <P> in it", "a<S>", "<M>", *texts(2, 200), "long word " * 60_000, "q" * 300_000]
    rows = [(k if k % 17 else None, t) for k, t in enumerate(every)] + [(9, "twice here"), (9, "twice here")]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, output string, n int").repartition(3)
    out = fill_middle.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(r) for r in out.withColumn("restored", fill_middle.restored()).collect()]
    assert Counter(got) == Counter(fim_brute(*r) for r in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(k, "some words here") for k in range(50)], "doc_id long, text string")
    out = fill_middle.fill_in_middle(docs, plain_percent=0, spm_percent=100, markers=("«pre»", "«suf»", "«mid»"))
    got = out.withColumn("restored", fill_middle.restored(markers=("«pre»", "«suf»", "«mid»"))).collect()
    assert {(r.form, r.restored) for r in got} == {("spm", "some words here")} and all(r.output.startswith("«suf»") for r in got)
    for bad in (("a", "a", "b"), ("", "b", "c"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fill_middle.fill_in_middle(docs, markers=bad)


def fewest(items, capacity):
    """By trying all ways to put each item in an open sequence or a new one."""
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def held(patterns, capacity):
    used = Counter()
    for p in patterns:
        assert p.times > 0 and sum(w * n for w, n in zip(p.lengths, p.counts, strict=True)) <= capacity
        for w, n in zip(p.lengths, p.counts, strict=True):
            used[w] += n * p.times
    return used


def test_bin_completion_is_optimal_on_small_instances():
    r = random.Random(4)
    improved = 0
    for _ in range(150):
        items = [r.randint(8, 60) for _ in range(r.randint(1, 11))]
        found, least = bin_completion.complete(Counter(items), 100, effort=10**6)
        assert held(found, 100) == Counter(items)
        n = sum(p.times for p in found)
        assert least <= n == fewest(items, 100)
        improved += n < sum(p.times for p in bin_completion.best_fit(Counter(items), 100))
    assert improved


def best_fit_brute(items, capacity):
    rooms = []
    for w in sorted(items, reverse=True):
        fits = [room for room in rooms if room >= w]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - w)
    return sorted(rooms)


def test_best_fit_of_a_histogram_is_that_of_single_pieces():
    r = random.Random(5)
    for _ in range(100):
        items = [r.choice([r.randint(1, 100), 7, 33]) for _ in range(r.randint(1, 80))]
        got = [100 - sum(w * n for w, n in zip(p.lengths, p.counts, strict=True)) for p in bin_completion.best_fit(Counter(items), 100) for _ in range(p.times)]
        assert sorted(got) == best_fit_brute(items, 100)


def test_many_pieces_of_a_length():
    want = Counter({1: 10**9, 700: 3 * 10**9 + 1, 900: 10**9, 2048: 5})
    found, least = bin_completion.complete(want, 2048)
    assert held(found, 2048) == want and least <= sum(p.times for p in found) <= sum(p.times for p in bin_completion.best_fit(want, 2048))
    assert bin_completion.complete({}, 2048) == ([], 0)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_best_fit_packing(spark, capacity):
    every = [*texts(6, 80), None, "", "long text " * 900, "long text " * 900, "word " * 40]
    rows = [(i // 2 * 3 if i % 7 else None, t, "clash", 1) for i, t in enumerate(every)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, piece int").repartition(3)
    got = bin_completion.pack(docs, PATH, 0, capacity, keep_ids=True).collect()
    sequences = defaultdict(list)
    for g in got:
        assert len(g.ids) == 4 * g.length and zlib.crc32(g.ids) == g.ids_crc32
        sequences[g.sequence_id].append((g.offset, g.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0] + [n for _, n in s])[:-1].tolist() and sum(n for _, n in s) <= capacity
    want = []
    for i, t, *_ in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        ends = range(first, len(ids) + 1, capacity)
        want += [(i, k, max(e - capacity, 0), np.array(ids[max(e - capacity, 0) : e], "<u4").tobytes()) for k, e in enumerate(ends)]
    assert Counter((g.doc_id, g.piece, g.start, bytes(g.ids)) for g in got) == Counter(want)
    assert len(sequences) <= 1.05 * sum(g.length for g in got) / capacity + 1
    assert bin_completion.pack(docs.limit(0), PATH).count() == 0


def test_nearest_entries_by_cells():
    r = np.random.default_rng(1)
    for spread in (3, 40, 400):
        entries = r.integers(-spread, spread, (64, 4))
        entries[10] = entries[3]
        cells = vector_codes.Cells(entries, most_cells=50)  # forgets
        for _ in range(10):
            parts = r.integers(-2 * spread, 2 * spread, (300, 4))
            parts[:64] = entries
            index, far = cells.nearest(parts)
            every = ((parts[:, None, :] - entries) ** 2).sum(2)
            assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
    seen = vector_codes.Cells(entries)
    seen.nearest(parts)
    worked_out = seen.worked_out
    seen.nearest(parts[::-1].copy())
    assert seen.worked_out == worked_out


def codes_brute(rows, parts, entries, rounds):
    limit, kept = vector_codes.most(len(rows[0][1])), []
    for vec_id, v, label in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((vec_id, [int(max(-limit, min(limit, np.floor(256 * np.float64(x))))) for x in v], label))
    width = len(kept[0][1]) // parts
    first = sorted(k[:2] for k in kept if k[0] is not None)[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in kept:
                part = v[p * width : (p + 1) * width]
                mine[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k], strict=True)] if mine[k] else e for k, e in enumerate(books[p])]
    out, by_label = [], Counter()
    for vec_id, v, label in kept:
        found = [nearest(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((vec_id, label, "".join(f"{k:02x}" for _, k in found), error))
        by_label[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(*r, by_label[r[1]]) for r in out], digest


VECTORS = "vec_id long, embedding array<float>, label int, code string, v int"


@pytest.mark.parametrize(("n", "entries"), [(300, 8), (5, 64)])
def test_vector_codes(spark, n, entries):
    r = np.random.default_rng(n)
    rows = [(int(k) if k % 50 else None, r.normal(0, 0.3, 8).astype("f4").tolist(), int(k % 3) if k % 4 else None) for k in r.permutation(n)]
    rows += [(2, rows[0][1], 1), (2, rows[0][1], 1), (n + 1, [1e30] * 8, 2), (n + 2, [0.0] * 8, 2)]
    bad = [(n + 3, None, 1), (n + 4, [1.0] * 7 + [None], 1), (n + 5, [float("nan")] * 8, 1), (n + 6, [float("-inf")] * 8, None)]
    want, digest = codes_brute(rows, 4, entries, 2)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows + bad], VECTORS).repartition(3)
    coded, books = vector_codes.compress(df, 4, entries, 2)
    assert Counter(map(tuple, coded.collect())) == Counter(want) and vector_codes.digest(books) == digest


def test_vectors_of_other_lengths_and_none(spark):
    rows = [(k, [0.1 * k] * 8, 1, "", 1) for k in range(20)] + [(30, [1.0] * 4, 1, "", 1), (31, [], None, "", 1)]
    df = spark.createDataFrame(rows, VECTORS)
    coded, _ = vector_codes.compress(df, 4, 4, 2)
    got = {r.vec_id: r for r in coded.collect()}
    assert len(got) == 22 and got[30].code is None and got[31].label_error is None and got[3].code
    with pytest.raises(ValueError):
        vector_codes.compress(df, 3, 4, 2)
    coded, books = vector_codes.compress(df.limit(0), 4, 4, 2)
    assert coded.count() == 0 and books.size == 0
    nameless = df.withColumn("vec_id", F.lit(None).cast("long"))
    assert {r.code for r in vector_codes.compress(nameless, 4, 4, 2)[0].collect()} == {None}


def test_queries_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_fill_in_middle", "op12_best_fit_packing", "op13_vector_codes"):
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_dominance():
    fits = bin_completion._dominated
    assert fits({3: 1, 4: 1}, 1 << 7, 0) and not fits({3: 1, 4: 1}, 1 << 8, 0)
    assert fits({3: 1, 4: 1}, 1 << 8, 1) and fits({5: 1}, 1 << 6, 1) and not fits({5: 1}, 1 << 5, 1)
    for left, room in (({5: 2, 4: 1, 3: 3, 2: 2}, 9), ({7: 1, 1: 4}, 6)):
        every = [dict(zip(left, n, strict=True)) for n in itertools.product(*(range(m + 1) for m in left.values()))]
        every = [{w: n for w, n in e.items() if n} for e in every if sum(w * n for w, n in e.items()) <= room]
        got = [t for _, t in bin_completion.Fillings(left, room)(room)]
        others = [sum(1 << w for w in left if w <= room and left[w] > e.get(w, 0)) for e in every]
        waste = [room - sum(w * n for w, n in e.items()) for e in every]
        want = [e for e, o, s in zip(every, others, waste, strict=True) if not fits(e, o, s) and not (s and any(o >> k & 1 for k in range(1, s + 1)))]
        key = lambda t: sorted(t.items())
        assert all(key(t) in map(key, got) for t in want)

"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words are read into one automaton that knows every run of words of every item. A document's words are
streamed through it, which gives at each word the length of the longest run ending there that some item contains. Where
that length reaches ``window``, the last ``window`` words are an item's window; an item shorter than a window counts as
a whole. All words inside such occurrences are hit.

Only stretches whose neighbouring words are neighbours in some item, and that are long enough, can hold an occurrence;
numpy finds them, and the automaton reads nothing else. Equal items are one, with all their ids. Tasks pack them by size
into block files of at most ``block_words`` words in the shared folder (an item with more is a block of its own); of them
the driver sees only the names. One pass over the documents does all blocks: a worker turns texts into numbers by the
items' distinct words, holds at most ``HELD`` bytes of texts where there are several blocks, and builds one block's
automaton after the other for them. So it holds one automaton at a time, no shuffle is needed, and more blocks cost time
to build them once for each ``HELD`` bytes.

Defined results: a null or empty text has no words, no hits and no items; a very long text is held whole by its task; an
item without words never occurs; a repeated item counts once by its id, one with a null id is matched but not listed;
repeated documents are judged each on its own; other columns stay as they are, but for one named like ``found``, which is
replaced; ties do not arise, as all items that occur are listed.
"""

from __future__ import annotations

import re
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEEP = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
SLICE, HELD = 4_000_000, 64_000_000


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with A-Z lower-cased, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of every window marked at its state."""

    def __init__(self, items: list[tuple[list[str], str]], window: int, vocab: dict[bytes, int]):
        """``items`` are ids and text of each; ``vocab`` has a number for each of their words."""
        self.window, self.vocab = window, vocab
        self.next, self.link, self.length = [{}], [-1], [0]
        self.marks: dict[int, tuple[int, set]] = {}
        self.single: dict[int, set] = {}
        texts = [(i, [vocab[w] for w in words_of(t)]) for i, t in items]
        texts = [(i, t) for i, t in texts if t]
        longer = [(i, t) for i, t in texts if len(t) > 1 and window > 1]
        for i, t in texts:
            if len(t) == 1 or window == 1:
                for w in t:
                    self.single.setdefault(w, set()).update(i)
        for _, t in longer:
            last = 0
            for w in t:
                last = self._extend(last, w)
        for i, t in longer:
            self._mark(i, t)
        self.shortest = min([min(window, len(t)) for _, t in longer], default=0)
        n = len(self.vocab)
        pairs = [np.array(t[:-1], np.int64) * n + np.array(t[1:], np.int64) for _, t in longer]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.single_ids = np.array(sorted(self.single), np.int64)
        self.ends = self._ends()

    def _add(self, length: int, following: dict, link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that p reaches by w, made to hold no run longer than p's longest and w."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        c = self._add(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        s, p = self._add(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = s
            p = self.link[p]
        if p >= 0:
            self.link[s] = self._split(p, w)
        return s

    def step(self, s: int, n: int, w: int) -> tuple[int, int]:
        """The state and length of the longest known run that ends with w, after one of length n in state s."""
        while s and w not in self.next[s]:
            s = self.link[s]
            n = self.length[s]
        if w in self.next[s]:
            return self.next[s][w], n + 1
        return 0, 0

    def _mark(self, ids: list[str], words: list[int]) -> None:
        size, s, n = min(self.window, len(words)), 0, 0
        for k, w in enumerate(words):
            s, n = self.step(s, n, w)
            if k + 1 >= size:
                t = s
                while self.length[self.link[t]] >= size:
                    t = self.link[t]
                self.marks.setdefault(t, (size, set()))[1].update(ids)

    def _ends(self) -> list[tuple[int, ...]]:
        """For each state the marked states among itself and those it links to."""
        out: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            above = out[self.link[s]]
            out[s] = (s, *above) if s in self.marks else above
        return out

    def hits(self, ids: np.ndarray) -> list[tuple[int, int, set]]:
        """Occurrences (start, end, items) in a stream of word ids, of which -1 stands for all other words."""
        out = []
        if len(self.single_ids):
            out += [(int(k), int(k) + 1, self.single[int(ids[k])]) for k in np.flatnonzero(np.isin(ids, self.single_ids))]
        if not self.shortest or len(ids) < 2:
            return out
        codes = np.where((ids[:-1] < 0) | (ids[1:] < 0), -1, ids[:-1] * len(self.vocab) + ids[1:])
        at = np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)
        known = np.concatenate(([False], self.pairs[at] == codes, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        starts, stops = edges[::2], edges[1::2] + 1
        long = stops - starts >= self.shortest
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            s = n = 0
            for k, w in enumerate(ids[a:b].tolist(), a + 1):
                s, n = self.step(s, n, w)
                for t in self.ends[s]:
                    size, items = self.marks[t]
                    if size <= n:
                        out.append((k - size, k, items))
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one, in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def block_files(items: DataFrame, block_words: int) -> list[str]:
    """Names of files with all distinct items (item_id, text) that have words, each file of at most ``block_words``."""
    path = scratch(items.sparkSession, "items")
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    once = written(named.groupBy("text").agg(F.collect_set("item_id").alias("ids")), "distinct-items")
    most = once.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 1  # words

    def rows(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        held, n = [], 0

        def close():
            name = f"{uuid.uuid4().hex}.arrow"
            table = pa.table({"ids": pa.array([i for i, _ in held], pa.list_(pa.string())), "text": pa.array([t for _, t in held], pa.string())})
            with store.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_stream(out, table.schema) as writer:
                writer.write_table(table)
            return pa.RecordBatch.from_arrays([pa.array([name])], ["path"])

        for batch in batches:
            for ids, text in zip(batch.column("ids").to_pylist(), batch.column("text").to_pylist(), strict=True):
                size = len(words_of(text))
                if held and n + size > block_words:
                    yield close()
                    held, n = [], 0
                if size:
                    held.append((ids, text))
                    n += size
        if held:
            yield close()

    dealt = once.repartition(max(1, int(most // (16 * block_words))))
    return [f"{path}/{r.path}" for r in written(dealt.mapInArrow(rows, "path string"), "blocks").collect()]


def _items(name: str) -> list[tuple[list[str], str]]:
    store, path = fs.FileSystem.from_uri(name)
    with store.open_input_stream(path) as f, pa.ipc.open_stream(f) as reader:
        table = reader.read_all()
    return list(zip(table.column("ids").to_pylist(), table.column("text").to_pylist(), strict=True))


class Blocks:
    """The blocks of items as a worker sees them: the numbers of all words, and the automaton asked for last."""

    def __init__(self, names: list[str], window: int):
        self.names, self.window, self.vocab, self.last = names, window, {}, (None, None)
        for name in names:
            for _, text in _items(name):
                for w in words_of(text):
                    self.vocab.setdefault(w, len(self.vocab))

    def automata(self):
        for name in self.names:
            if self.last[0] != name:
                self.last = (None, None)
                self.last = (name, Automaton(_items(name), self.window, self.vocab))
            yield self.last[1]


_KNOWN: dict[str, Blocks] = {}


def _blocks(key: str, names: list[str], window: int) -> Blocks:
    """A worker's blocks of one query; those of the query before are let go."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Blocks(names, window)
    return _KNOWN[key]


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _numbers(column: pa.Array, vocab: dict[bytes, int]):
    """(first row, ids, starts) of slices of a column of texts: the numbers of all their words, with -1 for other words
    and after each text, and where each text starts."""
    first, held, n = 0, [], 0
    for k in range(len(column) + 1):
        if k == len(column) or n > SLICE:
            ids, sizes, get = [], [], vocab.get
            for t in held:
                words = words_of(t)
                sizes.append(len(words) + 1)
                ids.extend(map(get, words, repeat(-1)))
                ids.append(-1)
            yield first, np.array(ids, np.int32), np.cumsum([0, *sizes])
            first, held, n = k, [], 0
        if k < len(column):
            held.append(column[k].as_py())
            n += len(held[-1] or "")


def _scan(columns: list[pa.Array], blocks: Blocks) -> list[list[dict]]:
    """What occurs in each text of each column: n_words, spans and items."""
    slices = [(out, *part) for out, c in enumerate(columns) for part in _numbers(c, blocks.vocab)]
    found = [[{"n_words": 0, "spans": [], "items": []} for _ in range(len(c))] for c in columns]
    for out, first, _, starts in slices:
        for k, n in enumerate(np.diff(starts).tolist(), first):
            found[out][k]["n_words"] = n - 1
    for auto in blocks.automata():
        for out, first, ids, starts in slices:
            for a, b, items in auto.hits(ids.astype(np.int64)):
                k = int(np.searchsorted(starts, a, "right")) - 1
                one, start = found[out][first + k], int(starts[k])
                one["spans"].append((a - start, b - start))
                one["items"].append(items)
    for one in (x for column in found for x in column if x["spans"]):
        one["spans"] = [list(x) for x in merged(one["spans"])]
        one["items"] = sorted(set().union(*one["items"]))
    return found


def _cut(text: str, spans: list[list[int]]) -> str:
    at, out, last = [m.span() for m in WORD.finditer(text)], [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def with_hits(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    found: str = "_found",
    window: int = 10,
    block_words: int = 100_000,
    max_coverage: float | None = None,
) -> DataFrame:
    """``docs`` with the struct ``found``: n_words, spans of hit words [start, end), and ids of the items that occur.

    ``items`` has item_id and text. With ``max_coverage`` it is ``remove_hits``: the texts come out cut, without the rows
    that are mostly hit and without ``found``, so one Python worker does what two in a row would hold memory for."""
    names, key = block_files(items, block_words), uuid.uuid4().hex
    kept_fields = [f for f in docs.schema if f.name != found]
    schema = T.StructType(kept_fields + ([T.StructField(found, FOUND)] if max_coverage is None else []))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def finished(batch: pa.RecordBatch, out: list[dict]) -> pa.RecordBatch:
        rest = [(f.name, batch.column(f.name)) for f in kept_fields]
        if max_coverage is None:
            return pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(out, kind)], [n for n, _ in rest] + [found])
        n_hit, texts = [sum(b - a for a, b in x["spans"]) for x in out], batch.column(text)
        kept = [k for k, x in enumerate(out) if n_hit[k] <= max_coverage * max(x["n_words"], 1)]
        new = [_cut(texts[k].as_py(), out[k]["spans"]) if n_hit[k] else texts[k].as_py() for k in kept]
        at = pa.array(kept, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else c.take(at) for n, c in rest], [n for n, _ in rest])

    def rows(batches):
        blocks = _blocks(key, names, window)
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.column(text).nbytes
            if len(names) < 2 or n > HELD:
                yield from map(finished, held, _scan([b.column(text) for b in held], blocks))
                held, n = [], 0
        if held:
            yield from map(finished, held, _scan([b.column(text) for b in held], blocks))

    return docs.mapInArrow(rows, schema)


def judge(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids sorted, spans) of each row of ``docs`` (doc_id, text)."""
    df = with_hits(docs.select("doc_id", "text"), items, window=window)
    spans = F.col("_found.spans")
    return df.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0]).alias("n_hit"),
        F.array_sort("_found.items").alias("item_ids"),
        spans.alias("spans"),
    )


def remove_hits(docs: DataFrame, items: DataFrame, text: str = "text", window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without the hit spans of their texts, and without documents of which more than ``max_coverage`` of the
    words is hit. A span goes from the start of its first word to the end of its last."""
    return with_hits(docs, items, text, window=window, max_coverage=max_coverage)

"""Quality classifier: random-indexing word vectors pooled per document, then a small network with calibrated scores.

The at most ``VOCABULARY`` words that the whole corpus has most often have a vector each; a rarer word falls by its hash in one of
``TAIL`` buckets, and every word's shape (letters folded to their case, digits to 9, repeats to one) in one of ``SHAPES``.
Each of these has a sparse random index vector. Its context vector is the sum of the index vectors of the words beside it
over the whole corpus: each task sums its own words, and a grouped sum adds the tasks up, so the table that comes back has
one row per vector for a corpus of any size (at most ``VOCABULARY + TAIL + SHAPES`` rows of ``DIM`` numbers: 1.9 MB) and
can be broadcast. A document is the mean and the spread of its word vectors and the mean of its shape vectors. A network
with one hidden layer is trained in one task on at most ``max_train`` labelled rows, taken in the order of a hash of their
ids; that bound holds for the labels and again for the rows of documents with those ids, of which features alone travel. A
tenth of them are kept back to fit the temperature that divides its output.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out: their labels are never read. A score depends on the text only.

Defined results: a null or empty text has zero features and still gets a score; a very long text is held whole by its
task; repeated rows get the same score; words with equal counts are all in the vocabulary or none is, and labels with equal
hashes are taken by id, label and features; a document labelled both ways is learnt both ways; null labels are not used; with
labels of fewer than two kinds every score is the share of label 1, or 0.5 without labels; other columns stay as they are
in ``with_scores``, but for one named like the score, which is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


VOCABULARY, TAIL, SHAPES, DIM, NONZERO = 4_096, 8_192, 2_048, 32, 2
SLICE = 1_000_000
#: A task's counts go out when it has so many different words; a worker remembers so many words.
MOST_COUNTED, REMEMBERED = 400_000, 200_000
_SHAPE = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Numbers(dict):
    """The numbers of words: those of a list are numbered by their place, others by their hash after them."""

    def __init__(self, words: list[bytes], first: int, buckets: int):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.first, self.buckets = first, buckets

    def __missing__(self, word: bytes) -> int:
        k = zlib.crc32(word) % self.buckets + self.first
        if len(self) < REMEMBERED:
            self[word] = k
        return k


class Buckets:
    """The numbers of words and shapes: the vocabulary's words, then ``TAIL`` buckets, then ``SHAPES`` buckets."""

    def __init__(self, words: list[bytes]):
        self.n_words = len(words) + TAIL
        self.n = self.n_words + SHAPES
        self.words, self.shapes = Numbers(words, len(words), TAIL), Numbers([], self.n_words, SHAPES)

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each number the places of its nonzero entries and their signs."""
        r = np.random.default_rng(7)
        return r.integers(0, DIM, (self.n, NONZERO)), r.choice([-1, 1], (self.n, NONZERO))

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words and of their shapes of all texts in a row, and the number of words of each."""
        words, shapes, sizes = [], [], []
        for t in texts:
            mine = t.split()
            sizes.append(len(mine))
            words += map(self.words.__getitem__, mine)
            folded = np.frombuffer(t.translate(_SHAPE), np.uint8)
            keep = np.concatenate(([True], folded[1:] != folded[:-1])) if len(folded) else np.zeros(0, bool)
            shapes += map(self.shapes.__getitem__, folded[keep].tobytes().split())
        return tuple(np.array(x, np.int64) for x in (words, shapes, sizes))


def _slices(batch: pa.RecordBatch, text: str):
    held, n, column = [], 0, batch.column(text)
    for k, t in enumerate(column):
        held.append(bytes(t.as_buffer() or b"") if t.is_valid else b"")
        n += len(held[-1])
        if n > SLICE or k + 1 == len(column):
            yield held
            held, n = [], 0


def vocabulary(docs: DataFrame, text: str = "text", size: int = VOCABULARY) -> list[bytes]:
    """The at most ``size`` words that all rows together have most often, by their bytes: those with a count above the
    highest one that would bring more."""

    def counts(batches):
        seen = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])
        for batch in batches:
            for texts in _slices(batch, text):
                for t in texts:
                    seen.update(t.split())
                if len(seen) > MOST_COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    words = written(docs.select(text).mapInArrow(counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    least, above = 0, 0
    for r in words.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect():
        above += r.words
        if above > size:
            least = r.n
            break
    return sorted(bytes(r.word) for r in words.where(F.col("n") > least).collect())


def word_vectors(docs: DataFrame, words, text: str = "text") -> np.ndarray:
    """The vector of every number, from all rows of ``docs``; ``words`` is the broadcast vocabulary."""

    def context(batches):
        buckets = Buckets(words.value)
        places, signs = buckets.index_vectors()
        total, seen = np.zeros((buckets.n, DIM), np.int64), np.zeros(buckets.n, np.int64)
        for batch in batches:
            for texts in _slices(batch, text):
                of_words, of_shapes, sizes = buckets.ids(texts)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                beside = doc[1:] == doc[:-1]
                for ids in (of_words, of_shapes):
                    np.add.at(seen, ids, 1)
                    left, right = ids[:-1][beside], ids[1:][beside]
                    for a, b in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            np.add.at(total.reshape(-1), a * DIM + places[b, k], signs[b, k])
        some = np.flatnonzero(seen)
        columns = [pa.array(some), pa.array(seen[some]), *(pa.array(total[some, k]) for k in range(DIM))]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n", *(f"s{k}" for k in range(DIM))])

    schema = "bucket long, n long, " + ", ".join(f"s{k} long" for k in range(DIM))
    rows = docs.select(text).mapInArrow(context, schema).groupBy("bucket")
    summed = rows.agg(*(F.sum(c).alias(c) for c in ["n", *(f"s{k}" for k in range(DIM))])).toPandas()
    buckets = Buckets(words.value)
    sums, n = np.zeros((buckets.n, DIM)), np.zeros(buckets.n)
    sums[summed["bucket"]] = summed[[f"s{k}" for k in range(DIM)]].to_numpy(float)
    n[summed["bucket"]] = summed["n"]
    return vectors_of(buckets, sums, n)


def vectors_of(buckets: Buckets, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Vectors from context sums and counts: what all contexts share says nothing and goes, and each is of length one and
    has its own index vector added."""
    context = sums.copy()
    for part in (slice(0, buckets.n_words), slice(buckets.n_words, buckets.n)):
        context[part] -= n[part, None] * context[part].sum(axis=0) / max(n[part].sum(), 1)
    size = np.sqrt((context**2).sum(axis=1, keepdims=True))
    places, signs = buckets.index_vectors()
    own = np.zeros((buckets.n, DIM))
    for k in range(NONZERO):
        own[np.arange(buckets.n), places[:, k]] += signs[:, k]
    return (context / np.maximum(size, 1e-9) + own / NONZERO**0.5).astype(np.float32)


def pooled(texts: list[bytes], buckets: Buckets, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: mean and spread of its word vectors, and the mean of its shape vectors."""
    words, shapes, sizes = buckets.ids(texts)
    out = np.zeros((len(texts), 3 * DIM), np.float32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts, n = np.cumsum(sizes[some]) - sizes[some], sizes[some, None]
        v = vectors[words]
        mean = np.add.reduceat(v, starts) / n
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(np.add.reduceat(v * v, starts) / n - mean**2, 0))
        out[some, 2 * DIM :] = np.add.reduceat(vectors[shapes], starts) / n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def slopes(weights: list[np.ndarray], z: np.ndarray, target: np.ndarray, decay: float) -> list[np.ndarray]:
    """How the mean cross entropy of a network's output, with half of ``decay`` times the squares of its matrices, changes
    with each weight."""
    a = np.tanh(z @ weights[0] + weights[1])
    error = (_sigmoid(a @ weights[2] + weights[3]) - target) / len(target)
    inner = error[:, None] * weights[2] * (1 - a**2)
    return [z.T @ inner + decay * weights[0], inner.sum(axis=0), a.T @ error + decay * weights[2], error.sum(keepdims=True)]


def calibration_loss(logit: np.ndarray, y: np.ndarray, temperature: float) -> float:
    p = _sigmoid(logit / temperature)
    return float(-np.log(np.where(y == 1, p, 1 - p) + 1e-12).mean())


class Network:
    """One hidden layer over standardised features, and the temperature of its output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 16, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4):
        r = np.random.default_rng(11)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.trained = len(y) >= 20 and 0 < y.sum() < len(y)
        if not self.trained:
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        back = np.arange(len(y)) % 10 == 9
        weights = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), r.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.weights, self.temperature = weights, 1.0
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        z, target = self._standard(x[~back]), y[~back]
        for t in range(1, rounds + 1):
            part = r.permutation(len(target))[:2048]
            for w, g, (m, v) in zip(weights, slopes(weights, z[part], target[part], decay), moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        logit = self._logit(x[back])
        self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: calibration_loss(logit, y[back], t))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logit(self, x: np.ndarray) -> np.ndarray:
        a = np.tanh(self._standard(x) @ self.weights[0] + self.weights[1])
        return a @ self.weights[2] + self.weights[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logit(x) / self.temperature) if self.trained else np.full(len(x), self.prior)


def training_rows(docs: DataFrame, labels: DataFrame, words, vectors, label: str = "quality", max_train: int = 20_000) -> DataFrame:
    """(k, y, x): hash of the id, label and features of at most ``max_train`` labelled rows that are not held out."""
    mine = labels.select("doc_id", F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    mine = mine.where(~held_out(F.col("doc_id"))).dropDuplicates().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(mine), "doc_id").select("text", "y", F.xxhash64("doc_id").alias("k"))

    def features(batches):
        buckets = Buckets(words.value)
        for batch in batches:
            x = np.concatenate([pooled(t, buckets, vectors.value) for t in _slices(batch, "text")] or [np.zeros((0, 3 * DIM), np.float32)])
            blobs = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), blobs], ["k", "y", "x"])

    return sample.mapInArrow(features, "k long, y double, x binary").orderBy("k", "y", "x").limit(max_train)


def fit(rows: DataFrame) -> Network:
    """A network from ``training_rows``, learnt in one task."""

    def train(frames):
        rows = pd.concat(list(frames) or [pd.DataFrame({"k": [], "y": [], "x": []})]).sort_values(["k", "y", "x"])
        x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, 3 * DIM).astype(float)
        net = Network(x, rows["y"].to_numpy(float))
        parts = [*net.weights, net.mean, net.scale] if net.trained else []
        yield pd.DataFrame({"weights": [[p.ravel().tolist() for p in parts]], "temperature": [getattr(net, "temperature", 1.0)], "prior": [net.prior]})

    row = rows.repartition(1).mapInPandas(train, "weights array<array<double>>, temperature double, prior double").first()
    net = Network(np.zeros((0, 3 * DIM)), np.zeros(0))
    net.prior, net.trained, net.temperature = row.prior, bool(row.weights), row.temperature
    if net.trained:
        first, *rest, net.mean, net.scale = [np.array(w) for w in row.weights]
        net.weights = [first.reshape(3 * DIM, -1), *rest]
    return net


def with_scores(docs: DataFrame, labels: DataFrame, text: str = "text", score: str = "score", max_train: int = 20_000) -> DataFrame:
    """``docs`` with the column ``score``: 0 to 1, higher where label 1 is likelier."""
    sc = docs.sparkSession.sparkContext
    words = sc.broadcast(vocabulary(docs, text))
    vectors = sc.broadcast(word_vectors(docs, words, text))
    net = sc.broadcast(fit(training_rows(docs.select("doc_id", F.col(text).alias("text")), labels, words, vectors, max_train=max_train)))
    names = [c for c in docs.columns if c != score]

    def rows(batches):
        buckets = Buckets(words.value)
        for batch in batches:
            found = [net.value.score(pooled(t, buckets, vectors.value)) for t in _slices(batch, text)]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], [*names, score])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != score)
    return docs.mapInArrow(rows, f"{schema}, `{score}` double")

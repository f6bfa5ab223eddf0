"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax output.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled documents; scoring reads every text
whole. A document's average is linear in its words, so each distinct word's share of the two outputs is cached.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliref.llm.common import alone, chunks

BUCKETS, DIM = 1 << 16, 16
#: Character n-grams of a word between boundary signs.
GRAMS = (2, 3, 4)
#: Characters whose features are held at once; longer words are read in parts that overlap, so no n-gram is lost or doubled.
PART_CHARS = 1 << 18
#: The bound of the training sample, in documents.
MAX_TRAIN = 4000
CACHE_WORDS = 1_000_000
#: Characters of cached words after which the cache begins anew.
CACHE_CHARS = 16_000_000
#: A word like its predecessor also counts as this word.
REPEAT = "\x00repeat"


def _grams(marked: list[str], owners: list[int], starts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each string, and its owner. starts: only n-grams that begin before that place."""
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.array(owners, np.int64), [len(m) for m in marked])
    at, of = [], []
    for n in GRAMS:
        size = max(0, len(code) - n + 1)
        size = size if starts is None else min(size, starts)
        h = np.full(size, n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                h = (h ^ code[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        inside = owner[:size] == owner[n - 1 :][:size]
        at.append(h[inside])
        of.append(owner[:size][inside])
    return (np.concatenate(at) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(of)


def features(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of: buckets of the words and of all their character n-grams, and whose each is (the word's place in the list)."""
    import xxhash

    whole = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    yield (whole % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(words))
    marked, owners, size = [], [], 0
    for i, w in enumerate(words):
        if len(w) > PART_CHARS:
            m = f"<{w}>"
            for at in range(0, len(m), PART_CHARS):
                yield _grams([m[at : at + PART_CHARS + max(GRAMS) - 1]], [i], PART_CHARS)
            continue
        if marked and size + len(w) > PART_CHARS:
            yield _grams(marked, owners)
            marked, owners, size = [], [], 0
        marked.append(f"<{w}>")
        owners.append(i)
        size += len(w)
    if marked:
        yield _grams(marked, owners)


def tokens(text: str | None) -> list[str]:
    words = (text or "").split()
    return words + [REPEAT] * sum(map(eq, words, islice(words, 1, None)))


@dataclass
class Model:
    """vectors (BUCKETS, DIM), out (DIM,), bias: the softmax over two classes in terms of their difference."""

    vectors: np.ndarray
    out: np.ndarray
    bias: float

    def weights(self) -> np.ndarray:
        """Each bucket's share of the output."""
        return (self.vectors @ self.out).astype(np.float64)


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, rate: float = 1.0, seed: int = 13) -> Model:
    """counts: per document its buckets and how often each occurs. With one class or no document the score is constant."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), np.float32)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    bias = np.array([np.log(1 - share), np.log(share)], np.float32)
    usable = [i for i in range(len(labels)) if len(counts[i][0])]
    steps = max(1, epochs * len(usable))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(usable) if usable else []:
            lr = rate * (1 - done / steps)
            done += 1
            at, n = counts[i]
            w = (n / n.sum()).astype(np.float32)
            h = w @ vectors[at]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = out @ p
            out -= lr * np.outer(h, p)
            bias -= 0.1 * lr * p
            # hidden gradients are shared out by frequency, as the average is
            vectors[at] -= lr * np.outer(w * np.sqrt(len(at)), g)
    return Model(vectors, (out[:, 1] - out[:, 0]).copy(), float(bias[1] - bias[0]))


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    words = Counter(tokens(text))
    times, total = np.fromiter(words.values(), np.float64, len(words)), np.zeros(BUCKETS)
    for at, of in features(list(words)):
        total += np.bincount(at, times[of], BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int = MAX_TRAIN) -> Model:
    """Learns labels.quality from at most max_train documents for which `usable` (over doc_id) holds, drawn by a hash of doc_id.

    A document with several labels counts with its highest; null labels and identifiers are left out.
    """
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(usable)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            made = [_counted(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([n.tobytes() for _, n in made], pa.binary())],
                names=["doc_id", "quality", "at", "n"],
            )

    rows = sorted(texts.mapInArrow(kernel, "doc_id long, quality int, at binary, n binary").collect(), key=lambda r: (r["doc_id"], bytes(r["at"])))
    return train([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.float32)) for r in rows], np.array([int(r["quality"] >= 1) for r in rows], np.int64))


class Scores(dict):
    """Word -> its place in two arrays: its features' summed shares of the output, and their number. Begins anew when full."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias, self.chars = weights, bias, 0
        self.sums, self.numbers = np.zeros(CACHE_WORDS), np.zeros(CACHE_WORDS)

    def learn(self, words: list[str]) -> None:
        first = len(self)
        if first + len(words) > len(self.sums):  # within one batch it may grow
            self.sums, self.numbers = np.r_[self.sums, np.zeros(len(words))], np.r_[self.numbers, np.zeros(len(words))]
        self.sums[first : first + len(words)] = self.numbers[first : first + len(words)] = 0
        for at, of in features(words):
            self.sums[first : first + len(words)] += np.bincount(of, self.weights[at], len(words))
            self.numbers[first : first + len(words)] += np.bincount(of, minlength=len(words))
        self.chars += sum(map(len, words))
        self.update(zip(words, range(first, first + len(words))))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > CACHE_WORDS // 2 or self.chars > CACHE_CHARS:
            self.clear()
            self.chars = 0
        words = [tokens(t) for t in texts]
        if misses := sorted(set(chain.from_iterable(words)).difference(self)):
            self.learn(misses)
        sizes = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        text = np.repeat(np.arange(len(texts)), sizes)
        total, number = (np.bincount(text, v[at], len(texts)) for v in (self.sums, self.numbers))
        z = np.divide(total, number, out=np.zeros(len(texts)), where=number > 0) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


_WORKER: dict[str, Scores] = {}


def _scores(key: str, weights: np.ndarray, bias: float) -> Scores:
    """The worker's own, as a function of the module: a kernel's globals are copied for each task."""
    if key not in alone(_WORKER):
        _WORKER.clear()
        _WORKER[key] = Scores(weights, bias)
    return _WORKER[key]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1, higher: label 1 is likelier).

    Null and empty texts have no features and get the score of the bias, the share of label 1 that training saw.
    Repeated rows get equal scores; other columns are ignored; an empty table gives no rows.
    """
    weights = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast((weights, model.bias))  # BUCKETS numbers
    key = f"{hash(weights.tobytes())}:{model.bias}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(key, *shared.value)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, score double")


def held_out(column: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose score is at least threshold. Null and empty texts are scored by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights(), model.bias))
    key = f"{hash(shared.value[0].tobytes())}:{model.bias}"
    at = docs.columns.index(text_col)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(key, *shared.value)
        for batch in chunks(batches):
            yield batch.filter(pa.array(scores.score(batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(kernel, docs.schema)

"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network in numpy.

Words fall into a fixed number of buckets by hash, the form of a word (capitals, small letters, digits, marks, a word
said again) into a few more. Each bucket has a sparse ternary index vector. Over all documents, the context vector of a
bucket sums the index vectors of the two words before and the two words after each of its occurrences: sums of whole
numbers, so equal in any order. A document is the mean and the spread of the vectors of its words and the mean of
those of their forms. The network learns on at most ``2 * per_class`` labelled documents; a fifth of them is kept from it and sets the
temperature by which its outputs are divided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.labelled import remainder, sample
from tracewise.llm.words import LARGE_MEMO, blobs, text_batches

WORDS, FORMS, DIMS = 4096, 1024, 32
NONZERO = 4
NEAR = 2
PER_CLASS = 4000
BLOCK = 1 << 17
THRESHOLD = 0.3
PACK = 1 << 26  # two sums of whole numbers share a double: the second is this many times as heavy
PACKED_WORDS = 1 << 21  # a word adds less than 16 to a sum, so neither reaches into the other up to here
_TWICE = re.compile(rb"(.)\1+")
_KINDS = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("9") if 48 <= b <= 57 else b for b in range(256))
_AGAIN = WORDS  # the form of a word that repeats the one before


def form(word: bytes) -> bytes:
    """Its letters, digits and marks as kinds: ``The,`` is ``Aa,`` and ``of%%%`` is ``a%``."""
    return _TWICE.sub(rb"\1", word.translate(_KINDS))[:12]


class Buckets(dict):
    """(word bucket) + (WORDS + FORMS) * (form bucket) of a word; starts anew when it has seen many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= LARGE_MEMO:
            self.clear()
        kind = WORDS + 1 + xxhash.xxh64_intdigest(form(word)) % (FORMS - 1)
        both = self[word] = xxhash.xxh64_intdigest(word, 7) % WORDS + (WORDS + FORMS) * kind
        return both


def index_vectors() -> np.ndarray:
    """Sparse ternary vectors, the same in every process; the last row is zero and stands between documents."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS + FORMS + 1, DIMS), np.float32)
    for row in out[:-1]:
        row[rng.choice(DIMS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def blocks(texts: list[bytes], memo: Buckets) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, word buckets, form buckets, words of each text) of runs of texts of about BLOCK words."""
    first, held, sizes, total = 0, [], [], 0
    for i, text in enumerate(texts):
        words = text.split()
        held.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
        sizes.append(len(words))
        total += len(words)
        if total >= BLOCK or i == len(texts) - 1:
            both = np.concatenate(held)
            word, kind = both % (WORDS + FORMS), both // (WORDS + FORMS)
            size = np.array(sizes)
            again = np.concatenate(([False], both[1:] == both[:-1])) if len(both) else np.zeros(0, bool)
            starts = (np.cumsum(size) - size)[size > 0]
            again[starts] = False
            kind = np.where(again, _AGAIN, kind)
            yield first, word, kind, size
            first, held, sizes, total = i + 1, [], [], 0


def add_contexts(word: np.ndarray, kind: np.ndarray, size: np.ndarray, index: np.ndarray, sums: np.ndarray) -> None:
    """Add the index vectors near each word to the sums of its two buckets; two dimensions at a time, as whole numbers in one double."""
    gap = np.repeat(np.arange(len(size)) * NEAR, size) + np.arange(len(word)) + NEAR
    room, none = len(word) + NEAR * (len(size) + 1), len(index) - 1
    w, k = np.full(room, none), np.full(room, none)
    w[gap], k[gap] = word, kind
    near = np.zeros(room)
    step = 2 if len(word) < PACKED_WORDS else 1
    for d in range(0, DIMS, step):
        both = index[:, d].astype(np.float64)
        if step == 2:
            both += PACK * index[:, d + 1].astype(np.float64)
        own = both[w] + both[k]
        near[NEAR:-NEAR] = sum(own[NEAR + at:room - NEAR + at] for at in range(-NEAR, NEAR + 1) if at)
        found = (np.bincount(w, near, none + 1) + np.bincount(k, near, none + 1))[:none]
        if step == 2:
            second = np.rint(found / PACK)
            sums[:, d + 1] += second
            found -= PACK * second
        sums[:, d] += found


def context_vectors(docs: DataFrame) -> np.ndarray:
    """(WORDS + FORMS, DIMS) context vectors over all of ``docs``, each of length one.

    A task adds up its own documents and hands on one row for each bucket; the driver gets the sums of the buckets,
    of which there is a fixed number.
    """
    text_batches(docs.sparkSession)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, index, sums = Buckets(), index_vectors(), np.zeros((WORDS + FORMS, DIMS))
        for b in batches:
            for _, word, kind, size in blocks(blobs(b), memo):
                add_contexts(word, kind, size, index, sums)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, d]) for d in range(DIMS))],
                                         ["bucket", *(f"v{d}" for d in range(DIMS))])

    names = [f"v{d}" for d in range(DIMS)]
    rows = docs.select("text").mapInArrow(summed, ", ".join(["bucket long", *(f"{n} double" for n in names)]))
    vectors = np.zeros((WORDS + FORMS, DIMS), np.float32)
    for r in rows.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():
        v = np.array(r[1:])
        vectors[r[0]] = v / max(np.linalg.norm(v), 1e-9)
    return vectors


def pooled(texts: list[bytes], vectors: np.ndarray, memo: Buckets) -> np.ndarray:
    """(texts, 3 * DIMS + 1): mean and spread over words, mean over forms, and the length; zeros without words."""
    out = np.zeros((len(texts), 3 * DIMS + 1), np.float32)
    columns = np.ascontiguousarray(vectors.T)  # sums run along a dimension, so its numbers lie side by side
    for first, word, kind, size in blocks(texts, memo):
        some = np.flatnonzero(size)
        if not len(some):
            continue
        at, n = (np.cumsum(size) - size)[some], size[some, None]
        summed = np.empty((3, DIMS, len(some)), np.float32)
        for d, column in enumerate(columns):
            v = column[word]
            summed[0, d], summed[1, d] = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
            summed[2, d] = np.add.reduceat(column[kind], at)
        mean, squares, forms = (x.T / n for x in summed)
        spread = np.sqrt(np.maximum(squares - mean * mean, 0))
        out[first + some] = np.hstack((mean, spread, forms, np.log1p(n) / 5))
    return out


# ------------------------------------------------------------------ the network

class Network:
    """Standardized inputs, one hidden layer of rectified units, a logistic output divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 0.01):
        rng = np.random.default_rng(5)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        held = np.arange(len(z)) % 5 == 0
        self.p = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden),
                  rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        rows = np.flatnonzero(~held)
        for _ in range(epochs):
            rng.shuffle(rows)
            for at in range(0, len(rows), 64):
                part, t = rows[at:at + 64], t + 1
                h = z[part] @ self.p[0] + self.p[1]
                a = np.maximum(h, 0)
                d = (1 / (1 + np.exp(-np.clip(a @ self.p[2] + self.p[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (h > 0)
                for i, g in enumerate((z[part].T @ back, back.sum(axis=0), a.T @ d, d.sum(keepdims=True))):
                    g = g + 1e-4 * self.p[i]
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    self.p[i] = self.p[i] - rate * m[i] / (1 - 0.9**t) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        raw, want = self.raw(x[held]), y[held]
        if len(set(want.tolist())) == 2:
            grid = np.geomspace(0.25, 8, 60)
            self.temperature = float(min(grid, key=lambda g: np.logaddexp(0, np.where(want == 1, -raw, raw) / g).mean()))

    def raw(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.p[0] + self.p[1], 0)
        return h @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -50, 50)))


def learn(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, per_class: int, rows: Column) -> Network | None:
    """The network, or None where the labels that may be seen aren't of both kinds."""
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets()
        for b in batches:
            made = [x.tobytes() for x in pooled(blobs(b), vectors, memo)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(made, pa.binary())], ["doc_id", "y", "x"])

    seen = sample(docs, labels, "quality", per_class, rows).mapInArrow(features, "doc_id long, y int, x binary").collect()
    seen = sorted((r.doc_id, r.y, bytes(r.x)) for r in seen)
    if len({y for _, y, _ in seen}) < 2:
        return None
    return Network(np.stack([np.frombuffer(x, np.float32) for *_, x in seen]), np.array([y for _, y, _ in seen], float))


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of ``docs`` (doc_id, text, any more columns).

    Labels of held-out documents (crc32 of the id modulo 5 is 0) are never seen. A null or empty text is scored as a text of
    no words. Without labels of both kinds every score is 0.5. Repeated rows get equal scores; an empty table, no rows.
    """
    vectors = context_vectors(docs)
    network = learn(docs, labels, vectors, per_class, remainder("doc_id", 5) != 0)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Buckets()
        for b in batches:
            x = pooled(blobs(b), vectors, memo)
            score = np.asarray(network(x) if network else np.full(len(x), 0.5), np.float64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score)], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))

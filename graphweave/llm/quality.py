"""A quality classifier over random-indexing word vectors.

Every unit of text (a word, its ending, its shape) hashes to one of `UNITS` rows. A row has a sparse
random index vector, fixed by its number, and a context vector: the sum of the index vectors around
all its occurrences in the corpus. These sums are over all documents and are whole numbers, so their
order does not matter. A document is pooled to the means of its units' context and index vectors and to
what the pooled vectors' lengths tell of repetition: the more distinct the units, the more their random
vectors cancel. A two-layer network gives logits; a temperature fitted on labelled documents that the
network has not seen calibrates them to probabilities.

The network is fitted on at most `MAX_LABELLED` labelled documents, those of smallest hash, on the
driver; everything else is distributed.

Defined results: a null or empty text has no units and gets the score of that; documents with several
labels count with the smallest, null labels not at all; rows with the same doc_id are scored each by
itself; with no labels, or labels of one kind, all scores are the smoothed share of label 1; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import added_up, blocks, mix, rows, sampled, slices, table, texts, words_of, written

#: Rows of the vector table by kind, their length, non-zero entries of an index vector, words looked at on each side.
WORDS, ENDINGS, SHAPES, SIZE, NONZERO, WINDOW = 4096, 2048, 2048, 32, 4, 2
UNITS = WORDS + ENDINGS + SHAPES
_OF_KIND = [slice(0, WORDS), slice(WORDS, WORDS + ENDINGS), slice(WORDS + ENDINGS, UNITS)]
MAX_LABELLED, HIDDEN, EPOCHS, CALIBRATION = 20_000, 32, 40, 5
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: The bits of each byte value as eight counters of a byte each, and how many such can be added.
_BITS, _MOST = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0], 255
_PART = 256
#: Places of words whose surroundings are summed at once, few enough for a core's caches.
_CHUNK = 1 << 16
#: A double holds two whole numbers, the second one times this; their sums come out exact below half of it.
_PAIR = float(1 << 26)
_KIND = np.full(256, ord("."), np.uint8)  # letters, capitals, digits; other ASCII stands for itself
_KIND[:128] = np.arange(128)
_KIND[ord("a") : ord("z") + 1] = _KIND[128:] = ord("a")
_KIND[ord("A") : ord("Z") + 1] = ord("A")
_KIND[ord("0") : ord("9") + 1] = ord("0")


@cache
def index_vectors() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(7))
    out = np.zeros((UNITS, SIZE), np.float32)
    for row in out:
        row[rng.choice(SIZE, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return out


def units(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Start of each word, its units (word, ending, shape) as rows among those of their kind, and its whole hash."""
    starts, ends, whole = words_of(data)
    last = np.minimum(ends - starts, 3)
    tail = np.zeros(len(starts), np.uint64)
    for k in range(3):
        tail = tail * np.uint64(257) + np.where(last > k, data[np.maximum(ends - 1 - k, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
    head, close = _KIND[data[starts]].astype(np.uint64), _KIND[data[np.maximum(ends - 1, 0)]].astype(np.uint64)
    mid = _KIND[data[(starts + ends - 1) // 2]].astype(np.uint64)
    shape = head << np.uint64(24) | mid << np.uint64(16) | close << np.uint64(8) | np.minimum(ends - starts, 12).astype(np.uint64) // np.uint64(4)
    of = [(x % np.uint64(n)).astype(np.int64) for x, n in ((whole, WORDS), (mix(tail), ENDINGS), (mix(shape), SHAPES))]
    return starts, of, whole


def _blocks(batches):
    """ids, bytes and offsets, about a megabyte at once."""
    for b in slices(batches, 500):
        yield from blocks(b["doc_id"].to_pylist(), [x.encode("utf-8", "surrogatepass") for x in b["text"].to_pylist()])


def paired(vectors: np.ndarray) -> np.ndarray:
    """Rows of whole numbers by columns, two columns in one of doubles."""
    return np.ascontiguousarray((vectors[:, 0::2] + vectors[:, 1::2] * _PAIR).T)


def parted(columns: np.ndarray) -> np.ndarray:
    """The rows whose columns, or sums of them, are paired."""
    second = np.rint(columns / _PAIR)
    return np.stack([columns - second * _PAIR, second], 2).transpose(1, 0, 2).reshape(columns.shape[1], -1)


def sums_around(of: list[np.ndarray], n: np.ndarray, columns: list[np.ndarray]):
    """Sums of the index vectors around all words of documents of n words each, by kind of unit and row in it, a chunk of words at once.

    `columns` are the paired index vectors of each kind and, in a last row, zeros: such rows stand between documents.
    """
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(doc)) + (doc + 1) * WINDOW
    wide = [np.full(len(doc) + (len(n) + 1) * WINDOW, c.shape[1] - 1) for c in columns]
    for w, rows_ in zip(wide, of, strict=True):
        w[place] = rows_
    for i in range(WINDOW, len(wide[0]) - WINDOW, _CHUNK):
        j = min(i + _CHUNK, len(wide[0]) - WINDOW)
        near, at = [w[i - WINDOW : j + WINDOW] for w in wide], [w[i:j] for w in wide]
        sums = [np.empty_like(c) for c in columns]
        for k in range(SIZE // 2):
            own = reduce(np.add, (c[k].take(rows_) for c, rows_ in zip(columns, near, strict=True)))
            around = reduce(np.add, (own[x : x + j - i] for x in range(2 * WINDOW + 1) if x != WINDOW))
            for s, rows_ in zip(sums, at, strict=True):
                s[k] = np.bincount(rows_, around, s.shape[1])
        yield [parted(s)[:-1] for s in sums]


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vectors of all rows of units, over rows of doc_id and text."""
    schema = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])

    def work(batches):
        index, total = index_vectors(), np.zeros((UNITS, SIZE))
        columns = [paired(np.concatenate([index[kind], np.zeros((1, SIZE))])) for kind in _OF_KIND]
        for _, data, offsets in _blocks(batches):
            starts, of, _ = units(data)
            for sums in sums_around(of, np.diff(np.searchsorted(starts, offsets)), columns):
                for kind, s in zip(_OF_KIND, sums, strict=True):
                    total[kind] += s
        if total.any():
            yield rows(schema, range(UNITS // _PART), [TaskContext.get().partitionId()] * (UNITS // _PART), [x.tobytes() for x in np.split(total, UNITS // _PART)])

    sums = added_up(docs.select("doc_id", "text").mapInArrow(work, "block int, task int, sums binary"), "<f8")
    out = np.zeros((UNITS // _PART, _PART * SIZE))
    for part, data in sums.collect():  # UNITS * SIZE numbers, whatever the corpus
        out[part] = np.frombuffer(data)
    return out.reshape(UNITS, SIZE)


def sign_sums(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the 64 signs of each hash (bit set: 1, else -1) over the stretches that begin at `first`."""
    n = np.diff(np.append(first, len(hashes)))
    chunks = -(-n // _MOST)  # so many chunks of each stretch, in which no counter overflows
    begin = np.cumsum(chunks) - chunks
    place = np.arange(chunks.sum()) - np.repeat(begin, chunks)
    at = np.repeat(first, chunks) + place * _MOST
    counts = np.stack([np.add.reduceat(_BITS.take(b), at) for b in hashes.astype("<u8").view(np.uint8).reshape(-1, 8).T], 1)
    return 2 * np.add.reduceat(counts.view(np.uint8).reshape(-1, 64), begin, 0, dtype=np.int64) - n[:, None]


def features(docs: DataFrame, context: np.ndarray) -> DataFrame:
    """doc_id and x, the pooled vector of each row of doc_id and text."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])
    length = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = (context / np.maximum(length, 1)).astype(np.float32)

    def work(batches):
        both = np.concatenate([vectors, index_vectors()], 1)
        columns = [np.ascontiguousarray(both[kind].view(np.complex64).T) for kind in _OF_KIND]  # two columns are read and summed as one
        for ids, data, offsets in _blocks(batches):
            starts, of, whole = units(data)
            many = np.diff(np.searchsorted(starts, offsets))
            doc, n = np.repeat(np.arange(len(ids)), many), many.astype(np.float32)
            out = np.zeros((len(ids), 3 * 2 * SIZE + 5), np.float32)
            if len(starts):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                has = doc[first]
                for kind, (c, rows_) in enumerate(zip(columns, of, strict=True)):
                    sums = np.stack([np.add.reduceat(x.take(rows_), first) for x in c], 1)
                    out[has, kind * 2 * SIZE : (kind + 1) * 2 * SIZE] = sums.view(np.float32) / n[has, None]
                # words' own random signs: their sums are short where words are distinct, long where few words or windows repeat
                run = whole.copy()
                for k in range(1, 3):
                    run[:-k] += mix(whole[k:] + np.uint64(k))
                for j, h in enumerate((whole, run)):
                    sums = sign_sums(mix(h), first).astype(np.float32)
                    out[has, -5 + j] = np.log1p((sums**2).mean(1) / n[has])
                stutter = np.zeros(len(whole), np.float32)
                stutter[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
                out[has, -3] = np.add.reduceat(stutter, first) / n[has]
            out[:, -2] = np.log1p(n)
            out[:, -1] = n < 10
            yield rows(schema, ids, list(out))

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, x array<float>")


class Network:
    """Two layers in numpy; scores are probabilities of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = float((y.sum() + 1) / (len(y) + 2))
        self.layers = None
        if len(y) < 20 or y.min() == y.max():
            return
        rng = np.random.Generator(np.random.PCG64(1))
        seen = np.arange(len(y)) % CALIBRATION != 0
        if y[seen].min() == y[seen].max() or y[~seen].min() == y[~seen].max():
            seen[:] = True
        self.mean, self.scale = x[seen].mean(0), x[seen].std(0) + 1e-2
        z = (x - self.mean) / self.scale
        layers = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
        rows_ = np.flatnonzero(seen)
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(rows_), -(-len(rows_) // 256)):
                step += 1
                hidden = np.tanh(z[at] @ layers[0] + layers[1])
                error = (1 / (1 + np.exp(-(hidden @ layers[2] + layers[3]))) - y[at]) / len(at)
                back = np.outer(error, layers[2]) * (1 - hidden**2)
                slopes = [z[at].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
                for k, g in enumerate(slopes):
                    first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
                    layers[k] = layers[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.layers, self.temperature = layers, 1.0
        logits, truth = self.logits(x[~seen]) if (~seen).any() else self.logits(x), y[~seen] if (~seen).any() else y
        loss = lambda t: np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return (np.tanh((x - self.mean) / self.scale @ w + b) @ v + c) / self.temperature

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.prior) if self.layers is None else 1 / (1 + np.exp(-np.clip(self.logits(x), -50, 50)))


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of all documents, learnt from labels outside the held-out fold."""
    d = texts(docs)
    x = written(features(d, context_sums(d)))
    known = labels.filter(F.col("quality").isNotNull() & (fold() != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    some = sampled(known, "doc_id", MAX_LABELLED, known.count())
    got = x.join(some, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(MAX_LABELLED).select("quality", "x").toArrow()
    sample = np.array(got["x"].to_pylist(), np.float64) if got.num_rows else np.zeros((0, 1))
    network = Network(sample, np.array(got["quality"].to_pylist(), np.float64))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def work(batches):
        for b in batches:
            if b.num_rows:
                values = b["x"].flatten().to_numpy().reshape(b.num_rows, -1).astype(np.float64)
                yield rows(schema, b["doc_id"], b["held_out"], network.scores(values))

    scored = x.withColumn("held_out", fold() == HELD_OUT).select("doc_id", "held_out", "x").mapInArrow(work, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

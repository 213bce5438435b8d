"""A hashed maximum-entropy language model, trained and scored over whole corpora.

A token's probability is that of its class given the words before it, times that of the token in its
class given the word before it; both factors are softmaxes over weighted features.

- Classes: the most frequent tokens are classes of their own; all others, unseen ones too, fall into
  classes by their last two bytes. The features of a class are the last word, the word before it (a skip
  bigram) and both together, each hashed to a row of weights. The training documents are dealt to as
  many parts as there are updates. In each update the tasks sum observed and expected counts of every
  weight over a part, a shuffle adds them up, and the weights move along the gradient, scaled by the
  expected counts and damped by a logarithm. Every training token is seen by one update.
- Words in a class: a word's weight is its add-one frequency; on top of it every pair of frequent words
  that follow each other at least `LEAST` times has a weight of its own. Such pairs are counted by
  shuffle, so their number grows with the corpus. A pair's weight depends on the counts of its own context
  (word before, class) alone, so contexts are dealt to tasks that update the weights of all their pairs
  until expected meet observed counts, less an L1 penalty. Words without a weight keep their share.

Texts are read twice: to count words, and to encode them by the `HOT` most frequent words, which are two
bytes a token. All else works on the codes. Pair weights and the counts of rare words are joined by
shuffle with the documents that hold them; only what has a fixed bound goes to tasks: hot words, rows of
class weights, a normaliser for each context, the most frequent pairs, which so never meet in one task.
Words are told by hashes of 63 bits.

Defined results: a null or empty text is the end token alone; rows with the same doc_id are scored each
by itself; a null doc_id counts as an empty text when documents are dealt; without training documents all
counts are 0 and classes are equally likely; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import added_up, blocks, lowered, mix, rows, sampled, settings, slices, table, texts, words_of, written
from graphweave.plans.stages import discard

#: Classes of one frequent token each, classes by ending.
FREQUENT, ENDINGS = 48, 48
CLASSES = FREQUENT + ENDINGS
#: Codes of two bytes: hot words, then the rare ones of each ending; the code before the first token.
HOT, RARE, START = (1 << 16) - ENDINGS, (1 << 16) - ENDINGS, 1 << 16
#: Rows of words (the most frequent have their own, the rest is hashed to `SHARED` of them) and of two words.
WORD_ROWS, SHARED, PAIR_ROWS = 2048, 512, 4096
N_ROWS = 1 + 2 * (WORD_ROWS + 1) + PAIR_ROWS
#: Updates (and parts) of the class weights, their step, what smooths observed and expected counts.
UPDATES, STEP, SMOOTH = 6, 0.5, 1.0
#: Occurrences from which a pair has a weight, the penalty on it, updates of pair weights.
LEAST, PENALTY, PAIR_UPDATES = 2, 0.6, 12
#: Slots for the pairs that tasks hold, of which there are half as many at most.
SLOTS = 1 << 19
#: Tokens of which a task sums up counts before it sends them, and contexts whose classes are computed at once.
FLUSH, DENSE = 4_000_000, 1 << 13
FOLDS, HELD_OUT = 7, 2
_TOP = np.uint64(1 << 63)  # set in all word hashes, in no pair
_END = np.array([0xE0D], np.uint64) | _TOP
_WORD_BITS, _CLASS_BITS = 17, 7
_ANY_RARE = 1 << 16  # stands for all rare words of a class


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def tokens(batches):
    """Batches of 500 rows of text: batch rows, tokens of each, hashes and endings of all tokens. A row's last token is the end."""
    for b in slices(batches, 500):
        for places, data, offsets in blocks(list(range(b.num_rows)), [lowered(x) for x in b["text"].to_pylist()]):
            starts, ends, words = words_of(data)
            doc = np.searchsorted(offsets, starts, "right") - 1
            n = np.bincount(doc, minlength=len(places)) + 1
            hashes, ending = np.full(n.sum(), _END[0]), np.zeros(n.sum(), np.uint8)
            at = np.arange(len(words)) + doc
            hashes[at] = words | _TOP
            second = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)].astype(np.uint64), np.uint64(0))
            ending[at] = mix(data[np.maximum(ends - 1, 0)].astype(np.uint64) * np.uint64(257) + second) % np.uint64(ENDINGS)
            yield b, np.array(places), n, hashes, ending


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), ending and c of each word of rows of text, the end included."""
    schema = pa.schema([("word", pa.int64()), ("ending", pa.int32()), ("c", pa.int64())])

    def work(batches):
        held, size = [], 0

        def counted():
            words, ending = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, c = np.unique(words, return_index=True, return_counts=True)
            return rows(schema, word.view(np.int64), ending[first], c)

        for _, _, _, hashes, ending in tokens(batches):
            held.append((hashes, ending))
            size += len(hashes)
            if size >= FLUSH:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    found = docs.select("text").mapInArrow(work, "word long, ending int, c long")
    return found.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def most_frequent(table_: DataFrame, key: str, n: str, most: int) -> list:
    """The rows of largest n, `most` at most, found by a histogram so that tasks send no more than that in all."""
    level = F.floor(F.log2(n) * 32)
    sizes = sorted(table_.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True)
    taken, found = 0, []
    for k, size in sizes:
        if taken + size > most:  # of a level that does not fit whole, rows of smallest hash
            found += sampled(table_.filter(level == k), key, most - taken, size).collect() if taken < most else []
            break
        taken, least = taken + size, k
    if taken:
        found += table_.filter(level >= least).collect()
    return sorted(found, key=lambda r: (-r[n], r[key]))


def hot_words(counts: DataFrame) -> list[tuple[int, int, int]]:
    """word, ending and c of the most frequent words, `HOT` at most."""
    return [(r.word, r.ending, r.c) for r in most_frequent(counts, "word", "c", HOT)]


class Lexicon:
    """The hot words: their codes, classes, rows and logarithms of count + 1."""

    def __init__(self, hot: list[tuple[int, int, int]]):
        word, ending, c = (np.array(x, np.int64) for x in (zip(*hot, strict=True) if hot else ((), (), ())))
        order = np.argsort(word.view(np.uint64))
        self.words, self.codes, self.n = word.view(np.uint64)[order], order.astype(np.int32), len(hot)
        self.class_of = np.zeros(START + 1, np.int16)
        self.class_of[:RARE] = np.where(np.arange(RARE) < FREQUENT, np.arange(RARE) % FREQUENT, 0)
        self.class_of[FREQUENT : self.n] = FREQUENT + ending[FREQUENT:]
        self.class_of[RARE:START] = FREQUENT + np.arange(ENDINGS)
        code = np.arange(START + 1)
        own = WORD_ROWS - SHARED
        self.row_of = np.where(code < own, code, own + (mix(code.astype(np.uint64)) % np.uint64(SHARED)).astype(np.int64)).astype(np.int32)
        self.row_of[START] = WORD_ROWS
        self.count = np.zeros(START + 1)
        self.count[: self.n] = c
        self.log = np.log10(self.count + 1)

    def read(self, hashes: np.ndarray, ending: np.ndarray) -> np.ndarray:
        if not self.n:
            return (RARE + ending.astype(np.int64)).astype(np.uint16)
        at = np.minimum(np.searchsorted(self.words, hashes), self.n - 1)
        return np.where(self.words[at] == hashes, self.codes[at], RARE + ending.astype(np.int64)).astype(np.uint16)


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc (a number of the row), doc_id, held_out, part, codes (two bytes a token) and rare (hashes of the rare words in their order)."""
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("part", pa.int32()), ("codes", pa.binary()), ("rare", pa.binary())])

    def work(batches):
        for b, places, n, hashes, ending in tokens(batches):
            codes = lexicon.read(hashes, ending)
            ends = np.cumsum(n)
            rare = codes >= RARE
            left, before = hashes[rare], np.concatenate([[0], np.cumsum(rare)])
            cut = lambda x, at: [x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            at = np.concatenate([[0], ends])
            own = b.take(pa.array(places))
            yield rows(schema, own["doc"], own["doc_id"], own["held_out"], own["part"], cut(codes, at), cut(left, before[at]))

    d = docs.withColumn("doc", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(UPDATES)).cast("int"))
    return d.select("doc", "doc_id", "held_out", "part", "text").mapInArrow(work, "doc long, doc_id long, held_out boolean, part int, codes binary, rare binary")


def _read(batches, *columns: str):
    """Batches of documents with tokens: the columns, the first token's place of each document, codes of all."""
    for b in slices(batches, 2000):
        if b.num_rows:
            sizes = pa.compute.binary_length(b["codes"]).to_numpy() // 2
            codes = np.frombuffer(b"".join(b["codes"].to_pylist()), np.uint16).astype(np.int64)
            yield tuple(b[c] for c in columns), np.cumsum(sizes) - sizes, sizes, codes


def before(codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes one and two before each token, START where a document has none."""
    one = np.concatenate([[START], codes[:-1]])
    one[begin] = START
    two = np.concatenate([[START], one[:-1]])
    two[begin] = START
    return one, two


def contexts(lexicon: Lexicon, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The rows of both words before each token, as one number: tokens with the same have the same features."""
    return lexicon.row_of[one] * (WORD_ROWS + 1) + lexicon.row_of[two]


def feature_rows(context: np.ndarray) -> list[np.ndarray]:
    """The weight rows active beside row 0, the bias: last word, word before it, both hashed."""
    one, two = np.divmod(context, WORD_ROWS + 1)
    both = mix(context.astype(np.uint64)) % np.uint64(PAIR_ROWS)
    return [1 + one, 2 + WORD_ROWS + two, 3 + 2 * WORD_ROWS + both.astype(np.int64)]


def log_probabilities(weights: np.ndarray, active: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the probabilities of all classes."""
    z = weights[active[0]]
    for x in active[1:]:
        z += weights[x]
    z += weights[0]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _counts(coded: DataFrame, lexicon: Lexicon, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of each weight over the documents, added up by shuffle."""
    schema, width = pa.schema([("block", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())]), 512

    def work(batches):
        observed, expected, seen, held, size = np.zeros(N_ROWS * CLASSES), np.zeros((N_ROWS, CLASSES), np.float32), 0, [], 0

        def expect():
            context, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(context), DENSE):
                active = feature_rows(context[i : i + DENSE])
                p = np.exp(log_probabilities(weights, active))
                p *= n[i : i + DENSE, None].astype(np.float32)
                for x in (np.zeros_like(active[0]), *active):
                    order = np.argsort(x.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
                    first = np.flatnonzero(np.diff(x[order], prepend=-1))
                    expected[x[order[first]]] += np.add.reduceat(p[order], first, 0)

        for _, begin, _, codes in _read(batches):
            context, of = contexts(lexicon, *before(codes, begin)), lexicon.class_of[codes]
            for x in (0, *feature_rows(context)):
                observed += np.bincount(x * CLASSES + of, minlength=len(observed))
            held.append(context.astype(np.int32))
            seen, size = seen + len(codes), size + len(codes)
            if size >= FLUSH:
                expect()
                held, size = [], 0
        if size:
            expect()
        if seen:
            both = np.stack([observed.reshape(N_ROWS, CLASSES).astype(np.float32), expected], 1)
            parts = [both[i : i + width] for i in range(0, N_ROWS, width)]
            keep = [k for k, x in enumerate(parts) if x.any()]
            yield rows(schema, keep, [TaskContext.get().partitionId()] * len(keep), [parts[k].astype("<f4").tobytes() for k in keep])

    found = added_up(coded.mapInArrow(work, "block int, task int, sums binary"), "<f4")
    out = np.zeros((N_ROWS, 2, CLASSES))
    for block, sums in found.collect():  # N_ROWS rows, whatever the corpus
        x = np.frombuffer(sums, "<f4").reshape(-1, 2, CLASSES)
        out[block * width : block * width + len(x)] = x
    return out[:, 0], out[:, 1]


def trained(coded: DataFrame, lexicon: Lexicon, of: np.ndarray) -> np.ndarray:
    """Weights (rows, classes) after `UPDATES` updates, each over its part of the documents; `of` has the tokens of each class."""
    weights = np.zeros((N_ROWS, CLASSES), np.float32)
    weights[0] = np.log((of + 1) / (of + 1).sum())
    tasks = max(1, coded.rdd.getNumPartitions() // UPDATES)
    for k in range(UPDATES):
        observed, expected = _counts(coded.filter(F.col("part") == k).select("codes").coalesce(tasks), lexicon, weights)
        weights[1:] += STEP * np.log((observed[1:] + SMOOTH) / (expected[1:] + SMOOTH))
    return weights


def pairs_of(lexicon: Lexicon, codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Of each token the pair with the word before it: that word, the token's class, the token (all rare ones are one); -1 without a hot word before it."""
    word = np.where(codes < RARE, codes, _ANY_RARE)
    key = (one << _CLASS_BITS | lexicon.class_of[codes]) << _WORD_BITS | word
    return np.where(one < RARE, key, -1)


def pair_counts(coded: DataFrame, lexicon: Lexicon) -> DataFrame:
    """key and n of each pair."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def work(batches):
        held, size = [], 0
        for _, begin, _, codes in _read(batches):
            key = pairs_of(lexicon, codes, before(codes, begin)[0])
            held.append(key[key >= 0])
            size += len(held[-1])
            if size >= FLUSH:
                yield rows(schema, *np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if held:
            yield rows(schema, *np.unique(np.concatenate(held), return_counts=True))

    return coded.select("codes").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fitted_pairs(key: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys, counts and weights of the pairs of whole contexts (keys sorted), contexts and logarithms of their normalisers, all to base 10.

    share: of each key's word in its class, by frequency alone.
    """
    context = key >> _WORD_BITS
    first = np.flatnonzero(np.diff(context, prepend=-1))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    total = np.add.reduceat(n, first).astype(np.float64)
    own = (key & ((1 << _WORD_BITS) - 1) < RARE) & (n >= LEAST)
    key, n, share, group = key[own], n[own].astype(np.float64), share[own], group[own]
    weight = np.zeros(len(key))
    normaliser = lambda: 1 + np.bincount(group, share * (np.exp(weight) - 1), len(first))
    for _ in range(PAIR_UPDATES):
        expected = total[group] * share * np.exp(weight) / normaliser()[group]
        weight += np.log((n - PENALTY) / expected)
    z = np.log10(normaliser())
    has = np.bincount(group, minlength=len(first)) > 0
    return key, n.astype(np.int64), weight / math.log(10), context[first[has]], z[has]


def pair_weights(counts: DataFrame, lexicon: Lexicon, mass: np.ndarray) -> DataFrame:
    """key, n and value: of each pair its count and weight; of each context, as -1 - context, its normaliser. A context has at most as many pairs as a class has hot words."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("value", pa.float64())])

    def work(batches):
        def done(key, n):
            word, of = key & ((1 << _WORD_BITS) - 1), key >> _WORD_BITS & ((1 << _CLASS_BITS) - 1)
            key, n, weight, context, z = fitted_pairs(key, n, (lexicon.count[word] + 1) / (mass[of] + 1))
            return rows(schema, np.concatenate([key, -1 - context]), np.concatenate([n, np.zeros_like(context)]), np.concatenate([weight, z]))

        held, size = [], 0
        for b in batches:
            key, n = b["key"].to_numpy(), b["n"].to_numpy()
            held.append((key, n))
            size += len(key)
            if size < 200_000:
                continue
            key, n = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.searchsorted(key, key[-1] >> _WORD_BITS << _WORD_BITS)  # the last context may go on
            if last:
                yield done(key[:last], n[:last])
            held, size = [(key[last:], n[last:])], len(key) - last
        if size:
            yield done(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = counts.repartition(F.shiftright("key", _WORD_BITS)).sortWithinPartitions("key")
    return dealt.mapInArrow(work, "key long, n long, value double")


class HotPairs:
    """The weights of the most frequent pairs, for tasks: a slot holds one pair, of those that meet in it the most frequent one."""

    def __init__(self, found: list):
        """found: rows of key and value, the most frequent first."""
        self.keys, self.values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.float32)
        key = np.array([r.key for r in found], np.int64)
        slot, first = np.unique(self._slot(key), return_index=True)
        self.keys[slot], self.values[slot] = key[first], np.array([r.value for r in found])[first] if len(key) else []

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) % np.uint64(len(self.keys))).astype(np.int64)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held, and their weights (0 for others)."""
        slot = self._slot(key)
        held = (self.keys[slot] == key) & (key >= 0)
        return held, np.where(held, self.values[slot], 0)


class Model:
    """All that a task needs to score, but for most pairs and rare words: hot words and pairs, class weights, sizes of classes, normalisers of contexts, totals."""

    def __init__(self, lexicon: Lexicon, weights: np.ndarray, mass: np.ndarray, normalisers: np.ndarray, hot: HotPairs, total: int, distinct: int):
        self.lexicon, self.weights, self.normalisers, self.hot, self.total, self.distinct = lexicon, weights, normalisers, hot, total, distinct
        self.in_class = np.log10(mass + 1.0)


def fit(coded: DataFrame, counts: DataFrame, lexicon: Lexicon) -> tuple[Model, DataFrame]:
    """The model of the encoded training documents and their word counts, and the table of pair weights (key, n, value)."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    mass, of = np.zeros(CLASSES), np.zeros(CLASSES)  # tokens and distinct words of each class; tokens
    frequent = [int(x) for x in lexicon.words.view(np.int64)[lexicon.codes < FREQUENT]]
    for k, c, n in counts.filter(~F.col("word").isin(frequent)).groupBy("ending").agg(F.sum("c"), F.count(F.lit(1))).collect():
        mass[FREQUENT + k], of[FREQUENT + k] = c + n, c
    known = min(FREQUENT, lexicon.n)
    mass[:known], of[:known] = lexicon.count[:known] + 1, lexicon.count[:known]
    weights = trained(coded, lexicon, of)
    paired = written(pair_counts(coded, lexicon))
    pairs = written(pair_weights(paired, lexicon, mass))
    discard(paired)
    normalisers = np.zeros((START + 1, CLASSES), np.float32)
    # HOT * CLASSES rows at most
    z = pairs.filter("key < 0").select((-1 - F.col("key")).cast("int").alias("context"), F.col("value").cast("float").alias("z")).toArrow()
    normalisers[z["context"].to_numpy() >> _CLASS_BITS, z["context"].to_numpy() & ((1 << _CLASS_BITS) - 1)] = z["z"].to_numpy()
    pairs = pairs.filter("key >= 0")
    return Model(lexicon, weights, mass, normalisers, HotPairs(most_frequent(pairs, "key", "n", SLOTS // 2)), total, distinct), pairs


def _scored(coded: DataFrame, model: Model) -> DataFrame:
    """Per document what hot words, classes and contexts give."""
    types = "doc long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
    schema = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
    every = math.log10(model.total + model.distinct + 1)

    def work(batches):
        lexicon = model.lexicon
        for columns, begin, sizes, codes in _read(batches, "doc", "doc_id", "held_out"):
            one, two = before(codes, begin)
            of = lexicon.class_of[codes]
            context, place = np.unique(contexts(lexicon, one, two), return_inverse=True)
            value = np.empty(len(codes))
            # tokens in the order of their contexts, so that a slice of contexts is one of tokens
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(0, len(context) + DENSE, DENSE))
            for k, i in enumerate(range(0, len(context), DENSE)):
                at = order[cuts[k] : cuts[k + 1]]
                value[at] = log_probabilities(model.weights, feature_rows(context[i : i + DENSE]))[place[at] - i, of[at]]
            value /= math.log(10)
            value += model.hot.find(pairs_of(lexicon, codes, one))[1] - model.in_class[of] - model.normalisers[one, of]
            base = np.add.reduceat(lexicon.log[codes], begin)
            yield rows(schema, *columns, sizes, np.add.reduceat((codes < RARE).astype(np.int64), begin), base - sizes * every, base + np.add.reduceat(value, begin))

    return coded.select("doc", "doc_id", "held_out", "codes").mapInArrow(work, types)


def _asked(coded: DataFrame, lexicon: Lexicon, hot: HotPairs) -> DataFrame:
    """key and doc of each rare word and each pair of hot words of each document, but for the pairs that tasks hold."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def work(batches):
        for (doc, rare), begin, sizes, codes in _read(batches, "doc", "rare"):
            doc, n = doc.to_numpy(), pa.compute.binary_length(rare).to_numpy() // 8
            key = pairs_of(lexicon, codes, before(codes, begin)[0])
            some = (key >= 0) & (codes < RARE) & ~hot.find(key)[0]
            key = np.concatenate([key[some], np.frombuffer(b"".join(rare.to_pylist()), np.int64)])
            order = np.argsort(key)  # equal keys beside each other are compressed to little when they travel
            yield rows(schema, key[order], np.concatenate([np.repeat(doc, sizes)[some], np.repeat(doc, n)])[order])

    return coded.select("doc", "codes", "rare").mapInArrow(work, "key long, doc long")


def scores(docs: DataFrame, train: Column) -> DataFrame:
    """Scores of all documents by the model and by add-one word frequencies, both learnt from those where `train` holds."""
    d = texts(docs).withColumn("held_out", ~train)
    counts = written(word_counts(d.filter(train)))
    lexicon = Lexicon(hot_words(counts))
    with settings(docs.sparkSession, spark__sql__parquet__compression__codec="zstd"):
        coded = written(encoded(d, lexicon))
    model, pairs = fit(coded.filter("NOT held_out"), counts, lexicon)
    part = written(_scored(coded, model))
    zero = F.lit(0.0)
    known = pairs.select("key", zero.alias("logs"), F.col("value").alias("gain"), F.lit(0).alias("known")).unionByName(counts.select(F.col("word").alias("key"), F.log10(F.col("c") + 1.0).alias("logs"), zero.alias("gain"), F.lit(1).alias("known")))
    # keys are distinct on this side: it is the one to hash, however often a key is asked for
    found = _asked(coded, lexicon, model.hot).join(known.hint("shuffle_hash"), "key")
    more = found.groupBy("doc").agg(F.sum("known").alias("more"), F.sum("logs").alias("logs"), F.sum("gain").alias("gain"))
    done = part.join(more, "doc", "left")
    logs = F.coalesce("logs", zero)
    return done.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("score") + logs + F.coalesce("gain", zero)).alias("score"),
    )


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the documents that are not held out."""
    return scores(table(spark, sf_dir, "documents"), ~held_out())

"""Language of texts: scripts narrow the candidates, a Viterbi path over words labels spans.

A word is a run of letters, in lower case. Its script, found by code point ranges, leaves the languages
that are written in it; these are scored by the word's letter n-grams and the word itself, whose counts
by language are learnt from labelled documents. A Viterbi path over the words of a text, which pays
`SWITCH` whenever it changes the language, labels its spans; the language with the most letters in its
spans is that of the text. Most texts have one language throughout: where no stretch of words gains more
than a switch costs, the path is known without being searched; all others are searched, many texts at a
time.

Labels are learnt from about `LABELLED` documents of each language at most, chosen by hash, whole texts;
their counts are added by Spark and are as many as `BUCKETS` a language, however large the corpus is.

Defined results: a null text and one without a letter are `und` with score 0, as is every text where
nothing can be learnt; a null doc_id is hashed as empty text; repeated rows are scored alike; texts of
any length are labelled whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import mix, rows, slices, table, texts

FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
LABELLED = 5000
#: Hashed features, letters of the longest n-gram, cost of a change of language, most that a word can speak against a language.
BUCKETS, ORDERS, SWITCH, MOST = 1 << 16, 4, 8.0, 6.0
#: Share of a language's letters from which it counts as written in a script.
WRITTEN = 0.01
#: Texts that are labelled together, words that a worker remembers, places of a block of paths.
BATCH, WORDS, PLACES = 2000, 400_000, 1 << 21

# First code points of script ranges; a range ends where the next begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"),
    (0x0C80, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = tuple(sorted({name for _, name in SCRIPTS}))
_STARTS = np.array([start for start, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])

_RUNS = re.compile(r"[^\W\d_]+").findall
_STEPS = np.array([1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def runs(text: str | None) -> list[str]:
    """The words of a text; some may be numbers, such as fractions, which `described` tells apart."""
    return _RUNS(text.lower()) if text else []


def described(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters and script of each word, and where the features of each begin among all features, which are hashed.

    Features are the n-grams of up to `ORDERS` code points of the word between two marks, and the word.
    """
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.flatnonzero(points == 2)
    sizes = np.diff(np.append(first, len(points)))
    of = np.repeat(np.arange(len(words)), sizes)
    scripts = _SCRIPT[np.searchsorted(_STARTS, points[first + 1].astype(np.int64), "right") - 1]
    alone = np.array([w.isalpha() for w in words])
    count = np.where(alone, sizes - 2, 0)
    for k in np.flatnonzero(~alone):
        count[k] = sum(c.isalpha() for c in words[k])
    found, owner = [], []
    sums = np.zeros(len(points), np.uint64)
    for n in range(ORDERS):
        last = len(points) - n
        sums = sums[:last] + mix(points[n:] * _STEPS[n] + np.uint64(n))
        if n:  # single marks say nothing; no n-gram spans two words
            inside = of[:last] == of[n:]
            found.append(sums[inside])
            owner.append(of[:last][inside])
    place = (np.arange(len(points)) - first[of]).astype(np.uint64)
    found.append(np.add.reduceat(mix(points + (place << np.uint64(32))), first))
    owner.append(np.arange(len(words)))
    owner_ = np.concatenate(owner)
    order = np.argsort(owner_, kind="stable")
    hashed = (mix(np.concatenate(found)) % np.uint64(BUCKETS)).astype(np.int64)[order]
    return count, scripts, np.searchsorted(owner_[order], np.arange(len(words))), hashed


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Log probability of each feature by language, and whether a language is written in a script.
    weights: np.ndarray
    written_in: np.ndarray

    @staticmethod
    def of(languages: list[str], counts: np.ndarray) -> Model:
        """From counts by language of features, and of letters by script behind them."""
        features, letters = counts[:, :BUCKETS] + 0.1, counts[:, BUCKETS:]
        weights = np.log(features / features.sum(1, keepdims=True)).astype(np.float32)
        return Model(languages, np.ascontiguousarray(weights.T), (letters >= WRITTEN * np.maximum(letters.sum(1, keepdims=True), 1)).T)

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each word, and its score by language: 0 for the likeliest, -MOST at least."""
        count, scripts, begins, hashed = described(words)
        sums = np.add.reduceat(self.weights[hashed], begins, 0) / ORDERS
        possible = self.written_in[scripts]
        sums[~possible & possible.any(1, keepdims=True)] = -np.inf
        return count, np.maximum(sums - sums.max(1, keepdims=True), -MOST).astype(np.float32)


def learnt(docs: DataFrame) -> Model:
    """The model of documents with a lang, outside the held-out fold; `docs` may have other columns."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD_OUT))
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    shares = spark.createDataFrame([(k, lang, min(1.0, LABELLED / sizes[lang])) for k, lang in enumerate(languages)], "code int, lang string, share double")
    some = known.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("code", "text")
    width = BUCKETS + len(NAMES)
    schema = pa.schema([("code", pa.int32()), ("place", pa.int32()), ("n", pa.int64())])

    def work(batches):
        total: dict[int, np.ndarray] = {}
        for b in slices(batches, BATCH):
            met: dict[int, Counter[str]] = {}
            for code, text in zip(b["code"].to_pylist(), b["text"].to_pylist(), strict=True):
                met.setdefault(code, Counter()).update(runs(text))
            for code, times in met.items():
                if times:
                    n = np.fromiter(times.values(), np.int64, len(times))
                    count, scripts, begins, hashed = described(list(times))
                    own = total.setdefault(code, np.zeros(width, np.int64))
                    own += np.bincount(hashed, np.repeat(n, np.diff(np.append(begins, len(hashed)))), width).astype(np.int64)
                    own += np.bincount(BUCKETS + scripts, count * n, width).astype(np.int64)
        for code, own in total.items():
            place = np.flatnonzero(own)
            yield rows(schema, np.full(len(place), code), place, own[place])

    counts = np.zeros((len(languages), width))
    found = some.mapInArrow(work, "code int, place int, n long").groupBy("code", "place").agg(F.sum("n").alias("n")).toArrow()
    counts[found["code"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    return Model.of(languages, counts)


# Paths. A text is an array of places in a table of scores.


def path(scores: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, an array of words by languages, the language of each word on its best path; ties go to the earlier language."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
    hard = []
    for k, s in enumerate(scores):
        if not len(s):
            continue
        best = int(s.sum(0).argmax())
        # what the words of a stretch could gain elsewhere; a path that leaves `best` for it pays a switch at least
        gain = np.concatenate([[0], np.cumsum(s.max(1) - s[:, best], dtype=np.float64)])
        if s.shape[1] == 1 or (gain - np.minimum.accumulate(gain)).max() < SWITCH:
            out[k] = np.full(len(s), best)
        else:
            hard.append(k)
    hard.sort(key=lambda k: -len(scores[k]))
    i = 0
    while i < len(hard):
        longest = len(scores[hard[i]])
        some = hard[i : i + max(1, PLACES // longest)]
        for k, found in zip(some, _searched([scores[k] for k in some]), strict=True):
            out[k] = found
        i += len(some)
    return out


def _searched(scores: list[np.ndarray]) -> list[np.ndarray]:
    """Best paths of texts, the longest first: a step is taken in all of them at once."""
    sizes = np.array([len(s) for s in scores])
    longest, languages = int(sizes[0]), scores[0].shape[1]
    padded = np.zeros((longest, len(scores), languages), np.float32)
    for b, s in enumerate(scores):
        padded[: len(s), b] = s
    running = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts of more words than that
    switched, source = np.zeros(padded.shape, bool), np.zeros((longest, len(scores)), np.int16)
    value = padded[0].astype(np.float64)
    for t in range(1, longest):
        n = running[t]
        here = value[:n]
        source[t, :n] = here.argmax(1)
        away = here.max(1, keepdims=True) - SWITCH
        switched[t, :n] = away > here
        value[:n] = np.where(switched[t, :n], away, here) + padded[t, :n]
    state = value.argmax(1)
    found = np.zeros((longest, len(scores)), np.int16)
    place = np.arange(len(scores))
    for t in range(longest - 1, -1, -1):
        n = running[t]
        found[t, :n] = state[:n]
        if t:
            state[:n] = np.where(switched[t, place[:n], state[:n]], source[t, :n], state[:n])
    return [found[:n, b].astype(np.int64) for b, n in enumerate(sizes)]


class Labeller:
    """A worker's scores of the words that it met, and the spans of texts."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.letters, self.scores = np.zeros(0, np.int64), np.zeros((0, len(self.model.languages)), np.float32)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int, int]]]]:
        """Language, score and spans (language, first word, words, letters) of each text.

        The score is the share of letters in the language's spans, times its probability by the words of these spans.
        """
        if len(self.place) > WORDS:
            self._forget()
        words = [runs(t) for t in texts]
        new = list(dict.fromkeys(w for of in words for w in of if w not in self.place))
        if new and self.model.languages:
            letters, scores = self.model.scores(new)
            self.place.update(zip(new, range(len(self.letters), len(self.letters) + len(new)), strict=True))
            self.letters, self.scores = np.concatenate([self.letters, letters]), np.concatenate([self.scores, scores])
        elif not self.model.languages:
            return [(UNKNOWN, 0.0, [])] * len(texts)
        places = [np.fromiter(map(self.place.__getitem__, of), np.int64, len(of)) for of in words]
        places = [x[self.letters[x] > 0] for x in places]
        scores = [self.scores[x] for x in places]
        return [self._judged(p, s, x) for p, s, x in zip(path(scores), scores, places, strict=True)]

    def _judged(self, labels: np.ndarray, scores: np.ndarray, places: np.ndarray) -> tuple[str, float, list[tuple[str, int, int, int]]]:
        if not len(labels):
            return UNKNOWN, 0.0, []
        names, letters = self.model.languages, self.letters[places]
        by = np.bincount(labels, letters, len(names))
        best = int(by.argmax())
        sums = scores[labels == best].sum(0, dtype=np.float64)
        share = by[best] / by.sum() / np.exp(np.minimum(sums - sums[best], 700)).sum()
        begin = np.flatnonzero(np.diff(labels, prepend=-1))
        size = np.diff(np.append(begin, len(labels)))
        return names[best], float(share), [(names[labels[a]], int(a), int(n), int(m)) for a, n, m in zip(begin, size, np.add.reduceat(letters, begin), strict=True)]


def labelled(docs: DataFrame, model: Model, keep_spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if asked for, spans (lang, first_word, n_words, n_letters) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_letters", pa.int64())])
    schema = pa.schema([*fields, ("spans", pa.list_(span))] if keep_spans else fields)

    def work(batches):
        labeller = Labeller(shared.value)
        for b in slices(batches, BATCH):
            found = labeller.label(b["text"].to_pylist())
            columns = [b["doc_id"], b["held_out"], [x for x, _, _ in found], [x for _, x, _ in found]]
            yield rows(schema, *columns, *([[[dict(zip(("lang", "first_word", "n_words", "n_letters"), s, strict=True)) for s in x] for _, _, x in found]] if keep_spans else []))

    types = "doc_id long, held_out boolean, lang_pred string, score double"
    asked = texts(docs).withColumn("held_out", fold() == HELD_OUT)
    return asked.mapInArrow(work, f"{types}, spans array<struct<lang: string, first_word: long, n_words: long, n_letters: long>>" if keep_spans else types)


def op12_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return labelled(docs, learnt(docs), keep_spans=False)

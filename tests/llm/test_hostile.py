"""Null ids, clashing columns, very long texts and repeated rows, for the operators whose other tests have none."""

import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphweave.llm import ann, bpe, chat, common, packing, quality, rules
from tests.llm.test_operators import prose

LONG = prose(5, 60_000)


def test_bpe_of_null_ids_and_clashing_columns(spark):
    import tiktoken

    path, pattern = bpe.default_files()
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.Codec(path, pattern).ranks, special_tokens={})
    rows = [(None, "one", "a", 1), (None, "one", "a", 1), (3, LONG, "b", 2), (3, None, None, None)]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int"), path, pattern).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(library.encode_ordinary(t or ""))) for i, t, *_ in rows)


def test_neighbours_without_vec_id(spark):
    x = np.random.default_rng(8).normal(size=(50, 4))
    rows = [(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)] + [(None, [9.0] * 4, 0, "x")] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, list string")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and len(got) == 60 and all(r.vec_id is not None for r in got)
    floats = df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    one = {(r.query_id, r.vec_id): r.score for r in ann.nearest_neighbours(floats, F.col("vec_id") == 20, 5).collect()}
    y = x.astype(np.float32).astype(np.float64)
    assert all(s == pytest.approx(float(y[a] @ y[b]), abs=1e-12) for (a, b), s in one.items()) and len(one) == 5


def test_packing_of_null_ids_and_clashing_columns(spark):
    rows = [(None, "one", 1, 2), (None, "one", 1, 2), (4, LONG, 1, 2), (4, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, length long")
    got = packing.pack(df, *packing.default_files()).collect()
    assert sum(r.doc_id is None for r in got) == 2 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    encode = packing.encoding(*packing.default_files()).encode
    want = sorted((at, n, zlib.crc32(encode(LONG)[at : at + n])) for at, n in packing.cut(len(encode(LONG))))
    assert sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 4 and (r.start or r.length > 1)) == want


def test_chat_of_long_texts_and_clashing_columns(spark):
    rows = [(1, 0, "user", LONG, "a", 5), (1, 1, "assistant", LONG + "\n\\n</turn>", "b", 6), (1, 1, "assistant", LONG + "\n\\n</turn>", "b", 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns int")
    r = chat.read_back(chat.formatted(df)).first()
    assert [t.text for t in r.turns] == [x[3] for x in rows] and r.loss_texts == [rows[1][3]] * 2


def test_quality_of_long_texts_null_ids_and_clashing_columns(spark):
    rows, marks = [], []
    for i in range(120):
        text = prose(i, 30)
        rows.append((i, text if i % 3 else " ".join(f"{w}$$$" for w in text.split()), "x", 1))
        marks.append((i, int(i % 3 > 0), "x"))
    rows += [(None, LONG, "x", 1), (None, None, None, None), (7, LONG, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string, quality int")
    got = quality.classified(df, spark.createDataFrame([*marks, (None, 1, "x"), (7, 0, "x")], "doc_id long, quality int, text string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert sum(r.doc_id is None for r in got) == 2 and sum(r.doc_id == 7 for r in got) == 2


def test_scores_are_probabilities():
    """After the temperature, of documents scored p about a share p has label 1."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 6))
    y = (rng.random(6000) < 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1]))).astype(float)
    scores = quality.Network(x[:3000], y[:3000]).scores(x[3000:])
    for low in np.arange(0, 1, 0.2):
        some = (scores >= low) & (scores < low + 0.2)
        assert abs(scores[some].mean() - y[3000:][some].mean()) < 0.09


def test_ablation(spark):
    """Each rule's counts from the bits, one by one."""
    texts = [prose(1, 20), "few", "SHOUT " * 12, "a ! ! ! ! ! ! ! ! b c", prose(2, 12) + " # # # #", None, "1234 5678 " * 8]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, prose(3, 30), "x")] * 2, "doc_id long, text string, failed_bits string")
    book = rules.ledger(df)
    bits = [r.failed_bits for r in book.collect()]
    assert len(bits) == 9
    every, names = rules.mask("v1"), [n for n, _ in rules.RULES]
    for r in rules.ablation(book).collect():
        bit = 1 << names.index(r.rule)
        assert (r.fails, r.alone, r["without"]) == (sum(b & bit > 0 for b in bits), sum(b & every == bit for b in bits), sum(b & every & ~bit == 0 for b in bits))


@pytest.mark.parametrize("fan,levels", [(64, 3), (4, 3), (7, 2), (64, 1)])
def test_sums_of_many_tasks(spark, monkeypatch, fan, levels):
    """Arrays of 2,000 tasks, of which one block is sent by few; the tree's shape changes no sum."""
    monkeypatch.setattr(common, "FAN", fan)
    monkeypatch.setattr(common, "LEVELS", levels)
    sent = [(b, t, np.array([t, 1, -b], "<f8").tobytes()) for t in range(2000) for b in range(3) if b < 2 or t % 500 == 7]
    got = common.added_up(spark.createDataFrame(sent, "block int, task int, sums binary"), "<f8").collect()
    want = {0: [1999000, 2000, 0], 1: [1999000, 2000, -2000], 2: [3028, 4, -8]}
    assert len(got) == 3 and {r.block: np.frombuffer(r.sums).tolist() for r in got} == want
    assert common.added_up(spark.createDataFrame([], "block int, task int, sums binary"), "<f8").collect() == []


def test_groups_of_sums_are_bounded(spark, monkeypatch):
    """No group of any level but the last has more than FAN arrays, and the last one has 2,000 / FAN ** 2."""
    monkeypatch.setattr(common, "FAN", 10)
    one, sizes, frame = np.ones(1, "<f8").tobytes(), [], type(spark.range(1))
    group = frame.groupBy

    def watched(df, *keys):
        sizes.append(group(df, *keys).count().sort(F.desc("count")).first()["count"])
        return group(df, *keys)

    monkeypatch.setattr(frame, "groupBy", watched)
    rows = common.added_up(spark.createDataFrame([(0, t, one) for t in range(2000)], "block int, task int, sums binary"), "<f8").collect()
    assert np.frombuffer(rows[0].sums)[0] == 2000 and sizes == [10, 10, 20]


def test_context_vectors_do_not_depend_on_tasks(spark):
    docs = spark.createDataFrame([(k, f"some words {k} of text {k % 7} that vary {k % 3}") for k in range(400)], "doc_id long, text string")
    one, many = (quality.context_sums(docs.repartition(n)) for n in (1, 90))
    assert np.abs(one).sum() > 0 and np.array_equal(one, many)


@pytest.mark.parametrize("chunk", [1, 5, 1 << 16])
def test_context_vectors_are_sums_of_neighbours(spark, monkeypatch, chunk):
    """Against a loop over the words; chunks begin and end anywhere, also between documents."""
    monkeypatch.setattr(quality, "_CHUNK", chunk)
    texts = ["a b a b c", None, "", "one", " \n", "x x x x x x x x x", "two words", "Ünï 12,5 <|x|> END. end", prose(4, 60)]
    index, want, n = quality.index_vectors(), np.zeros((quality.UNITS, quality.SIZE)), []
    of = [[], [], []]
    for text in texts:
        starts, rows, _ = quality.units(np.frombuffer((text or "").encode() + b"\n", np.uint8))
        n.append(len(starts))
        whole = [[kind.start + r[i] for kind, r in zip(quality._OF_KIND, rows, strict=True)] for i in range(len(starts))]
        for i, at in enumerate(whole):
            near = [u for j in range(max(i - 2, 0), min(i + 3, len(whole))) if j != i for u in whole[j]]
            want[at] += index[near].sum(0)
        of = [[*have, *more] for have, more in zip(of, rows, strict=True)]
    columns = [quality.paired(np.concatenate([index[kind], np.zeros((1, quality.SIZE))])) for kind in quality._OF_KIND]
    got = sum(np.concatenate(s) for s in quality.sums_around([np.array(x) for x in of], np.array(n), columns))
    assert np.abs(want).sum() > 0 and np.array_equal(got, want)
    docs = spark.createDataFrame([(k, t or "") for k, t in enumerate(texts)], "doc_id long, text string")
    assert np.array_equal(quality.context_sums(docs.repartition(2)), want)


def test_sums_of_pairs_are_exact():
    """At the bound of a chunk: the largest sums around a word, of either sign, in both numbers of a pair."""
    most = 2 * quality.WINDOW * 3 * quality._CHUNK
    vectors = np.array([[most, -most], [-most, most], [most, most], [-most, -most], [0, -1], [-1, 0]], np.float64)
    assert most < quality._PAIR / 2 and np.array_equal(quality.parted(quality.paired(vectors)), vectors)


def test_quality_costs_little_more_than_its_words(monkeypatch):
    """CPU time of each pass over texts, in times of finding their words and units (18 where rows of 32 and 64 numbers were gathered a word)."""

    class Passed:
        def select(self, *_):
            return self

        def mapInArrow(self, work, _):
            self.work = work
            return self

        def collect(self):
            return []

    monkeypatch.setattr(quality, "added_up", lambda partials, _: partials)
    monkeypatch.setattr(quality, "TaskContext", type("", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))
    first, second = Passed(), Passed()
    context = quality.context_sums(first)
    quality.features(second, context)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(400)), "text": [prose(k, 400) for k in range(400)]})
    data = [d for _, d, _ in quality._blocks([batch])]

    def cost(call):
        spent = []
        for _ in range(3):
            begin = time.process_time()
            call()
            spent.append(time.process_time() - begin)
        return min(spent)

    words = cost(lambda: [quality.units(d) for d in data])
    assert all(cost(lambda p=p: list(p.work(iter([batch])))) < 5 * words for p in (first, second))

"""The operators against brute force on small hostile inputs: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave.llm import ann, bpe, chat, lines, lm, near_dup, packing, quality, rules, substrings


def words_of(text):
    return (text or "").encode().lower().split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    shared = prose(2, 40)
    texts = [base, base, " ".join(near), None, "", " \n\t", "one", "one", "Ünï cödé <|x|> # é", prose(3, 900), prose(4, 30) + "\n" + shared, shared + "\n" + prose(5, 30), "=" * 350, "ab" * 200, "x" * 3000, "LINE\n" * 30]
    return [(i, t, "en", f"s{i % 3}", 0, "clash") for i, t in enumerate(texts)]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_merges_as_the_library(spark, docs, none):
    import tiktoken

    path, pattern = bpe.default_files()
    c = bpe.Codec(path, pattern)
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(0)
    some = ["".join(rng.choice("ab  \n\t'sré1\x1c\x85<日!") for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["ab" * 4000, "z" * 5000]
    assert all(c.encode(x) == library.encode_ordinary(x) and c.decode(c.encode(x)) == x.encode() for x in some)
    got = by_id(bpe.round_trip(docs, path, pattern))
    for i, text, *_ in corpus():
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert by_id(bpe.decode(bpe.encode(docs, path, pattern), path, pattern))[8].data == corpus()[8][1].encode()
    assert bpe.round_trip(none, path, pattern).count() == 0


def components(texts):
    sets = {}
    for i, text in texts.items():
        w = words_of(text)
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = min(label[i], label[j])
    return sets, label


def test_near_duplicates(spark, docs, none):
    texts = {i: t for i, t, *_ in corpus()}
    sets, label = components(texts)
    got = by_id(near_dup.near_duplicates(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in texts}
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.representatives(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in texts if label[i] == i}


def test_near_duplicates_of_a_chain(spark):
    """Each text is near the next alone, so links must be found between texts that are not a bucket's leaders."""
    words = prose(9, 400).split()
    texts = {i: " ".join(words[8 * i : 8 * i + 120]) for i in range(30)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, label = components(texts)
    assert {i: r.component_id for i, r in by_id(near_dup.near_duplicates(df)).items()} == label


def test_near_duplicates_without_doc_id(spark):
    """A null doc_id names no component, and takes no copy of its text out of the component."""
    base, near, other, lone = prose(1, 60), prose(1, 60).split(), prose(2, 60), prose(3, 60)
    near[30] = "changed"
    changed = other.split()
    changed[30] = "changed"
    rows = [(None, base), (7, base), (9, base), (4, " ".join(near)), (None, other), (None, other), (None, " ".join(changed)), (None, lone), (None, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df).collect()
    assert sorted(tuple(r)[::2] + (r.kept,) for r in got if r.doc_id is not None) == [(2, 2, True), (4, 4, True), (7, 4, False), (9, 4, False)]
    assert sorted((r.component_id or 0, r.n_shingles) for r in got if r.doc_id is None) == [(0, 0), (0, 56), (0, 56), (0, 56), (0, 56), (4, 56)]
    assert not next(r for r in got if r.doc_id is None and r.component_id == 4).kept
    kept = [tuple(r) for r in near_dup.representatives(df).collect()]
    assert {x for x in kept if x[1] in (base, lone, None, "")} | {(4, " ".join(near))} == {(4, " ".join(near)), (None, lone), (None, None), (2, "")}
    # of texts that are near each other and have no doc_id one stays, all its copies being one document
    assert len({x for x in kept if x[1] in (other, " ".join(changed))}) == 1 and len(kept) in (5, 6)


def test_near_duplicates_of_repeated_doc_ids(spark):
    """A doc_id with several texts is one document with the links of all of them."""
    a, b = prose(1, 60), prose(2, 60)
    near = b.split()
    near[30] = "changed"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (7, " ".join(near)), (9, prose(3, 60)), (9, prose(3, 60)), (1, None), (9, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dup.near_duplicates(df).collect())
    assert got == [(1, 1, True, 0), (3, 3, True, 56), (5, 3, False, 56), (5, 3, False, 56), (7, 3, False, 56), (7, 3, False, 56), (9, 9, True, 0), (9, 9, True, 56), (9, 9, True, 56)]
    assert {r.doc_id for r in near_dup.representatives(df).collect()} == {1, 3, 9}


def test_line_dedup(spark, none):
    rows = [(i, f"own {i}\nCookies \n\n only here {i}", f"s{i}") for i in range(12)] + [(12, None, None), (13, "Cookies", "s1"), (14, "", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(lines.dedup_lines(df, 10))
    assert got[0].n_removed == 0 and got[0].kept_text == rows[0][1]
    assert got[5].kept_text == "own 5\n\n only here 5" and got[5].n_lines == 4
    assert (got[12].kept_text, got[12].n_lines, got[13].kept_text) == ("", 1, "")
    assert {r.doc_id for r in lines.cleaned(df, 10).collect()} == set(range(15)) - {13}
    assert all(r.n_removed == 0 for r in lines.dedup_lines(df, 13).collect())
    assert lines.dedup_lines(none).count() == 0


def test_line_dedup_of_null_and_repeated_ids_and_clashing_names(spark):
    """The first occurrence has the smallest doc_id, null the smallest of all; equal rows are one document; a long text is cut whole."""
    long = "\n".join(["Cookies", *map(str, range(20_000)), "Cookies"])
    texts_ = [(None, "Cookies\nnull", "s0"), (3, "Cookies\nthree", "s1"), (3, "more\nCookies", "s2"), (3, "more\nCookies", "s2"), (4, long, None)]
    rows_ = [(i, t, s, 1, [2], "c", "d", "e") for i, t, s in texts_ + [(i, f"Cookies\n{i}", f"s{i}") for i in range(10, 16)]]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string, row int, keys array<int>, places string, line string, tag string")
    got = {(r.doc_id, r.row.text): (r.kept_text, r.n_removed) for r in lines.dedup_lines(df, 9).collect()}
    assert got[None, "Cookies\nnull"] == ("Cookies\nnull", 0) and got[3, "Cookies\nthree"] == ("three", 1)
    assert got[3, "more\nCookies"] == ("more", 1) and got[4, long] == ("\n".join(map(str, range(20_000))), 2)
    assert all(got[i, f"Cookies\n{i}"] == (str(i), 1) for i in range(10, 16))
    assert all(r.n_removed == 0 for r in lines.dedup_lines(df, 11).collect())
    assert lines.cleaned(df, 9).columns == df.columns and lines.cleaned(df, 9).count() == len(rows_)


@pytest.mark.parametrize("hot", [lm.HOT, 30, 0])
def test_lm(spark, docs, none, monkeypatch, hot):
    """Counts and base against plain Python; with few hot words most are counted through the join."""
    monkeypatch.setattr(lm, "HOT", hot)
    got = by_id(lm.scores(docs, ~lm.held_out()))
    train = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in corpus()}
    for i, text, *_ in corpus():
        if not held[i]:
            train.update([*words_of(text), b""])
    n, v = sum(train.values()), len(train)
    for i, text, *_ in corpus():
        tokens, r = [*words_of(text), b""], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(t in train for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score < 0
    if hot:
        assert lm.scores(none, ~lm.held_out()).count() == 0
        assert {round(r.base_score, 9) for r in lm.scores(docs, F.lit(False)).collect()} == {0.0}


def test_lm_score_is_that_of_its_weights(spark, monkeypatch):
    """Every document's score from the weights one by one; all words of a context have a probability of 1 together."""
    monkeypatch.setattr(lm, "HOT", 60)
    monkeypatch.setattr(lm, "SLOTS", 32)
    rng = random.Random(3)
    phrases = [prose(i, 4) for i in range(30)]
    texts_ = {i: " ".join(rng.choice(phrases) for _ in range(rng.randint(0, 12))) + (" rare" + str(i) if i % 3 else "") for i in range(120)} | {500: "Word " * 300}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts_.items()] + [(None, None, "x"), (7, "seven", "x")], "doc_id long, text string, codes string").repartition(3)
    d = lm.texts(df).withColumn("held_out", lm.held_out())
    counts = lm.written(lm.word_counts(d.filter("NOT held_out")))
    lexicon = lm.Lexicon(lm.hot_words(counts))
    coded = lm.written(lm.encoded(d, lexicon))
    model, pairs = lm.fit(coded.filter("NOT held_out"), counts, lexicon)
    gain, count = {r.key: r.value for r in pairs.collect()}, {r.word: (r.ending, r.c) for r in counts.collect()}
    assert lexicon.n == 60 and len(gain) > 20 and 5 < (model.hot.keys >= 0).sum() <= 16
    own = {int(w): int(c) for w, c in zip(lexicon.words.view(np.int64), lexicon.codes)}

    def code_of(word):
        batch = lm.pa.RecordBatch.from_pydict({"text": [word]})
        _, _, _, hashes, ending = next(lm.tokens([batch]))
        h = int(hashes.view(np.int64)[0])
        return h, own.get(h, lm.RARE + int(ending[0]))

    mass = 10.0**model.in_class - 1
    memo = {w: code_of(w) for t in texts_.values() for w in t.split()} | {"seven": code_of("seven")}
    end = int(lm._END.view(np.int64)[0])

    def value(text):
        total, one, two = 0.0, lm.START, lm.START
        for h, code in [memo[w] for w in text.split()] + [(end, own[end])]:
            of = int(lexicon.class_of[code])
            z = sum(model.weights[r[0]].astype(float) for r in lm.feature_rows(lm.contexts(lexicon, np.array([one]), np.array([two])))) + model.weights[0]
            total += (z[of] - np.log(np.exp(z).sum())) / math.log(10)
            total += math.log10((count.get(h, (0, 0))[1] + 1) / (mass[of] + 1)) - model.normalisers[one, of]
            if one < lm.RARE and code < lm.RARE:
                total += gain.get((one << 7 | of) << 17 | code, 0.0)
            one, two = code, one
        return total

    got = lm.scores(df, ~lm.held_out()).collect()
    assert len(got) == len(texts_) + 2
    for r in got:
        text = texts_.get(r.doc_id, "") if r.n_tokens != 2 or r.doc_id != 7 else "seven"
        assert r.score == pytest.approx(value(text), rel=1e-4)
    held = [r for r in got if r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)
    # what the words of a class share out in a context, unseen ones included
    for one in {k >> 24 for k in gain}:
        for of in range(lm.CLASSES):
            shares = [((c + 1) / (mass[of] + 1), gain.get((one << 7 | of) << 17 | own[w], 0.0) if w in own else 0.0) for w, (e, c) in count.items() if (int(lexicon.class_of[own[w]]) if w in own else lm.FREQUENT + e) == of]
            unseen = 1 - sum(p for p, _ in shares)
            assert (sum(p * 10**g for p, g in shares) + unseen) / 10.0 ** model.normalisers[one, of] == pytest.approx(1, abs=1e-3)


def test_lm_pairs_meet_their_counts():
    key = (5 << 24 | 3 << 17) + np.array([1, 2, 9, 65536])
    n = np.array([40, 10, 1, 30])
    share = np.array([0.1, 0.2, 0.05, 0.3])
    kept, m, weight, context, z = lm.fitted_pairs(key, n, share)
    assert list(kept & 0xFFFF) == [1, 2] and list(m) == [40, 10] and list(context) == [5 << 7 | 3]
    p = share[:2] * 10**weight / 10 ** z[0]
    assert 81 * p == pytest.approx([40 - lm.PENALTY, 10 - lm.PENALTY], rel=0.02)


def removed(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        mask = bytearray(len(data))
        for j in range(len(data) - 99):
            s = data[j : j + 100]
            if s in seen:
                mask[j : j + 100] = b"\1" * 100
            seen.add(s)
        out[i] = (len(data), sum(mask), sum(1 for j in range(len(data)) if mask[j] and (not j or not mask[j - 1])), bytes(b for b, m in zip(data, mask) if not m))
    return out


@pytest.mark.parametrize("group", [1000, 1])
def test_substrings(spark, docs, none, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    want = removed({i: t for i, t, *_ in corpus()})
    got = by_id(substrings.without_repeats(docs))
    assert {i: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for i, r in got.items()} == want
    if group > 1:
        assert substrings.without_repeats(none).count() == 0
        kept = substrings.cleaned(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} >= {0, 3, 4, 6, 9}


def test_substrings_of_null_and_repeated_ids(spark):
    """Texts of one doc_id, or of none, are told apart; equal rows repeat nothing of each other."""
    a, b = prose(7, 40), prose(8, 40)
    df = spark.createDataFrame([(None, a), (None, a), (None, a + " " + b), (5, b), (5, b), (5, "y" + b), (6, b[:150] + a), (6, "x" + b), (6, a * 2)], "doc_id long, text string")
    tags = {r.text: r.tag for r in df.select("text", F.xxhash64("text").alias("tag")).collect()}
    documents, least = {(i, t) for i, t in ((r.doc_id, r.text) for r in df.collect())}, {}
    place = lambda i, t, j: (-1 if i is None else i, j, tags[t])
    for i, t in documents:
        for j in range(len(t) - 99):
            least[t[j : j + 100]] = min(least.get(t[j : j + 100], (99,)), place(i, t, j))
    want = {}
    for i, t in documents:
        gone = {k for j in range(len(t) - 99) if least[t[j : j + 100]] != place(i, t, j) for k in range(j, j + 100)}
        want.setdefault((i, len(t)), []).append("".join(c for k, c in enumerate(t) if k not in gone))
    got = {}
    for r in substrings.without_repeats(df).distinct().collect():
        got.setdefault((r.doc_id, r.n_bytes), []).append(bytes(r.kept).decode())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_suffixes_come_in_order():
    rng = np.random.default_rng(2)
    for _ in range(20):
        data = bytes(rng.integers(97, 100, 300).astype(np.uint8)) + b"a" * 150
        data += data[:200] + b"\xff"
        at = np.unique(rng.integers(0, len(data) - 101, 80))
        order = substrings.suffix_order(np.frombuffer(data, np.uint8), at)
        strings = [data[i : i + 100] for i in order]
        assert sorted(order) == list(at) and strings == sorted(strings)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8)) * rng.uniform(0.5, 2, (400, 1))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)] + [(900, None, 1), (920, [0.0] * 8, 1), (940, [None] + [1.0] * 7, 1), (960, [float("nan")] * 8, 1), (980, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 400, 20))
    for q, rows_ in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:20]
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert [r[2] for r in rows_] == pytest.approx([score[r[1]] for r in rows_])
        hits += len({r[1] for r in rows_} & set(best.tolist()))
    assert hits / (20 * len(found)) >= 0.9
    assert ann.nearest_neighbours(df.filter("false"), F.lit(True)).count() == 0
    assert ann.nearest_neighbours(df.filter("vec_id < 3"), F.lit(True)).count() == 6


@pytest.mark.parametrize("times", [2, 30])
def test_neighbours_of_repeated_rows(spark, times):
    """Rows of one vec_id are one candidate, and take no other's place."""
    x = np.random.default_rng(5).normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] * times, "vec_id long, embedding array<double>")
    found, hits = {}, 0
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(range(0, 300, 20))
    for q, ids in found.items():
        score = x @ x[q]
        score[q] = -np.inf
        assert len(set(ids)) == len(ids) == 20
        hits += len(set(ids) & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(found)) >= 0.9


def test_neighbours_over_many_lists(spark, monkeypatch):
    """Many lists, blocks and chunks, a list larger than a block, unit vectors in clusters: recall, and how much of the lists is read."""
    for name, value in (("PER_LIST", 20), ("BLOCKS", 8), ("LEAST_BLOCK", 100), ("MOST_BLOCK", 300), ("CHUNK", 16)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 16))[rng.integers(0, 60, 2000)] + 0.4 * rng.normal(size=(2000, 16))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[500:1100] = x[500]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    v, index = ann.fitted(df)
    assert len(index.centroids) >= 64 and sorted(index.order) == list(range(len(index.centroids)))
    row, _ = index.probed(x[::20].astype(np.float64), np.ones(len(index.centroids), np.int64), 1)
    share = np.bincount(row).mean() / len(index.centroids)
    found = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y, hits = x.astype(np.float64), 0
    assert set(found) == set(range(0, 2000, 20))
    for q, got in found.items():
        score = y @ y[q]
        score[q] = -np.inf
        got.sort()
        assert [s for _, _, s in got] == pytest.approx([score[i] for _, i, _ in got], abs=1e-12) and len(got) == 20
        hits += sum(s >= np.sort(score)[-20] - 1e-9 for _, _, s in got)
    assert hits / (20 * len(found)) >= 0.9 and share < 0.7
    # of the 600 equal vectors the smallest ids are taken, though they lie in several blocks
    assert [i for _, i, _ in found[600]] == list(range(500, 520))


def test_packing(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, pattern = packing.default_files()
    library, got, filled = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, {}
    for r in packing.pack(docs, path, pattern).collect():
        got[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for i, text, *_ in corpus():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want |= {(i, k): (at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids)))}
    assert got == want
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) <= -(-sum(n for _, n, _ in want.values()) // 1024) + 1
    assert packing.pack(none, path, pattern).count() == 0


def test_packing_takes_ids_as_tokenizers(spark):
    """Added tokens have their own ids, and no text is too much for the splitter."""
    import public_tokenizers
    from tokenizers import Tokenizer

    end = "<|endoftext|>"
    texts = [f"hello {end} world", end, f"{end}{end}", f"a {end}\n b<|endoftext|", " " * 1_000_000, "\n" * 1_000_000 + "x", "z" * 5000 + end + " tail"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *packing.default_files()).collect()}
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want |= {(i, k): (at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids)))}
    assert got == want


def test_crossover_loses_and_doubles_nothing():
    rng = random.Random(1)
    sizes = [rng.randint(1, 1023) for _ in range(300)]
    best = packing.evolved(sizes, [], 3)[0]
    assert sorted(i for b in best for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in best)
    assert len(best) <= len(packing.best_fit([], sorted(range(300), key=lambda i: -sizes[i]), sizes))


def test_evolution_beats_best_fit_decreasing():
    """Triplets that fill a bin to the last token: best fit wastes a tenth of the bins, evolution next to none."""
    rng, sizes = random.Random(5), []
    for _ in range(100):
        a = rng.randint(390, 500)
        b = rng.randint(256, (1024 - a) // 2)
        sizes += [a, b, 1024 - a - b]
    plain = packing.best_fit([], sorted(range(300), key=lambda i: -sizes[i]), sizes)
    first = packing.evolved(sizes, [], 3)
    best = packing.evolved(sizes, [*first[:2], *packing.evolved(sizes, [], 4)[:2]], 5)[0]
    assert sorted(i for b in best for i in b) == list(range(300)) and all(sum(sizes[i] for i in b) <= 1024 for b in best)
    assert len(plain) >= 110 and len(best) <= 103


def test_evolution_runs_on_a_registered_table(spark):
    """Bins that best fit leaves unfilled evolve; full ones stay, and no packing has fewer than the bound."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in packing.pieces(docs, *packing.default_files()).filter("length < 1024").sort("doc_id", "piece").collect()]
    plain = packing.best_fit([], sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths)
    trace = {}
    best = packing.evolved(lengths, [], 1, trace)[0]
    assert trace["crossovers"] > 0 or len(plain) == packing.least_bins(lengths)
    assert packing.least_bins(lengths) <= len(best) <= len(plain) and sorted(i for b in best for i in b) == list(range(len(lengths)))
    for part in range(3):  # as on a level of three shards
        own, trace = lengths[part::3], {}
        packing.evolved(own, [], 1, trace)
        bins = packing.best_fit([], sorted(range(len(own)), key=lambda i: -own[i]), own)
        assert trace["crossovers"] > 0 or len(bins) == packing.least_bins(own)


def test_packing_over_several_levels(spark, monkeypatch):
    """Many shards and levels, pieces in exchange: nothing is lost or doubled, and few bins are more than needed."""
    monkeypatch.setattr(packing, "SHARD", 64)
    rng = random.Random(7)
    sizes = [rng.randint(1, 1023) if k % 3 else rng.randint(200, 400) for k in range(900)]
    items = spark.createDataFrame([(k * 7, n) for k, n in enumerate(sizes)], "item long, length long").repartition(4)
    got = packing.packed(items, len(sizes)).collect()
    assert sorted(r.item for r in got) == [k * 7 for k in range(900)] and max(r.level for r in got) >= 2
    bins = {}
    for r in got:
        assert r.length == sizes[r.item // 7]
        bins.setdefault((r.level, r.shard, r.bin), []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    plain = packing.best_fit([], sorted(range(900), key=lambda i: -sizes[i]), sizes)
    assert len(bins) <= 1.02 * len(plain)  # shards of 64 pieces waste more than those of 4,096


def test_chat(spark):
    hostile = "\\### Assistant: </turn> ok</part>\n<#:\\b"
    rows = [(1, 1, "assistant", hostile), (1, 0, "user", hostile), (1, 2, "assistant", None), (1, 3, "a: b#", "x"), (2, 0, None, None), (2, 0, None, None), (None, None, "user", "é日"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", hostile), ("assistant", hostile), ("assistant", ""), ("a: b#", "x")]
    assert got[1].loss_texts == [hostile, ""] and got[1].formatted.count("</turn>\n") == 3
    assert [tuple(t) for t in got[2].turns] == [("", ""), ("", "")]
    assert [tuple(t) for t in got[None].turns] == [("user", "é日")] and got[3].loss_texts == [""]
    assert chat.formatted(df.filter("false")).count() == 0


def test_rules(spark, docs, none):
    got = by_id(rules.judged(rules.ledger(docs)))
    for i, text, *_ in corpus():
        w, r = [x.decode() for x in (text or "").encode().split()], got[i]
        windows = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        covered = {k for j in range(len(w) - 4) if windows[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
        full = [x for x in (text or "").split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    kept = rules.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert rules.keep(none).count() == 0
    without = {r.rule: r for r in rules.ablation(rules.ledger(docs)).collect()}
    assert without["few_words"].n == len(got) and without["few_words"].fails == sum(r.n_words < 10 for r in got.values())


def test_quality(spark, none):
    rows, marks = [], []
    for i in range(300):
        good = i % 3 > 0
        text = prose(i, 40)
        rows.append((i, text if good else " ".join(f"{w}$$$" for w in text.split())))
        marks.append((i, int(good), 0))
    df = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame(marks + [(5, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = by_id(quality.classified(df, labels))
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300))
    assert np.mean([got[i].predicted == marks[i][1] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1000].score == pytest.approx(got[1001].score)
    same = quality.classified(df, labels.filter("quality = 1"))
    assert {round(r.score, 9) for r in same.collect()} == {round(same.first().score, 9)}
    assert quality.classified(none, labels).count() == 0


def test_repetition_is_told_by_64_signs():
    rng = np.random.default_rng(6)
    hashes = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    hashes[700:1500] = (1 << 64) - 1
    first = np.array([0, 1, 256, 511, 700, 1999])
    signs = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64) * 2 - 1
    assert (quality.sign_sums(hashes, first) == np.add.reduceat(signs, first, 0)).all()

"""Fill-in-middle, language and spelling variants against plain Python, and hostile rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from graphweave.llm import language, middle, spelling

TABLE = "doc_id long, text string, lang string, source string, n long, word string, path string, form string, spans string"


def frame(spark, docs, lang="en"):
    """Documents with columns whose names the operators use inside."""
    rows = [(d, t, lang if isinstance(lang, str) else lang[k], None, 3, "word", "path", None, "s") for k, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, TABLE)


# Fill-in-middle


def by_hand(doc, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(11)
    some = ["", None, "a", " ", "\n\n", "é", "a<P>b", "<S", "<", "<<S>", "x<", "😀" * 700, "ab" * 3000, "é" * 3000 + "a" * 3000, "a b" * 5000]
    some += ["".join(rng.choice("abZ é\n<S>PM0😀漢") for _ in range(rng.randrange(1, 4000))) for _ in range(60)]
    return [*enumerate(some), (None, "no id at all"), (-5, "minus five"), (3, "the same id"), (3, "the same id")]


def test_middle_equals_plain_python(spark):
    docs = odd_texts()
    got = middle.samples(frame(spark, docs)).collect()
    want = [(d, *by_hand(d, t), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs]
    key = lambda x: repr(x)
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest() for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.samples(frame(spark, [])).count() == 0


def test_units_are_found_in_any_block():
    text = ("word é, " * 3000 + "z" * 5000 + " 漢字 end").encode()
    units = middle.Units(text)
    places = [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text.decode())] + [len(text.decode())]
    assert units.total == len(places) - 1
    for k in (0, 1, 2, 999, 1000, 7777, units.total - 1, units.total):
        at, points = units.find(k)
        assert points == places[k] and at == len(text.decode()[: places[k]].encode())


def test_middle_sql_agrees(spark, tmp_path):
    docs = [(d, t) for d, t in odd_texts() if d is not None]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = middle.op11_fill_in_middle(spark, str(tmp_path))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(got.columns)} FROM ({middle.OP11_SQL})").fetchall()))


# Spelling variants


def variants_by_hand(docs):
    counts = collections.Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [] for w in n}
    for a, b in itertools.combinations(n, 2):
        if abs(len(a) - len(b)) < 2 and near(a, b):
            found[a].append(b)
            found[b].append(a)
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in found.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w) or "", root(w), n[w], len(found[w]), n[form[w]] if w in form else 0) for w in n)


def rows_of(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def word_soup(seed):
    """Few letters, so that many words lie near each other, with anagrams and a chain of forms."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("aeinéÿz") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    base += ["".join(rng.sample("aeinrtos", 8)) for _ in range(60)]
    base += [w[:k] + x + w[k + 1 :] for w in base[:40] for k, x in ((rng.randrange(len(w)), "a"), (rng.randrange(len(w)), ""))]
    texts = [" ".join(rng.choice(base) for _ in range(40)) for _ in range(80)]
    texts += ["Variante " * 300, "Varianté " * 25 + "Varianéé " * 2, "ÀÀÀÀÀÀÀ×÷ÀÀ" * 3, "a" * 30_000 + " " + "a" * 30_000, None, "", "short"]
    return [*enumerate(texts), (None, "variante nowhere"), (7, texts[7]), (7, texts[7])]


@pytest.mark.parametrize("leaf,searches,small", [(32_768, 32_768, 48), (3, 50, 1), (0, 1000, 2)])
def test_spelling_equals_brute_force(spark, monkeypatch, leaf, searches, small):
    """At any size of a node: whole lengths, single vectors, halves of words with one vector."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "SEARCHES", searches)
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "BLOCK", 7 if small == 1 else 32_768)
    docs = word_soup(3)
    want = variants_by_hand(docs)
    assert rows_of(spelling.variants(frame(spark, docs))) == want
    assert sum(x[1] != "" for x in want) > 1 and any(x[1] and x[1] != x[2] for x in want) and max(x[4] for x in want) > 2


def test_spelling_of_nothing(spark):
    assert spelling.variants(frame(spark, [])).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, ""), (3, "one single wording")])).count() == 0


# Language


def path_by_hand(s):
    value, back = s[0].astype(float), []
    for row in s[1:]:
        way = value[:, None] - language.SWITCH * (1 - np.eye(len(value)))
        back.append(way.argmax(0))
        value = way.max(0) + row
    return value.max()


def cost(labels, s):
    return s[np.arange(len(s)), labels].sum(dtype=float) - language.SWITCH * (np.diff(labels) != 0).sum()


def test_paths_are_the_best(monkeypatch):
    monkeypatch.setattr(language, "PLACES", 300)
    rng = np.random.default_rng(5)
    some = []
    for _ in range(120):
        n = rng.integers(0, 90)
        s = -rng.exponential(2, (n, 4)).astype(np.float32)
        for a in range(0, n, 15):
            s[a : a + 15, rng.integers(4)] += 1.5
        some.append(s - s.max(1, keepdims=True) if n else s)
    found = language.path(some)
    switches = 0
    for labels, s in zip(found, some):
        assert len(labels) == len(s)
        if len(s):
            assert cost(labels, s) == pytest.approx(path_by_hand(s), abs=1e-3)
            switches += (np.diff(labels) != 0).sum()
    assert switches > 50


WORDS = {
    "de": "der die und ist nicht schon über können wir zwischen".split(),
    "en": "the and with that this they would through which about".split(),
    "el": "και είναι που στην από δεν για τους".split(),
    "ru": "что это как его она они был для".split(),
    "uk": "що це як його вона вони був для їх є".split(),
}


def spoken(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_language_of_texts_and_spans(spark):
    rng = random.Random(2)
    langs = [rng.choice(list(WORDS)) for _ in range(400)]
    docs = [(k, spoken(rng, lang, 30)) for k, lang in enumerate(langs)]
    docs += [(1000, None), (1001, ""), (1002, "123 ½ ² !?"), (1003, spoken(rng, "en", 40) + " " + spoken(rng, "ru", 25) + " " + spoken(rng, "en", 9)), (1004, spoken(rng, "de", 60_000)), (None, spoken(rng, "el", 9)), (5, docs[5][1]), (1005, spoken(rng, "en", 3) + " 中文")]
    given = [*langs, None, None, "en", None, None, None, langs[5], None]
    table = frame(spark, docs, given)
    model = language.learnt(table)
    assert model.languages == sorted(WORDS)
    names = list(language.NAMES)
    assert model.written_in[names.index("greek")].tolist() == [x == "el" for x in model.languages]
    got = language.labelled(table, model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2) for r in got)
    assert sum(by[k].lang_pred == langs[k] for k in held) >= 0.97 * len(held) and len(held) > 50
    assert all((by[k].lang_pred, by[k].score, by[k].spans) == ("und", 0.0, []) for k in (1000, 1001, 1002))
    assert [(s.lang, s.first_word, s.n_words) for s in by[1003].spans] == [("en", 0, 40), ("ru", 40, 25), ("en", 65, 9)] and by[1003].lang_pred == "en"
    assert by[1004].lang_pred == "de" and by[None].lang_pred == "el" and by[1005].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got)


def test_language_without_labels_or_rows(spark):
    table = frame(spark, [(1, "some words"), (2, None)], [None, "en"])
    assert {(r.lang_pred, r.score) for r in language.labelled(table, language.learnt(table)).collect()} == {("und", 0.0)}
    none = frame(spark, [])
    assert language.labelled(none, language.learnt(none), keep_spans=False).count() == 0


def test_labels_and_sources_are_no_inputs(spark):
    rng = random.Random(4)
    docs = [(k, spoken(rng, ("de", "en")[k % 2], 20)) for k in range(60)]
    table = frame(spark, docs, [("de", "en")[k % 2] for k in range(60)])
    model = language.learnt(table)
    blind = table.drop("lang", "source")
    assert {tuple(r) for r in language.labelled(blind, model, False).collect()} == {tuple(r) for r in language.labelled(table, model, False).collect()}


def test_documents_of_which_only_white_space_is_left_go(spark):
    from graphweave.llm import substrings

    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + "\n"), (3, text + "\t\x0b "), (4, "\n"), (5, text + "!\n.")], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in substrings.cleaned(docs).collect()} == {(1, text), (4, "\n"), (5, "!\n.")}

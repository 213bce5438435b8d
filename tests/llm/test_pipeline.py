"""The pipeline, stage by stage and as a whole, against plain Python on a hostile table."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from graphweave.llm import lines, packing
from tests.llm.test_operators import components, prose, words_of

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string, tag int, words string, _row int"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def table():
    base, other, passage = prose(1, 80), prose(2, 80), prose(3, 45)
    near = base.split()
    near[40] = "changed"
    junk = ["few words only", "same five words here now " * 20, "SHOUT " * 30, "what ! ! ! ! ! ! ! ! a text of marks this is", "1234 " * 40, "# " * 40 + prose(4, 20)]
    texts = [base, other, base, " ".join(near), other + "\nCookies here", *junk, None, "", " \n\t "]
    texts += [f"Cookies here\n{prose(10 + i, 30)}\n  Terms apply \n{prose(30 + i, 20)}" for i in range(12)]
    texts += [prose(60, 30) + " é " + passage, passage + " ü " + prose(61, 30), "z" + prose(62, 5) + "\n" + passage + "\n" + prose(63, 40), passage, prose(64, 4000)]
    rows = [(i, t, "en", f"s{i % 15}", len(t or ""), "a", 1, "b", 2) for i, t in enumerate(texts)]
    rows.append((1, other, "en", "s1", len(other), "a", 1, "b", 2))  # a repeated row
    rows.append((None, prose(70, 50) + "\nTerms apply", None, None, None, None, None, None, None))
    rows.append((500, prose(71, 50) + "\nCookies here", None, None, None, None, None, None, None))
    return rows


def quality(text):
    """Kept by all rules of policy v1."""
    text = text or ""
    words, lines_ = [w for w in re.split(f"[{SPACE}]+", text) if w], [x for x in text.split("\n") if x.strip(SPACE)]
    windows = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
    covered = {k for j in range(len(words) - 4) if windows[tuple(words[j : j + 5])] > 1 for k in range(j, j + 5)}
    n, chars, count = len(words), sum(map(len, words)), lambda p: len(re.findall(p, text))
    stutters = sum(a.lower() == b.lower() for a, b in zip(words, words[1:]))
    fails = [n < 10, 100 * len(covered) > 20 * n, 100 * count("[#*$%&|<>]") > 10 * n, 100 * count("[A-Z]") > 30 * chars, 100 * count("!") > 20 * n]
    fails += [100 * (len(lines_) - len(set(lines_))) > 50 * len(lines_), 100 * stutters > 20 * n, chars > 20 * n, 100 * count("[0-9]") > 50 * chars]
    return not any(fails)


def dedup_lines(docs):
    sites, first = {}, {}
    for i, text, site in docs:
        for k, x in enumerate((text or "").split("\n")):
            if key := x.strip(SPACE):
                sites.setdefault(key, set()).add(site)
                first[key] = min(first.get(key, (10**9,)), (-1 if i is None else i, k))
    out = []
    for i, text, site in docs:
        own = list(enumerate((text or "").split("\n")))
        left = [x for k, x in own if not x.strip(SPACE) or len(sites[x.strip(SPACE)]) < lines.MIN_SITES or first[x.strip(SPACE)] == (-1 if i is None else i, k)]
        if len(left) == len(own) or "".join(left).strip(SPACE):
            out.append((i, text if len(left) == len(own) else "\n".join(left), site))
    return out


def dedup_strings(docs):
    least, out = {}, []
    for i, text, _ in docs:
        data = (text or "").encode()
        for j in range(len(data) - 99):
            least[data[j : j + 100]] = min(least.get(data[j : j + 100], (10**9,)), (-1 if i is None else i, j))
    for i, text, site in docs:
        data = (text or "").encode()
        gone = {k for j in range(len(data) - 99) if least[data[j : j + 100]] != (-1 if i is None else i, j) for k in range(j, j + 100)}
        left = bytes(b for k, b in enumerate(data) if k not in gone).decode("utf-8", "replace")
        if not gone or left.strip():
            out.append((i, text if not gone else left, site))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(table(), COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def bag(rows):
    return Counter((r[0], r[1], r[2]) for r in rows)


def test_stages(spark, folder):
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "substring_dedup", "packing"]
    want = [(r[0], r[1], r[3]) for r in table() if quality(r[1])]
    assert 20 < len(want) < len(table()) - 6

    def after(name, docs):
        done = stages[name](spark, docs, folder)
        assert done.columns == docs.columns and [f.dataType for f in done.schema] == [f.dataType for f in docs.schema]
        done = pipeline.written(done)
        got = done.collect()
        assert all(r.n_chars == len(r.text) for r in got if r.n_chars is not None or name in ("line_dedup", "substring_dedup"))
        return done, bag((r.doc_id, r.text, r.source) for r in got)

    docs, got = after("quality_rules", docs)
    assert got == bag(want)
    docs, got = after("line_dedup", docs)
    before, want = want, dedup_lines(want)
    assert got == bag(want) and bag(before) != bag(want)
    docs, got = after("near_duplicates", docs)
    _, label = components({i: t for i, t, _ in want if i is not None})
    before, want = want, [x for x in want if x[0] is None or label[x[0]] == x[0]]
    assert got == bag(want) and len(want) < len(before)
    docs, got = after("substring_dedup", docs)
    before, want = want, dedup_strings(want)
    assert got == bag(want) and bag(before) != bag(want)


def test_run(spark, folder):
    from tokenizers import Tokenizer

    want = [(r[0], r[1], r[3]) for r in table() if quality(r[1])]
    want = dedup_lines(want)
    _, label = components({i: t for i, t, _ in want if i is not None})
    want = dedup_strings([x for x in want if x[0] is None or label[x[0]] == x[0]])
    library, pieces = Tokenizer.from_file(packing.default_files()[0]), Counter()
    for i, text, _ in want:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces.update((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(packing.cut(len(ids))))
    rows, bins = pipeline.run(spark, folder).collect(), {}
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [at for at, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_are_split_at_white_space_alone():
    assert words_of("A\x1cb\x85 C") == [b"a\x1cb\xc2\x85", b"c"] and quality(None) is False

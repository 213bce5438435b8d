"""Spelling variants: words one code point apart, found by a frequency-vector trie.

A word's vector holds its length and then, group by group, how many of its letters are in each group of
`GROUPS`. The trie arranges words by successive entries of their vectors. A replaced letter moves at most
one unit from one group to another, an inserted one adds a unit to one group; so the depth-first search
for a word's neighbours has a surplus and a deficit of one each to spend (of a pair of equal length the
surplus comes first, so that each pair is found from one of its ends), and the words of the leaves that
it comes to are compared letter by letter.

The upper levels of the trie are laid over the cluster: a node of more than `LEAF` words is split at the
next level, words go to the node that they end in, and searches travel down the same levels by joins with
the split nodes. Each node's words are then held by one task, whose searches come in a stream, sorted
behind them; searches of a crowded node are dealt to several tasks with a copy of its words. A node that
no level divides any more is divided by half words: a pair one letter apart has one half in common.

Defined results: null texts have no words, a null doc_id counts as empty text in the hash; an empty table
gives no rows; repeated rows count again; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import fenced, measured, table, texts, written

#: Letter groups, one level each; code points from U+00C0 on are the last group.
GROUPS = ("e", "a", "i", "n", "t", "r", "o", "s", "lhd", "cum", "gbpfv", "wkyqjxz")
LEVELS = len(GROUPS) + 1
#: Words that a node holds before it is split, searches of a node that go to one task.
LEAF, SEARCHES = 32_768, 32_768
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DELETE_EVERY = 7, 2, 10, 31
#: Words below which a subtree is compared by whole vectors, searches that go down together, candidates that are verified together.
SMALL, BLOCK, CANDIDATES = 48, 32_768, 1 << 18

_RUN = f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame) -> DataFrame:
    """word and n of the words that are long and frequent enough.

    Runs that are too short to give a word are not looked at; a run is hashed with its doc_id, and one in
    `DELETE_EVERY` loses the code point that the hash names.
    """
    lower = F.translate("text", _UPPER, _LOWER)
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").select(F.coalesce("doc", F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(lower, F.lit(f"({_RUN})"), F.lit(1))).alias("run"))
    hashed = fenced(runs, "run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % DELETE_EVERY == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _counts() -> Column:
    """The vector behind the length: letters of each group."""
    size = F.length("word")
    plain = [size - F.length(F.translate("word", letters, "")) for letters in GROUPS]
    return F.array(*plain, F.length(F.translate("word", _LOWER, "")))


def _halves(word: Column, length: Column, longer: bool) -> Column:
    """Keys of a word's halves: halves of the shorter word of a pair, which has `length` letters."""
    half = F.floor(length / 2).cast("int")
    behind = half + (2 if longer else 1)
    return F.array(F.concat(F.lit("<"), length, F.lit("<"), F.substring(word, F.lit(1), half)), F.concat(F.lit(">"), length, F.lit(">"), F.substring(word, behind, F.length(word))))


def _targets(vocabulary: DataFrame, split: DataFrame, depth: int) -> DataFrame:
    """word, n and the path of the node that the word ends in; two paths and more where halves divide it."""
    at = vocabulary.withColumn("path", F.length("word").cast("string"))
    for d in range(depth):
        at = at.join(split.filter(F.col("level") == d).select("path", F.lit(True).alias("divided")), "path", "left")
        if d < LEVELS:
            at = at.select("word", "n", "counts", F.when(F.col("divided"), F.concat_ws(".", "path", F.col("counts")[d])).otherwise(F.col("path")).alias("path"))
        else:
            size = F.length("word")
            halves = F.concat(_halves(F.col("word"), size, False), _halves(F.col("word"), size - 1, True))
            paths = F.when(F.col("divided"), F.transform(halves, lambda x: F.concat("path", x))).otherwise(F.array("path"))
            at = at.select("word", "n", "counts", F.explode(paths).alias("path"))
    return at.select("word", "n", "path")


def _searches(vocabulary: DataFrame, split: DataFrame, depth: int) -> DataFrame:
    """word, n and the path of every node that the word's budgets reach: words of its length, and of one letter more."""
    start = "array(named_struct('path', cast(length(word) AS string), 'surplus', 1, 'deficit', 1), named_struct('path', cast(length(word) + 1 AS string), 'surplus', 1, 'deficit', 0))"
    at = vocabulary.select("word", "n", "counts", F.expr(f"inline({start})"))
    for d in range(depth):
        at = at.join(split.filter(F.col("level") == d).select("path", F.lit(True).alias("divided")), "path", "left")
        if d < LEVELS:
            same = f"named_struct('path', concat(path, '.', counts[{d}]), 'surplus', surplus, 'deficit', deficit)"
            more = f"named_struct('path', concat(path, '.', counts[{d}] + 1), 'surplus', 0, 'deficit', deficit)"
            less = f"named_struct('path', concat(path, '.', counts[{d}] - 1), 'surplus', 0, 'deficit', 0)"
            here = "named_struct('path', path, 'surplus', surplus, 'deficit', deficit)"
            ways = f"CASE WHEN divided IS NULL THEN array({here}) WHEN surplus = 1 THEN array({same}, {more}) WHEN deficit = 1 AND counts[{d}] > 0 THEN array({same}, {less}) ELSE array({same}) END"
            at = at.select("word", "n", "counts", F.expr(f"inline({ways})"))
        else:
            paths = F.when(F.col("divided"), F.transform(_halves(F.col("word"), F.length("word"), False), lambda x: F.concat("path", x))).otherwise(F.array("path"))
            at = at.select("word", "n", F.explode(paths).alias("path"))
    return at.select("word", "n", "path")


# Inside a task. Words of a node have one length; their letters are one byte each.

_GROUP_OF = np.full(256, LEVELS - 1)
for _g, _letters in enumerate(GROUPS):
    _GROUP_OF[[ord(c) for c in _letters]] = _g


def letters(words: list[str]) -> np.ndarray:
    """One row of code points a word, all of one length."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def vectors(rows: np.ndarray) -> np.ndarray:
    """Letters of each group in each row."""
    n = len(rows)
    return np.bincount((np.arange(n)[:, None] * LEVELS + _GROUP_OF[rows]).ravel(), minlength=n * LEVELS).reshape(n, LEVELS)


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a become those of b by one replaced letter, or by one more where b's rows are longer."""
    size = a.shape[1]
    same = a == b[:, :size]
    if b.shape[1] == size:
        return same.sum(1) == size - 1
    first = np.where(same.all(1), size, same.argmin(1))
    shifted = (a == b[:, 1:])[:, ::-1]
    behind = np.where(shifted.all(1), size, shifted.argmin(1))
    return first + behind >= size


class Trie:
    """The words of a node, all of one length, sorted by their vectors: a subtree is a range of them."""

    def __init__(self, words: list[str]):
        rows = letters(words)
        found = vectors(rows).astype(np.int32)
        self.order = np.lexsort(found.T[::-1])
        self.rows, self.vectors = rows[self.order], found[self.order]

    def near(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, word) one letter apart, for rows of the same length or one letter less."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        equal = rows.shape[1] == self.rows.shape[1]
        own = vectors(rows).astype(np.int32)

        def leaf(lo: int, hi: int, at: np.ndarray) -> None:
            step = max(1, CANDIDATES // (hi - lo))
            for i in range(0, len(at), step):
                some = at[i : i + step]
                moved = self.vectors[None, lo:hi] - own[some][:, None]
                q, x = np.nonzero(np.abs(moved).sum(2) <= (2 if equal else 1))
                q, x = some[q], x + lo
                ok = one_apart(rows[q], self.rows[x])
                q, x = q[ok], x[ok]
                if equal and len(q):
                    # the surplus comes first; of words with one vector the smaller looks for the larger
                    moved = self.vectors[x] - own[q]
                    first = moved[np.arange(len(q)), (moved != 0).argmax(1)]
                    unlike = (rows[q] != self.rows[x]).argmax(1)
                    place = np.arange(len(q))
                    ok = (first > 0) | ((first == 0) & (rows[q][place, unlike] < self.rows[x][place, unlike]))
                    q, x = q[ok], x[ok]
                out.append((q, self.order[x]))

        def visit(level: int, lo: int, hi: int, at: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
            if level == LEVELS or hi - lo <= SMALL:
                leaf(lo, hi, at)
                return
            column = self.vectors[lo:hi, level]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1, [hi - lo]])
            wanted = own[at, level]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                moved = int(column[a]) - wanted
                more, less = moved == 1, moved == -1
                ok = (moved == 0) | (more & surplus) | (less & deficit & ~surplus)
                if ok.any():
                    visit(level + 1, lo + int(a), lo + int(b), at[ok], (surplus & ~more)[ok], (deficit & ~less)[ok])

        n = len(rows)
        if n:
            visit(0, 0, len(self.rows), np.arange(n), np.ones(n, bool), np.full(n, equal))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(q for q, _ in out)]), np.concatenate([none, *(x for _, x in out)])


_PAIR = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])


def _matched(trie: Trie, path: str, held: list[tuple], asked: list[tuple]):
    """Pairs of a node's words and its searches, both (word, n), in both directions."""
    length = trie.rows.shape[1]
    for size in (length, length - 1):
        some = [x for x in asked if len(x[0]) == size]
        q, x = trie.near(letters([word for word, _ in some])) if some else ((), ())
        pairs = [(*some[a], *held[b]) for a, b in zip(q, x, strict=True)]
        if ">" in path:  # the key of the first halves has the pairs that are alike in them
            half = size // 2
            pairs = [p for p in pairs if p[0][:half] != p[2][:half]]
        for i in range(0, len(pairs), BLOCK):
            a, n, b, m = zip(*pairs[i : i + BLOCK], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(m + n, pa.int64())], schema=_PAIR)


def _found(batches):
    """Pairs from rows sorted by node, a node's words before its searches, which are taken block by block."""
    key, held, asked, trie = None, [], [], None
    for batch in batches:
        for path, salt, side, word, n in zip(*(batch[c].to_pylist() for c in ("path", "salt", "side", "word", "n")), strict=True):
            if (path, salt) != key or len(asked) == BLOCK:
                if held and asked:
                    trie = trie or Trie([x for x, _ in held])
                    yield from _matched(trie, key[0], held, asked)
                asked = []
            if (path, salt) != key:
                key, held, trie = (path, salt), [], None
            (asked if side else held).append((word, n))
    if held and asked:
        yield from _matched(trie or Trie([x for x, _ in held]), key[0], held, asked)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, other and other_n of all words one code point apart, in both directions, from a written table of word and n."""
    counted = vocabulary.withColumn("counts", _counts())
    kinds = counted.groupBy(F.length("word").alias("size"), "counts").agg(F.count(F.lit(1)).alias("k"))
    nodes = kinds.select(F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"), "size", "counts", "k")
    nodes = nodes.select("level", F.concat_ws(".", "size", F.slice("counts", F.lit(1), F.col("level")).cast("array<string>")).alias("path"), "k")
    split, seen = measured(nodes.groupBy("level", "path").agg(F.sum("k").alias("k")).filter(F.col("k") > LEAF).select("level", "path"), deepest=F.max("level"))
    depth = 0 if not seen["n"] else seen["deepest"] + 1
    targets, searches = _targets(counted, split, depth), _searches(counted, split, depth)
    crowds, seen = measured(searches.groupBy("path").agg(F.count(F.lit(1)).alias("k")), searches=F.sum("k"))
    crowds = crowds.select("path", F.ceil(F.col("k") / SEARCHES).cast("int").alias("tasks"))
    targets = targets.join(crowds, "path").select("word", "n", "path", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt"))
    searches = searches.join(crowds, "path").select("word", "n", "path", F.lit(1).alias("side"), F.pmod(F.xxhash64("word"), F.col("tasks")).cast("int").alias("salt"))
    # a number of its own keeps adaptive execution from putting many small but busy nodes into one task
    dealt = targets.unionByName(searches).repartition(1 + (seen["searches"] or 0) // SEARCHES, "path", "salt").sortWithinPartitions("path", "salt", "side")
    return dealt.mapInArrow(_found, "word string, other string, other_n long")


def grouped(vocabulary: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of a written table of word and n.

    Roots are followed by pointer jumping: n grows tenfold with each step, so twenty steps are the most
    that whole numbers allow, and five doublings cover them.
    """
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    formed = -F.col("best.n") >= FORM_RATIO * F.col("n")
    rows, seen = measured(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), formed=F.count("form"))
    links, left = rows.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), seen["formed"]
    while left:
        further = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        links, moved = measured(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), moved=F.count_if("moved"))
        links, left = links.select("word", "root"), moved["moved"]
    return rows.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents."""
    return grouped(written(words(texts(docs))))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of all documents, its likely form and the root of its group."""
    return variants(table(spark, sf_dir, "documents"))

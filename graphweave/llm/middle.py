"""Fill-in-the-middle: texts cut at two units and put together again around sentinels.

A unit is a run of ASCII letters or any other code point. A text is laid out in blocks of `BLOCK` bytes;
a Fenwick tree over the blocks stores how many units and code points begin in each, and descends by
binary lifting to the block in which a unit begins, with the units and code points before it; inside
that block the unit is found by looking at its bytes. Cuts fall on the first byte of a code point, so the
parts are whole strings.

Defined results: a null text is empty, and empty texts stay plain, as do those that hold a sentinel; a
null doc_id is hashed as empty text; repeated rows get the same cuts; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import rows, slices, table, texts

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of a hundred texts so many are changed, and of a hundred changed ones so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of a block, bytes whose units are looked for at once.
BLOCK, PIECE = 1024, 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _begins(data: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where units and code points begin; `before` says whether a letter comes before the first byte."""
    letter, point = _LETTER[data], (data & 0xC0) != 0x80
    behind = np.empty(len(data), bool)
    behind[:1], behind[1:] = before, letter[:-1]
    return point & ~(letter & behind), point


class Units:
    """Units and code points of a text, counted by blocks in a Fenwick tree."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, np.uint8)
        counts = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(self.data), PIECE):  # whole blocks
            begins = _begins(self.data[at : at + PIECE], at > 0 and bool(_LETTER[self.data[at - 1]]))
            places = np.arange(0, len(begins[0]), BLOCK)
            counts.append(np.stack([np.add.reduceat(x, places, dtype=np.int64) for x in begins]))
        sums = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(np.concatenate(counts, 1), 1)], 1)
        self.total = int(sums[0, -1])
        place = np.arange(sums.shape[1])
        # entry i holds the counts of the last (i & -i) blocks up to block i
        self.tree = sums - sums[:, place - (place & -place)]

    def find(self, unit: int) -> tuple[int, int]:
        """Byte at which the unit begins and the number of code points before it; the end of the text for the unit after the last."""
        blocks = self.tree.shape[1] - 1
        at = units = points = 0
        step = 1 << blocks.bit_length() >> 1
        while step:
            if at + step <= blocks and units + self.tree[0, at + step] <= unit:
                at += step
                units += int(self.tree[0, at])
                points += int(self.tree[1, at])
            step >>= 1
        if at == blocks:
            return len(self.data), points
        start = at * BLOCK
        begins, point = _begins(self.data[start : start + BLOCK], start > 0 and bool(_LETTER[self.data[start - 1]]))
        inside = int(np.flatnonzero(begins)[unit - units])
        return start + inside, points + int(point[:inside].sum())


@dataclass(frozen=True)
class Sample:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def transformed(doc: str, text: bytes) -> Sample:
    """The text in the form that its document's hash draws."""
    h = hashlib.sha256(f"1:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = Units(text)
    n = units.total
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= CHANGED:
        return Sample(n, "plain", None, None, text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    (a, before), (b, upto) = units.find(low), units.find(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return Sample(n, "spm", before, upto - before, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return Sample(n, "psm", before, upto - before, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle)


def restored(output: bytes, form: str) -> bytes:
    """The text that an output of that form was made from: it holds no sentinel, so each is met once."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return two + middle + one if form == "spm" else one + middle + two


def samples(docs: DataFrame, keep_output: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, the output of each document."""
    fields = [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    schema = pa.schema([*fields, ("output", pa.binary())] if keep_output else fields)

    def work(batches):
        for b in slices(batches, 200):
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                s = transformed("" if doc is None else str(doc), text)
                digests = [hashlib.sha256(x).hexdigest() for x in (s.output, restored(s.output, s.form))]
                out.append((doc, s.n, s.form, s.prefix_chars, s.middle_chars, *digests, *([s.output] if keep_output else [])))
            yield rows(schema, *zip(*out, strict=True))

    kinds = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    done = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, f"{kinds}, output binary" if keep_output else kinds)
    return done.withColumn("output", F.col("output").cast("string")) if keep_output else done


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """The form of every document, its cuts, and the digests of its output and of the text rebuilt from it."""
    return samples(table(spark, sf_dir, "documents"), keep_output=False)


_PART = lambda a, b: f"array_to_string(t[{a} + 1:{b}], '')"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS r FROM d),
c AS (SELECT *, len(t) AS n, least(r[1] % (len(t) + 1), r[2] % (len(t) + 1)) AS a, greatest(r[1] % (len(t) + 1), r[2] % (len(t) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= {CHANGED} THEN 'plain' WHEN r[4] % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, {_PART(0, "a")} AS x, {_PART("a", "b")} AS y, {_PART("b", "n")} AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""

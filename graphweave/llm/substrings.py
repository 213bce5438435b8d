"""Exact removal of byte strings that repeat across a corpus, by suffix sorting.

Every string of `LENGTH` bytes has an anchor, its least hashed `GRAM`-byte part, and equal strings have
equal anchors at the same place. Consecutive strings of a document that share an anchor are a run.
Hashes only bring runs together: the contents of all runs whose anchor is met more than once, grouped by
anchor, are put together to blocks whose suffixes are sorted in two stages. Suffixes smaller than their
successors are sorted directly; all others are induced from these by a scan over buckets of first bytes.
Strings whose adjacent common prefix has `LENGTH` bytes are equal, and all but the earliest are repeats.

A task sends one of the runs with equal bytes that it holds, so that a passage in a third of all
documents is sent once a task and not once a document. The runs of an anchor with more than `GROUP` of
them, such as a part of a very common line among many others, are split: the group is then that of all
bytes of a string, and again a task sends one of its equal strings. So a group has at most `GROUP` runs or
one string a task, and all of them are decided by the sort.

Defined results: a null or empty text has no bytes; nothing that starts in one document is matched
across its end; rows with the same doc_id but other texts (null doc_ids are the same) are ordered by
place, then by a hash of the text; equal rows are one document, of which no row repeats another; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.llm.common import SPACE, _BYTE, blocks, mix, rows, settings, slices, table, written

LENGTH, GRAM = 100, 32
#: Places an anchor can have in a string.
PLACES = LENGTH - GRAM + 1
#: Text of which a task sends equal runs once, runs of an anchor that stay together, bytes whose suffixes are sorted at once.
CHUNK, GROUP, BLOCK = 12 << 20, 1000, 4 << 20
_RUN_BITS = 8  # of a place: the number of strings less one, below PLACES, or that the row is a range
_RANGE = (1 << _RUN_BITS) - 1
_SPREAD_BITS = 16
_NO_ID = -(1 << 62)  # stands for a null doc_id


def _tag(text: Column) -> Column:
    """Tells texts of the same doc_id apart."""
    return F.xxhash64(text)


def _tagged(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _tag(text).alias("tag"), text.alias("text"), *carry)


def _utf8(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _double(h: np.ndarray, k: int, step: int) -> np.ndarray:
    """Hashes of 2k bytes from hashes of k."""
    out = h * np.uint64(step)
    out[:-k] += h[k:]
    return out ^ (out >> np.uint64(29))


def hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the GRAM and of the LENGTH bytes from each place on (at the end: of what is left)."""
    h, kept = _BYTE[data], {}
    for k, step in ((1, 0x9E3779B97F4A7C15), (2, 0xBF58476D1CE4E5B9), (4, 0x94D049BB133111EB), (8, 0xD6E8FEB86659FD93), (16, 0xA0761D6478BD642F), (32, 0xE7037ED1A0B428DB)):
        if k in (4, GRAM):
            kept[k] = h
        h = _double(h, k, step) if len(h) > k else h * np.uint64(step)
    whole = h * np.uint64(0x8EBC6AF09C88C6E3)
    whole[:-64] += kept[GRAM][64:] * np.uint64(0x589965CC75374CC3)
    whole[:-96] += kept[4][96:]
    return kept[GRAM], mix(whole)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor hash, class hash, document, first string's start and number of strings less one of each run in a block of documents."""
    ends = offsets[1:] - 1
    doc = np.repeat(np.arange(len(ends)), np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(data)) + LENGTH <= ends[doc])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    gram, whole = hashes(data)
    bits = np.uint64(31)  # Arrow's texts have fewer bytes; the same bits for all, so that equal strings have equal anchors wherever they stand
    least = (gram >> bits << bits) | np.arange(len(data), dtype=np.uint64)  # hash, then place: the leftmost wins
    size = 1
    while size < PLACES:  # the least over `size` places on
        step = min(size, PLACES - size)
        least[:-step] = np.minimum(least[:-step], least[step:])
        size += step
    anchor = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    begin, last = starts[first], starts[np.append(first[1:], len(starts)) - 1]
    content = mix(whole[begin] + mix(whole[last] + (last - begin).astype(np.uint64)))
    return gram[anchor[first]], content, doc[begin], begin - offsets[doc[begin]], last - begin


_ROW = pa.schema([(c, pa.int64()) for c in ("anchor", "doc_id", "tag", "place")])
_ROW_TYPES = "anchor long, doc_id long, tag long, place long"


def _merged(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of starts, those that follow each other put together."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] != end[:-1] + 1)
    first = np.flatnonzero(new)
    return doc[first], tag[first], start[first], end[np.append(first[1:], len(doc)) - 1] if len(doc) else end


def _alike(data: np.ndarray, one: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the stretches of `size` bytes from `one` and from `other` are equal, stretch by stretch."""
    out = np.ones(len(size), bool)
    for i in range(0, len(size), 20_000):
        n = size[i : i + 20_000]
        first = np.cumsum(n) - n
        inside = np.arange(n.sum()) - np.repeat(first, n)
        same = data[np.repeat(one[i : i + 20_000], n) + inside] == data[np.repeat(other[i : i + 20_000], n) + inside]
        out[i : i + 20_000] = np.logical_and.reduceat(same, first)
    return out


def _sent(data: np.ndarray, anchor, content, doc, tag, at, start, run) -> pa.RecordBatch:
    """A chunk's runs: the earliest of those with equal bytes, and the others as ranges of repeated strings. `at` is a run's place in data."""
    order = np.lexsort((tag, start, doc, content))
    anchor, content, doc, tag, at, start, run = (x[order] for x in (anchor, content, doc, tag, at, start, run))
    new = np.ones(len(doc), bool)
    new[1:] = content[1:] != content[:-1]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    later = np.flatnonzero(~new)
    equal = run[later] == run[leader[later]]  # the hash has told the same already: this makes it certain
    equal[equal] = _alike(data, at[later[equal]], at[leader[later[equal]]], run[later[equal]] + LENGTH)
    new[later[~equal]] = True
    other = ~new & ((doc != doc[leader]) | (start != start[leader]) | (tag != tag[leader]))
    d, t, s, e = _merged(doc[other], tag[other], start[other], (start + run)[other])
    spread = (mix((d * np.int64(1_000_003) + s).astype(np.uint64)) & np.uint64((1 << _SPREAD_BITS) - 1)).astype(np.int64)
    return rows(
        _ROW,
        np.concatenate([anchor[new].view(np.int64), e << _SPREAD_BITS | spread]),
        np.concatenate([doc[new], d]),
        np.concatenate([tag[new], t]),
        np.concatenate([(start << _RUN_BITS | run)[new], s << _RUN_BITS | _RANGE]),
    )


def _anchored(batches):
    chunk, texts, size = [], [], 0

    def done():
        return _sent(np.concatenate(texts), *(np.concatenate(x) for x in zip(*chunk, strict=True)))

    for b in slices(batches, 500):
        ids, tags = b["doc_id"].fill_null(_NO_ID).to_numpy(), b["tag"].to_numpy()
        for places, data, offsets in blocks(list(range(b.num_rows)), _utf8(b["text"]), 2 << 20):
            anchor, content, doc, start, run = runs(data, offsets)
            of = np.array(places)[doc] if len(doc) else doc
            chunk.append((anchor, content, ids[of], tags[of], size + offsets[doc] + start, start, run))
            texts.append(data)
            size += len(data)
        if size >= CHUNK:
            yield done()
            chunk, texts, size = [], [], 0
    if chunk:
        yield done()


_FOUND = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_FOUND_TYPES = "anchor long, doc_id long, tag long, start long, end long"


def _met(batches):
    """Over rows sorted by anchor: repeated ranges (anchor null), and the runs whose anchor other rows have as well.

    Only one row is carried from batch to batch, however many rows an anchor has.
    """
    held, sent = [np.zeros(0, np.int64)] * 4, False  # the last row, and whether it is sent already

    def out(key, doc, tag, place):
        start = place >> _RUN_BITS
        return rows(_FOUND, key, doc, tag, start, start + (place & _RANGE))

    for b in batches:
        anchor, doc, tag, place = (b[c].to_numpy() for c in _ROW.names)
        ranges = place & _RANGE == _RANGE
        if ranges.any():
            yield rows(_FOUND, pa.nulls(int(ranges.sum()), pa.int64()), doc[ranges], tag[ranges], place[ranges] >> _RUN_BITS, anchor[ranges] >> _SPREAD_BITS)
        anchor, doc, tag, place = row = [np.concatenate([h, x[~ranges]]) for h, x in zip(held, (anchor, doc, tag, place), strict=True)]
        if not len(anchor):
            continue
        same = anchor[1:] == anchor[:-1]
        send = np.append(False, same) | np.append(same, False)
        last = bool(send[-1]) or (sent and len(anchor) == 1)
        if sent and len(held[0]):
            send[0] = False
        if send.any():
            yield out(*(x[send] for x in row))
        held, sent = [x[-1:] for x in row], last


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted places of a byte string, sorted by the LENGTH bytes from there on.

    text ends with a byte above all others, 255, which UTF-8 does not use.
    """
    n = len(text)
    at = np.arange(n)
    following = np.append(text[1:], np.uint8(255)).astype(np.int16)
    following[-1] = 256
    decided = np.where(text != following, at, n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    smaller = (text < following)[decided]  # than the suffix after it
    # a place is induced from its successor: those up to the next directly sorted one are needed too
    until = np.minimum.accumulate(np.where(smaller, at, n)[::-1])[::-1]
    marks = np.bincount(wanted, minlength=n + 1)[: n + 1] - np.bincount(until[wanted] + 1, minlength=n + 1)[: n + 1]
    needed = np.cumsum(marks)[:n] > 0
    direct = np.flatnonzero(needed & smaller)
    padded = np.concatenate([text, np.full(LENGTH, 255, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)
    direct = direct[np.argsort(view[direct].view(f"S{LENGTH}")[:, 0], kind="stable")]
    induced = needed & ~smaller
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(found: np.ndarray, byte: int) -> np.ndarray:
        """Puts the places before these into their buckets; returns those of this bucket."""
        before = found[found > 0] - 1
        before = before[induced[before]]
        first = text[before]
        for b in np.unique(first):
            if b != byte:
                waiting[b].append(before[first == b])
        return before[first == byte]

    for byte in range(256):
        found = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(found):
            out.append(found)
            found = scan(found, byte)
        found = direct[cuts[byte] : cuts[byte + 1]]
        if len(found):
            out.append(found)
            scan(found, byte)
    order = np.concatenate(out) if out else direct
    asked = np.zeros(n, bool)
    asked[wanted] = True
    return order[asked[order]]


def repeats(spans: list[bytes], doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges (document, tag, first and last start) of strings in these runs' contents that an earlier one equals."""
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    text = np.frombuffer(b"".join(spans) + b"\xff", np.uint8)
    strings = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(spans)), strings)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
    wanted = (np.cumsum(sizes) - sizes)[of] + inside
    which = np.full(len(text), -1, np.int64)
    which[wanted] = np.arange(len(wanted))
    order = suffix_order(text, wanted)
    view = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    equal = np.zeros(len(order), bool)  # to the one before, in all LENGTH bytes
    for i in range(1, len(order), 100_000):
        part = order[i - 1 : i + 100_000]
        some = np.ascontiguousarray(view[part]).view(np.uint32)
        equal[i : i + len(part) - 1] = (some[1:] == some[:-1]).all(1)
    group = np.cumsum(~equal)
    string = which[order]
    shared = np.bincount(group)[group] > 1
    group, string = group[shared], string[shared]
    d, t, s = doc[of[string]], tag[of[string]], start[of[string]] + inside[string]
    order = np.lexsort((t, s, d, group))
    group, d, t, s = group[order], d[order], t[order], s[order]
    new = np.ones(len(group), bool)
    new[1:] = group[1:] != group[:-1]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0)) if len(group) else group
    later = (d != d[leader]) | (s != s[leader]) | (t != t[leader])
    return _merged(d[later], t[later], s[later], s[later])


_SPAN = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("span", pa.binary())])
_SPAN_TYPES = "key long, doc_id long, tag long, start long, end long, span binary"


def _spans(batches):
    """Contents of runs by anchor. The strings of anchors with very many runs come by themselves, by their hash: the earliest of those with equal bytes, the others as ranges without content."""
    first: dict[bytes, tuple[int, int, int]] = {}
    for b in slices(batches, 200):
        out, again = [], []
        for text, doc, tag, found in zip(_utf8(b["text"]), b["doc_id"].to_pylist(), b["tag"].to_pylist(), b["runs"].to_pylist(), strict=True):
            for r in found:
                if not r["many"]:
                    out.append((r["anchor"], doc, tag, r["start"], r["end"], text[r["start"] : r["end"] + LENGTH]))
                    continue
                for start in range(r["start"], r["end"] + 1):
                    string, place = text[start : start + LENGTH], (doc, start, tag)
                    held = first.get(string)
                    if held is not None and held != place:
                        again.append(max(held, place))
                    if held is None or place < held:
                        first[string] = place
        if len(first) * LENGTH >= CHUNK:
            out, first = out + _strings(first), {}
        if again:
            d, s, t = (np.array(x, np.int64) for x in zip(*again, strict=True))
            d, t, s, e = _merged(d, t, s, s)
            yield rows(_SPAN, mix((d * np.int64(1_000_003) + s).astype(np.uint64)).view(np.int64), d, t, s, e, [None] * len(d))
        if out:
            yield rows(_SPAN, *zip(*out, strict=True))
    if first:
        yield rows(_SPAN, *zip(*_strings(first), strict=True))


def _strings(first: dict[bytes, tuple[int, int, int]]) -> list[tuple]:
    key = lambda x: int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)
    return [(key(x), doc, tag, start, start, x) for x, (doc, start, tag) in first.items()]


def _sorted_blocks(batches):
    """Repeats in the spans of each key; whole keys are put together to blocks of suffixes. Ranges pass."""

    def done(held):
        columns = [np.array(x, np.int64) for x in list(zip(*held, strict=True))[1:4]]
        d, t, s, e = repeats([x[5] for x in held], *columns)
        return rows(_FOUND, pa.nulls(len(d), pa.int64()), d, t, s, e)

    held, size = [], 0
    for b in batches:
        ranges = b["span"].is_null()
        if pa.compute.any(ranges).as_py():
            part = b.filter(ranges)
            yield rows(_FOUND, pa.nulls(part.num_rows, pa.int64()), *(part[c] for c in ("doc_id", "tag", "start", "end")))
            b = b.filter(pa.compute.invert(ranges))
        for row in zip(*(b[c].to_pylist() for c in _SPAN.names), strict=True):
            if size >= BLOCK and row[0] != held[-1][0]:
                yield done(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield done(held)


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, tag, start and end: ranges of starts of strings that also start earlier."""
    spark, d = docs.sparkSession, _tagged(docs)
    sent = d.mapInArrow(_anchored, _ROW_TYPES)
    found = written(sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_met, _FOUND_TYPES))
    met = found.filter(F.col("anchor").isNotNull())
    many = written(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("anchor", F.lit(True).alias("many")))
    marked = met.join(many, "anchor", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    by_doc = marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("anchor", "start", "end", "many")).alias("runs"))
    # equal rows are one document: one of them brings the text
    whole = d.withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    spans = whole.join(by_doc, ["doc_id", "tag"]).select("text", "doc_id", "tag", "runs").mapInArrow(_spans, _SPAN_TYPES)
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        more = written(spans.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_blocks, _FOUND_TYPES))
    columns = ("doc_id", "tag", "start", "end")
    return found.filter(F.col("anchor").isNull()).select(*columns).unionByName(more.select(*columns))


def _cut_out(data: bytes, found: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal spans removed."""
    spans: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"] + LENGTH) for r in found or ()):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    left, at = [], 0
    for start, end in spans:
        left.append(data[at:start])
        at = end
    return b"".join([*left, data[at:]]), [tuple(x) for x in spans]


def _with_ranges(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, tag, text, the columns to carry and found, the ranges of each document."""
    by_doc = repeated(docs).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "end")).alias("found")).withColumnRenamed("doc_id", "doc_key")
    d = _tagged(docs, carry).withColumn("doc_key", F.coalesce("doc_id", F.lit(_NO_ID)))
    return d.join(by_doc, ["doc_key", "tag"], "left")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of each removed run of bytes) and kept (the bytes left) of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def work(batches):
        for b in slices(batches, 500):
            data = _utf8(b["text"])
            done = [_cut_out(x, r) for x, r in zip(data, b["found"].to_pylist(), strict=True)]
            yield rows(schema, b["doc_id"], list(map(len, data)), [[{"start": s, "end": e} for s, e in spans] for _, spans in done], [x for x, _ in done])

    return _with_ranges(docs).select("doc_id", "text", "found").mapInArrow(work, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def _inward(data: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without these spans, each taken inward to whole characters."""
    left, at = [], 0
    for start, end in spans:
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        left.append(data[at:start])
        at = end
    return b"".join([*left, data[at:]]).decode("utf-8", "replace")


def cleaned(docs: DataFrame) -> DataFrame:
    """The documents without repeated strings, columns as they were; those of which nothing is left, though something was removed, go."""

    def work(batches):
        for b in slices(batches, 500):
            data = _utf8(b["text"])
            spans = [_cut_out(x, r)[1] for x, r in zip(data, b["found"].to_pylist(), strict=True)]
            new = pa.array([_inward(x, s) if s else None for x, s in zip(data, spans, strict=True)], pa.string())
            done = b.select(["text", "found", "row"]).set_column(0, "text", new).set_column(1, "found", pa.array([bool(s) for s in spans]))
            yield done.select(["row", "found", "text"])

    d = docs.select("doc_id", "text", F.struct("*").alias("row"))
    kind = d.schema["row"].dataType.simpleString()
    done = _with_ranges(d, ["row"]).select("text", "found", "row").mapInArrow(work, f"row {kind}, found boolean, text string")
    done = done.filter(~F.col("found") | F.col("text").rlike(f"[^{SPACE}]"))
    return done.select([F.when(F.col("found"), F.col("text")).otherwise(F.col("row.text")).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: bytes, bytes and runs of bytes removed, and the digest of what is left."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def work(batches):
        for b in slices(batches, 500):
            data = _utf8(b["text"])
            done = [_cut_out(x, r) for x, r in zip(data, b["found"].to_pylist(), strict=True)]
            yield rows(schema, b["doc_id"], list(map(len, data)), [len(x) - len(k) for x, (k, _) in zip(data, done, strict=True)], [len(s) for _, s in done], [hashlib.sha256(k).hexdigest() for k, _ in done])

    found = _with_ranges(table(spark, sf_dir, "documents")).select("doc_id", "text", "found")
    return found.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

"""Byte-level BPE encoding and decoding with a rank queue.

A pre-token's adjacent pairs wait in buckets, one for each merge rank. A two-level bitmap tells which
buckets hold anything: find-first-set on the upper level, then on the leaf, gives the lowest rank in
constant time. A bucket is a heap of positions in a linked list of tokens; an entry whose pair has
changed since is stale and skipped. A merge touches two neighbours, so a pre-token of n bytes takes
O(n log n) whatever its length.

Defined results: a null or empty text has no ids and decodes to no bytes; any other text decodes to
its own UTF-8 bytes; rows with equal ids are coded each by itself; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from graphweave.llm.common import rows, slices, table, texts

#: Unicode's White_Space, which is what \s stands for in the pattern (fixed values).
_SPACE = r"\t-\r \x85\xA0  -     　"
#: Entries of a generation of a worker's caches of pre-tokens and of parts between spaces: they bound its memory, not the results.
PIECES, PARTS = 600_000, 150_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the pair of lowest rank, leftmost first, merges until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return (whole,)
    n, rank_of = len(piece), ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    upper, leaves, buckets = 0, {}, {}
    fresh = [(r, i) for i, r in enumerate(pair) if r >= 0]
    while True:
        for rank, at in fresh:
            if rank in buckets:
                heappush(buckets[rank], at)
            else:
                buckets[rank] = [at]
                leaf = rank >> 8
                if leaf in leaves:
                    leaves[leaf] |= 1 << (rank & 255)
                else:
                    leaves[leaf] = 1 << (rank & 255)
                    upper |= 1 << leaf
        if not upper:
            break
        fresh = ()
        leaf = (upper & -upper).bit_length() - 1
        bits = leaves[leaf]
        rank = leaf << 8 | (bits & -bits).bit_length() - 1
        bucket = buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del buckets[rank]
            bits &= bits - 1
            if bits:
                leaves[leaf] = bits
            else:
                del leaves[leaf]
                upper &= upper - 1
        if pair[at] != rank:
            continue  # stale
        right = after[at]
        end = after[at] = after[right]
        pair[right] = pair[at] = -1
        if end < n:
            before[end] = at
            new = rank_of(piece[at : after[end]])
            if new is not None:
                pair[at] = new
                fresh = ((new, at),)
        left = before[at]
        if left >= 0:
            new = rank_of(piece[left:end])
            if new is None:
                pair[left] = -1
            else:
                pair[left] = new
                fresh += ((new, left),)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return tuple(out)


def splitter(pattern: str):
    """findall of the pattern, with white space as Unicode has it."""
    return regex.compile(pattern.replace(r"[^\s", "[^" + _SPACE).replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")).findall


class Recent(dict):
    """A bounded cache: what was looked up since the generation before last, made by `make` where it is missing."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encodes texts and decodes ids by a table of ranks or a file of one; bounded caches hold what recent pre-tokens, and recent stretches between two spaces, gave."""

    def __init__(self, ranks: str | dict[bytes, int], pattern: str):
        self.ranks = read_ranks(ranks) if isinstance(ranks, str) else ranks
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.table[rank] = piece
        self.split = splitter(pattern)
        self.edge = regex.compile(f"^[{_SPACE}]|[{_SPACE}]$").search
        self.pieces = Recent(lambda x: merged(x.encode("utf-8", "surrogatepass"), self.ranks), PIECES)
        self.parts = Recent(self._part, PARTS)

    def _whole(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a space and the part after it; an error where the pattern may match across the part's ends."""
        if not part or self.edge(part):
            raise ValueError
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.split(" " + part))))

    def encode(self, text: str | None) -> list[int]:
        """The ids. No match of the pattern crosses a single space between two other characters, so what stands between such spaces is coded by itself."""
        if not text:
            return []
        first, *parts = text.split(" ")
        try:
            found = list(map(self.parts.__getitem__, parts))
        except ValueError:
            return self._whole(text)
        if not first or self.edge(first):
            return self._whole(text)
        return list(chain(self._whole(first), chain.from_iterable(found)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A worker's codec for that file, made once."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of each document; path is read on the executors."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def work(batches):
        c = codec(path, pattern)
        for b in slices(batches, 500):
            yield rows(schema, b["doc_id"], [np.array(c.encode(x), np.int32) for x in b["text"].to_pylist()])

    return texts(docs).mapInArrow(work, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (the bytes) of rows of doc_id and ids; null ids give no bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def work(batches):
        c = codec(path, pattern)
        for b in slices(batches, 500):
            yield rows(schema, b["doc_id"], [c.decode(x or ()) for x in b["ids"].to_pylist()])

    return coded.select("doc_id", "ids").mapInArrow(work, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the decimal ids and of the bytes decoded from them, in one pass over the texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def work(batches):
        c = codec(path, pattern)
        decimal = list(map(str, range(len(c.table)))).__getitem__
        for b in slices(batches, 500):
            sizes, ids_hex, data_hex = [], [], []
            for text in b["text"].to_pylist():
                ids = c.encode(text)
                sizes.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                data_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield rows(schema, b["doc_id"], sizes, ids_hex, data_hex)

    return texts(docs).mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    return round_trip(table(spark, sf_dir, "documents"), *default_files())

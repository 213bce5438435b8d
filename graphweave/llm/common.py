"""Helpers shared by the operators: reading tables, word hashing, intermediate tables."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.plans.stages import measured, ship, written

__all__ = ["SPACE", "added_up", "blocks", "fenced", "lowered", "measured", "mix", "rows", "sampled", "settings", "slices", "table", "texts", "words_of", "written"]

#: The white space that ends a word, as a Java and Python character class.
SPACE = "\\x20\\x09-\\x0D"
#: Arrays that one call of `added_up` adds on its first levels, and levels; the last one adds what is left of each block.
FAN, LEVELS = 64, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name; executors get this package for their Python workers."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, carry: list[str] = ()) -> DataFrame:
    """doc_id, text (null: empty) and the columns to carry: others, whatever their names, do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *carry)


def fenced(df: DataFrame, *columns) -> DataFrame:
    """df.select(*columns), each column evaluated once a row.

    The optimizer copies an expression into filters and lambdas above it, where a lambda would
    evaluate it for each element; it does not do so across a generator, here of one row.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots written as __) that hold inside the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def sampled(df: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """About `most` of n rows, at most `most`, those of smallest hash; tasks send no more than that in all."""
    if n > most:
        span = 1 << 30
        df = df.filter(F.pmod(F.xxhash64(key), F.lit(span)) < int(span * 0.95 * most / n))
    return df.orderBy(F.xxhash64(key), key).limit(most)


# Word hashing. A hash depends on the word's bytes alone: the same in any process.

_MASK = (1 << 64) - 1
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(0x5EED)).integers(1, _MASK, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit of uint64 values over the output (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word in a byte array."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    gap = _SPACES[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    inside = np.flatnonzero(~gap)
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    sums = np.add.reduceat(_BYTE[data[inside]] * powers(int(sizes.max()))[place], first)
    return starts, ends, mix(sums + sizes.astype(np.uint64) * _STEP)


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def blocks(ids: list, values: list[bytes], most: int = 1 << 20):
    """(ids, bytes, offsets) of documents put together, about `most` bytes a block; a longer document is a block of its own."""
    i = 0
    while i < len(ids):
        j, size = i, 0
        while j < len(ids) and (j == i or size + len(values[j]) + 1 <= most):
            size += len(values[j]) + 1
            j += 1
        part = values[i:j]
        sizes = np.fromiter((len(x) + 1 for x in part), np.int64, len(part))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        yield ids[i:j], np.frombuffer(b"\n".join(part) + b"\n", np.uint8), offsets
        i = j


def slices(batches, most_rows: int = 2000):
    """Arrow batches cut to at most that many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, most_rows):
            yield batch.slice(i, most_rows)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def added_up(partials: DataFrame, kind: str) -> DataFrame:
    """block and sums: the sums of the arrays (of that numpy type, as bytes) in rows of block int, task int and sums binary.

    They are added in a tree over the tasks that sent them, so that no group grows with their number: it is
    `FAN` arrays on each level, and on the last one a `FAN ** (LEVELS - 1)`-th of the tasks.
    """
    types = "block int, task int, sums binary"

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, kind).astype(np.float64) for x in pdf["sums"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "task": pdf["task"].iloc[:1], "sums": [total.astype(kind).tobytes()]})

    for level in range(1, LEVELS + 1):
        over = F.lit(0) if level == LEVELS else F.floor(F.col("task") / FAN).cast("int")
        partials = partials.withColumn("task", over).groupBy("block", "task").applyInPandas(added, types)
    return partials.select("block", "sums")

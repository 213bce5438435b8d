"""Reachability, level by level, and within a few steps as one recursive query."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.graph import Graph
from graphweave.layout import store
from graphweave.plans.fixpoint import loop
from graphweave.plans.stages import discard, written

#: Levels that become one table, and one bitmap.
MERGE = 16


def bitmaps(ids: DataFrame) -> DataFrame:
    """bucket and bits: a bit for each id that occurs, 32,768 ids a row; partial bitmaps are made before the shuffle."""
    bucket, place = F.bitmap_bucket_number("id"), F.bitmap_bit_position("id")
    return ids.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def is_set(bits: Column, id_: Column) -> Column:
    """Whether the id's bit is set in its bucket's bitmap."""
    place = F.bitmap_bit_position(id_)
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, (place % 8).cast("int")) == 1


def outside(ids: DataFrame, visited: DataFrame) -> DataFrame:
    """The ids whose bit is not set in visited(bucket, bits)."""
    met = ids.withColumn("bucket", F.bitmap_bucket_number("id")).join(visited, "bucket", "left")
    return met.filter(F.col("bits").isNull() | ~is_set(F.col("bits"), F.col("id"))).select(*ids.columns)


def bfs(graph: Graph, source: int = 0) -> DataFrame:
    """id and level (hops from the source) of every vertex that directed paths reach; empty if there is no such source.

    A superstep joins the last level with the edges and leaves out what was visited, which is a bitmap:
    a bit a vertex, made of the last levels while they are read and of those before, of which every
    `MERGE` become one table and one bitmap. So a long path makes neither a long plan nor many scans.
    """
    held = store(graph.edges, "src")
    older: list[DataFrame] = []
    recent: list[DataFrame] = []
    bits: list[DataFrame] = []

    def visited() -> DataFrame:
        now = bitmaps(reduce(DataFrame.unionByName, recent).select("id"))
        return now if not bits else now.unionByName(bits[-1]).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))

    def step(k: int, level: DataFrame) -> DataFrame:
        if len(recent) == MERGE:
            bits.append(written(visited()))
            older.append(written(reduce(DataFrame.unionByName, recent)))
            for x in (*recent, *bits[:-1]):
                discard(x)
            recent[:], bits[:-1] = [], []
        recent.append(level)
        reached = held.meet(level.select("id")).select("id").distinct()
        return outside(reached, visited()).select("id", F.lit(k).alias("level"))

    last, _ = loop(held.vertex(graph, source).select("id", F.lit(0).alias("level")), step, kept=lambda level: None)
    held.release()
    return reduce(DataFrame.unionByName, [*older, *recent, last])


def bfs_count(graph: Graph, source: int = 0) -> DataFrame:
    """visited: vertices reached, the source included."""
    return bfs(graph, source).agg(F.count(F.lit(1)).alias("visited"))


def dfs_count(graph: Graph, source: int = 0) -> DataFrame:
    """visited by an unordered stack search. No order of visits is promised, so the vertices are those that levels reach."""
    return bfs_count(graph, source)


def within(graph: Graph, sources: DataFrame, hops: int) -> DataFrame:
    """id and hops, the fewest to it from any of sources(id), of the vertices that so many hops reach.

    One recursive query, without a loop on the driver, over edges that are stored by source: no hop exchanges
    or sorts them. A recursion keeps every pair that it meets, as SQL has it, once for each number of hops; it
    is meant for few hops, `bfs` for all.
    """
    spark, held = graph.edges.sparkSession, store(graph.edges)
    names = [f"graphweave_{kind}_{uuid.uuid4().hex}" for kind in ("edges", "sources")]
    for name, df in zip(names, (held.edges, sources.select(F.col("id").cast("long").alias("id")).distinct()), strict=True):
        df.createOrReplaceTempView(name)
    found = spark.sql(
        f"""WITH RECURSIVE r(id, hops) MAX RECURSION LEVEL {hops + 2} AS (
              SELECT id, 0 FROM {names[1]}
              UNION ALL
              SELECT /*+ SHUFFLE_HASH(r) */ DISTINCT e.dst, hops + 1 FROM r JOIN {names[0]} e ON e.src = r.id WHERE hops < {hops})
            SELECT id, min(hops) AS hops FROM r GROUP BY id"""
    )
    for name in names:
        spark.catalog.dropTempView(name)
    return found

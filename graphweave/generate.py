"""Random graphs, made by the tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import hashed
from graphweave.graph import Graph


def erdos_renyi(spark: SparkSession, n: int, p: float | None = None, seed: int = 42) -> Graph:
    """G(n, p), p = ln n / n if not given; both directions of each edge.

    Each vertex draws its larger neighbours by geometric skips, so that work follows the edges.
    """
    p = (math.log(n) / n if n > 1 else 0.0) if p is None else p

    def draw(batches):
        for b in batches:
            out = []
            for u in b["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(u)]))
                v = int(u)
                while p > 0:
                    v += int(rng.geometric(p)) if p < 1 else 1
                    if v >= n:
                        break
                    out.append((int(u), v))
            yield pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    return Graph(spark.range(n), spark.range(n).mapInPandas(draw, "src long, dst long")).symmetrized()


def uniform(rows: DataFrame, n: int, seed: int = 42) -> Graph:
    """G(n, m) over 0..n-1: each row of rows(key) draws the two ends of an edge; both directions, loops left out, parallel edges made one.

    An end is a function of key and seed that SQL repeats, so an edge stays what it is when rows are added.
    """
    size = max(n, 1)  # all edges over no vertex are loops
    ends = rows.select(hashed(seed, F.col("key"), F.lit(0), size).alias("src"), hashed(seed, F.col("key"), F.lit(1), size).alias("dst"))
    return Graph(rows.sparkSession.range(n), ends.filter("src != dst")).undirected()


def attached(rows: DataFrame, m: int, seed: int = 42) -> DataFrame:
    """rows(e, ...) with the ends src and dst of edge e of a graph that grows by preferential attachment, m edges a vertex.

    Endpoint 2e+1 of edge e copies a uniformly drawn earlier endpoint. As every draw is a function of
    its position, a task follows the copies back to a vertex by itself, and no vertex waits for others.
    """

    def follow(batches):
        for b in batches:
            e = np.asarray(b["e"], np.int64)
            at = 2 * e + 1
            while True:
                odd = np.flatnonzero((at & 1 == 1) & (at // 2 >= m))
                if not len(odd):
                    break
                x = at[odd].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                at[odd] = ((x ^ (x >> np.uint64(32))) % at[odd].astype(np.uint64)).astype(np.int64)
            # even endpoints are the vertex of the edge; the first m edges join vertex m to 0..m-1
            target = np.where(at & 1 == 0, m + at // 2 // m, at // 2)
            yield b.assign(src=m + e // m, dst=target)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(follow, f"{types}, src long, dst long")


def barabasi_albert(spark: SparkSession, n: int, m: int = 25, seed: int = 42) -> Graph:
    """Preferential attachment of m edges a vertex, both directions, parallel edges made one."""
    if n <= m:
        raise ValueError("more vertices than edges a vertex are needed")
    edges = attached(spark.range((n - m) * m).withColumnRenamed("id", "e"), m, seed).select("src", "dst").filter(F.col("src") != F.col("dst"))
    return Graph(spark.range(n), edges).undirected()

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.plans.stages import discard, measured, written

#: Pairs beyond which what belongs to one very common vertex may be too much for a task.
MANY = 5_000_000


def _least(pairs: DataFrame, split: bool) -> DataFrame:
    """u and m, the least of u and its v. Where pairs are many it is written, so that a join with it can split what belongs to one very common u."""
    least = pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return written(least, spreads=True) if split else least


def _large_star(pairs: DataFrame, split: bool) -> DataFrame:
    """Every vertex's larger neighbours, hung on the least of its neighbours and itself."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hung = both.filter("v > u").join(_least(both, split), "u")
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame, split: bool) -> DataFrame:
    """Every vertex and its smaller neighbours, hung on the least of them."""
    least = _least(pairs, split)
    hung = pairs.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _kept(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs, written, and what tells a set of pairs from others: their number and the sum of their hashes."""
    pairs, seen = measured(pairs, spreads=True, mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    return pairs, (seen["n"], seen["mark"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """id and component (the least id of its component) of every end of an edge, directions ignored.

    Each double step hangs every vertex on smaller ones until each hangs on its component's least id,
    and a double step changes nothing any more; the number of double steps is logarithmic in the longest
    path, not the path's length. Ends that are null are ignored; a vertex whose only edges are loops is
    its own component.
    """
    ends = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    loops = ends.filter("u = v").select("u", "v")
    pairs, mark = _kept(ends.filter("u != v").distinct())
    while mark[0]:
        split = mark[0] > MANY
        after = _large_star(pairs, split)
        if split:
            after = large = written(after, spreads=True)
        after, now = _kept(_small_star(after, split))
        if split:
            discard(large)
        discard(pairs)
        pairs = after
        if now == mark:
            break
        mark = now
    found = pairs.unionByName(pairs.select(F.col("v").alias("u"), "v")).unionByName(loops)
    return found.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))

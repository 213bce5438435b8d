"""Random walks that any run repeats."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.functions import draw, drawn
from graphweave.graph import Graph
from graphweave.layout import bucketed, buckets_for
from graphweave.operators.numbering import numbered
from graphweave.plans.stages import spread, written
from graphweave.sources.records import Records, shared_folder, write_records

#: Steps that are one plan where edges are joined; rows of a task's batch.
CUT, ROWS = 4, 1 << 16
_SEEN = pa.schema([("walker", pa.int64()), ("step", pa.int32()), ("v", pa.int64())])


@dataclass(frozen=True)
class Ways:
    """A vertex has a number, v, the number of its first edge and its degree (0: a sink, -1: v is null)."""

    #: Vertices with out-edges, which have the first numbers in the order of v, and all that are ends of edges.
    n: int
    ends: int
    #: The vertices in the order of their numbers, and the number of the vertex that an edge leads to, by the edge's.
    vertices: Records | None = None
    edges: Records | None = None
    #: Where the shared folder is of a store that Arrow does not know: the vertices, and those that edges lead to.
    starts: DataFrame | None = None
    ahead: DataFrame | None = None


def ways_of(graph: Graph) -> Ways:
    """All edges are numbered in the order of source and destination, by sorted ranges, so that a vertex has a
    first number and neither sorting nor stepping brings a hub's edges together."""
    spark = graph.edges.sparkSession
    out = numbered(graph.edges.select("src", "dst"), F.col("src").asc_nulls_last(), F.col("dst").asc_nulls_last(), name="place", spreads=True)
    sources = out.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"), F.min("place").alias("first"))
    reached = out.select(F.col("dst").alias("v")).distinct().select("v", F.lit(0).alias("degree"), F.lit(None).cast("long").alias("first"))
    both = written(sources.unionByName(reached).groupBy("v").agg(F.sum("degree").alias("degree"), F.min("first").alias("first")), spreads=True)
    n, ends, m = both.agg(F.count("first"), F.count(F.lit(1)), F.sum("degree")).first()
    if not n:
        return Ways(0, ends)
    vertices = numbered(both, F.col("first").isNull(), F.col("v").asc_nulls_last(), name="k")
    # the vertices are hashed, not the edges
    joined = out.join(vertices.hint("shuffle_hash"), F.col("dst").eqNullSafe(F.col("v")))
    state = [F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("first", F.lit(0)).alias("first"), F.when(F.col("v").isNull(), -1).otherwise(F.col("degree")).alias("degree")]
    if path := shared_folder(spark):
        read = write_records(vertices.select("k", *state), "k", ends, f"{path}/vertices")
        return Ways(n, ends, read, write_records(joined.select("place", "k"), "place", m, f"{path}/edges", ends))
    with spread(joined):
        return Ways(n, ends, starts=vertices.select("k", *state), ahead=bucketed(joined.select("place", *state), ["place"], buckets_for(spark, m)))


def random_walk(graph: Graph, walkers: int, steps: int | None = None, seed: int = 42) -> DataFrame:
    """walker, step and v: where each walker stands after 0, 1, ... steps; |V| / walkers steps if none are given.

    Walkers start on vertices with out-edges; one that comes to a vertex without stops there.
    """
    return _walk(graph, walkers, steps, seed)[0]


def walk_visits(graph: Graph, walkers: int, steps: int | None = None, seed: int = 42) -> DataFrame:
    """visited: places taken over all steps but the last position; |V| / walkers steps if none are given."""
    seen, steps = _walk(graph, walkers, steps, seed)
    return seen.filter(F.col("step") < steps).agg(F.count(F.lit(1)).alias("visited"))


def _walk(graph: Graph, walkers: int, steps: int | None, seed: int) -> tuple[DataFrame, int]:
    spark, ways = graph.edges.sparkSession, ways_of(graph)
    if steps is None:
        steps = (ways.ends if graph.implied else graph.vertices.count()) // walkers
    if not ways.n or not walkers:
        return spark.createDataFrame([], "walker long, step int, v long"), steps
    if not ways.edges:
        return by_joins(ways, walkers, steps, seed, spark), steps
    seen = written(by_reads(ways, walkers, steps, seed, spark))
    for records in (ways.vertices, ways.edges):
        records.release(spark)
    return seen, steps


def by_reads(ways: Ways, walkers: int, steps: int, seed: int, spark: SparkSession) -> DataFrame:
    """Walkers are dealt to tasks, which take them all their way: a step reads the edge that the draw names and
    the vertex that it leads to, and no step waits for others or looks at edges that nobody takes."""
    n = ways.n

    def work(batches):
        vertex, edge = ways.vertices.reader(), ways.edges.reader()
        for b in batches:
            walker, held, rows = b["walker"].to_numpy(), [], 0
            at = drawn(walker, 0, n, seed)
            for k in range(steps + 1):
                v, first, degree = vertex(at).T
                held.append(pa.RecordBatch.from_arrays([pa.array(walker), pa.array(np.full(len(walker), k, np.int32)), pa.array(v, mask=degree < 0)], schema=_SEEN))
                rows, on = rows + len(walker), degree > 0
                walker = walker[on]
                last = k == steps or not len(walker)
                if last or rows >= ROWS:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
                if last:
                    break
                at = edge(first[on] + drawn(walker, k + 1, degree[on], seed)).ravel()

    tasks = spark.sparkContext.defaultParallelism
    return spark.range(walkers, numPartitions=tasks).select(F.col("id").alias("walker")).mapInArrow(work, "walker long, step int, v long")


def by_joins(ways: Ways, walkers: int, steps: int, seed: int, spark: SparkSession) -> DataFrame:
    """A step is a join with all edges, which lie in buckets of their numbers and are not exchanged."""
    place = lambda v, degree: F.when(degree >= 0, v)
    first = spark.range(walkers).select(F.col("id").alias("walker"), draw(F.col("id"), F.lit(0), F.lit(ways.n), seed).alias("k"))
    at = first.join(ways.starts, "k").select("walker", "v", "first", "degree", F.array(place(F.col("v"), F.col("degree"))).alias("way"))
    parts, base = [(at, 0)] if steps == 0 else [], 0
    for k in range(1, steps + 1):
        # a walker that stops has no place to go to, and keeps the way that it came
        number = F.when(F.col("degree") > 0, F.col("first") + draw(F.col("walker"), F.lit(k), F.when(F.col("degree") > 0, F.col("degree")), seed))
        way = F.when(F.col("degree").isNotNull(), F.concat("way", F.array(place(F.col("v"), F.col("degree"))))).otherwise(F.col("way"))
        # the walkers are hashed, not the edges
        at = at.select("walker", "way", number.alias("place")).hint("shuffle_hash").join(ways.ahead, "place", "left").select("walker", "v", "first", "degree", way.alias("way"))
        if k % CUT == 0 or k == steps:
            at = written(at)
            parts.append((at, base))
            base, at = k, at.filter("degree IS NOT NULL").select("walker", "v", "first", "degree", F.array(place(F.col("v"), F.col("degree"))).alias("way"))
    # the first place of a way is the last one of the way before
    seen = [x.select("walker", F.posexplode("way").alias("n", "v")).filter(F.col("n") >= min(b, 1)).select("walker", (F.col("n") + b).cast("int").alias("step"), "v") for x, b in parts]
    return reduce(DataFrame.unionByName, seen)

"""PageRank, not normalised, pulled over stored out-edges: with symmetric edges it is the usual one.

A vertex without out-edges gets 0.15 and adds nothing to others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.graph import Graph
from graphweave.layout import EdgeTable, bucketed, store, store_by
from graphweave.plans.fixpoint import loop
from graphweave.plans.stages import discard, written

DAMPING = 0.85


def _pulled(held: EdgeTable, state: DataFrame) -> DataFrame:
    """id and s, the sum of p over its out-neighbours. Edges are dealt by dst as the state is by id: only partial sums are shuffled."""
    return held.meet(state.select("id", "p")).groupBy("id").agg(F.sum("p").alias("s"))


def _turned(graph: Graph, direction: str) -> Graph:
    if direction not in ("out", "in"):
        raise ValueError("direction is 'out' or 'in'")
    return graph if direction == "out" else Graph(graph.vertices, graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), graph.implied, graph.symmetric)


def pagerank(graph: Graph, iterations: int = 10, cut_every: int = 5, direction: str = "out") -> DataFrame:
    """id and rank after that many synchronous iterations; 0 iterations give the start values 1 / degree.

    A vertex pulls from those that its edges lead to; with direction "in" edges are taken the other way
    round: it pulls from those that lead to it, and degrees are those of edges that come in. A step of the
    loop is `cut_every` iterations of one plan.
    """
    graph = _turned(graph, direction)
    held = store(graph.edges, "dst")
    base = bucketed(held.degrees(graph), ["id"], held.buckets)
    start = F.when(F.col("degree") > 0, 1.0 / F.col("degree"))
    if iterations == 0:
        held.release()
        return base.select("id", start.alias("rank"))
    linked = base.filter("degree > 0")

    def step(k: int, state: DataFrame) -> DataFrame:
        for _ in range(min(cut_every, iterations - 1 - (k - 1) * cut_every)):
            # vertices with out-edges are those with a sum or with sinks alone as neighbours
            summed = linked.join(_pulled(held, state), "id", "left")
            state = summed.select("id", ((1 - DAMPING + DAMPING * F.coalesce("s", F.lit(0.0))) / F.col("degree")).alias("p"))
        return state

    state, _ = loop(linked.select("id", start.alias("p")), step, most=-(-(iterations - 1) // cut_every))
    last = written(base.select("id").join(_pulled(held, state), "id", "left").select("id", (1 - DAMPING + DAMPING * F.coalesce("s", F.lit(0.0))).alias("rank")))
    for x in (base, state):
        discard(x)
    held.release()
    return last


def pagerank_delta(graph: Graph, eps: float = 0.01, most: int | None = None, direction: str = "out") -> DataFrame:
    """id and rank when no change of rank / degree is above eps any more; only vertices next to such a change take a new rank.

    Each vertex keeps the sum over its neighbours, and a superstep sends changes alone: along the edges by
    which a changed vertex is pulled from, and, where the change is above eps, along its own edges, to wake
    its neighbours. Edges are stored once for either way; what both send meets in one shuffle. Where every
    edge leads both ways, these are the same neighbours: edges are stored and met once for both. With
    `most`, it is an error if that many supersteps do not end it.
    """
    graph = _turned(graph, direction)
    tables = store_by(graph.edges, ("dst",) if graph.symmetric else ("dst", "src"))
    pulled, waking = tables[0], tables[-1]
    base = bucketed(waking.degrees(graph).withColumn("p", F.when(F.col("degree") > 0, 1.0 / F.col("degree"))), ["id"], pulled.buckets)
    linked = F.col("degree") > 0
    first = base.join(_pulled(pulled, base.filter(linked)), "id", "left").select("id", "degree", "p", F.coalesce("s", F.lit(0.0)).alias("s"), linked.alias("active"))

    def step(k: int, state: DataFrame) -> DataFrame:
        new = F.when(F.col("active"), (1 - DAMPING + DAMPING * F.col("s")) / F.col("degree")).otherwise(F.col("p"))
        moved = state.select("id", "degree", new.alias("p"), "s", (new - F.col("p")).alias("change"))
        wakes = F.lit(False) if len(tables) > 1 else F.abs("change") > eps
        sums = pulled.meet(moved.filter("change != 0").select("id", "change", wakes.alias("woken"))).select("id", "change", "woken")
        if len(tables) > 1:
            woken = waking.meet(moved.filter(F.abs("change") > eps).select("id")).select("id", F.lit(0.0).alias("change"), F.lit(True).alias("woken"))
            sums = sums.unionByName(woken)
        sent = sums.groupBy("id").agg(F.sum("change").alias("more"), F.max("woken").alias("woken"))
        after = moved.join(sent, "id", "left")
        return after.select("id", "degree", "p", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"), (F.coalesce("woken", F.lit(False)) & linked).alias("active"))

    state, seen = loop(first, step, most, left=F.count_if("active"))
    for x in tables:
        x.release()
    discard(base)
    if seen["left"]:
        raise RuntimeError(f"changes above {eps} after {most} supersteps")
    return state.select("id", F.when(linked, F.col("p") * F.col("degree")).otherwise(F.lit(1 - DAMPING)).alias("rank"))

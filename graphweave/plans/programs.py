"""Vertex programs: shortest paths and cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.graph import Graph
from graphweave.layout import store
from graphweave.plans.fixpoint import vertex_program


def shortest_paths(graph: Graph, source: int, weight: str = "weight") -> DataFrame:
    """id and distance (least sum of edge weights, which must not be negative) of every vertex that directed paths from the source reach."""
    held = store(graph.edges.select("src", "dst", F.col(weight).cast("double").alias("weight")), "src", ("weight",))
    first = held.vertices(graph).select("id", F.when(F.col("id") == source, 0.0).alias("distance"))
    nearer = F.col("distance").isNull() | (F.col("least") < F.col("distance"))
    found = vertex_program(first, held, {"through": F.col("distance") + F.col("weight")}, {"least": F.min("through")}, {"distance": F.col("least")}, nearer, sends=F.col("distance").isNotNull())
    held.release()
    return found.filter("distance IS NOT NULL")


def k_core(graph: Graph, k: int) -> DataFrame:
    """id and degree of the vertices of the largest part in which each has k edges to others at least; edges must be stored in both directions.

    Vertices of too few edges go and tell their neighbours, which lose that many.
    """
    held = store(graph.edges, "src")
    first = held.degrees(graph).select("id", "degree", (F.col("degree") >= k).alias("stays"))
    left = F.col("degree") - F.col("lost")
    found = vertex_program(first, held, {"one": F.lit(1)}, {"lost": F.count("one")}, {"degree": left, "stays": left >= k}, F.col("stays"), sends=~F.col("stays"))
    held.release()
    return found.filter("stays").select("id", "degree")

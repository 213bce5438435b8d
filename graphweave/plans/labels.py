"""Component labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.graph import Graph
from graphweave.layout import store
from graphweave.plans.components import connected_components
from graphweave.plans.fixpoint import vertex_program
from graphweave.plans.stages import written


def min_label(graph: Graph) -> DataFrame:
    """id and label: the least id from which directed paths reach the vertex, itself included.

    Only labels that changed are sent on, and written. On a symmetric graph `wcc` gives the same in fewer steps.
    """
    held = store(graph.edges, "src")
    first = held.vertices(graph).select("id", F.col("id").alias("label"))
    found = vertex_program(first, held, {"label": F.col("label")}, {"least": F.min("label")}, {"label": F.col("least")}, F.col("least") < F.col("label"))
    held.release()
    return found


def wcc(graph: Graph) -> DataFrame:
    """id and label (the least id of its component) of every vertex, directions ignored."""
    if not graph.implied:
        found = written(connected_components(graph.edges), spreads=True)
        return written(graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label")), spreads=True)
    # every vertex is an end; one that only has edges to null is its own component, and so is null
    known = graph.edges.select(F.coalesce("src", "dst").alias("src"), F.coalesce("dst", "src").alias("dst"))
    found = written(connected_components(known).select("id", F.col("component").alias("label")), spreads=True)
    null = F.lit(None).cast("long")
    return found.unionByName(graph.edges.filter("src IS NULL OR dst IS NULL").limit(1).select(null.alias("id"), null.alias("label")))


def sizes(labels: DataFrame) -> DataFrame:
    """label and size of each component."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def count(labels: DataFrame) -> DataFrame:
    """n: number of components."""
    return labels.agg(F.countDistinct("label").alias("n"))

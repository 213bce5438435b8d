"""The dataflow primitive: a frontier meets the edges, and messages meet at the next vertices.

The callbacks are Column expressions over src, dst and the frontier's own columns, so a superstep is one
plan of built-in operators. Supersteps do not remove duplicates unless their name says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edge_map(frontier: DataFrame, edges: DataFrame, where: Column | None = None, **columns: Column) -> DataFrame:
    """For each edge out of a frontier row: its destination as id and the given columns; a bag."""
    met = frontier.withColumnRenamed("id", "src").join(edges, "src")
    if where is not None:
        met = met.filter(where)
    return met.select(F.col("dst").alias("id"), *(c.alias(k) for k, c in columns.items()))


def vertex_map(frontier: DataFrame, edges: DataFrame, **aggregates: Column) -> DataFrame:
    """For each frontier vertex with out-edges: id and aggregates over its edges."""
    met = frontier.withColumnRenamed("id", "src").join(edges, "src")
    return met.groupBy(F.col("src").alias("id")).agg(*(c.alias(k) for k, c in aggregates.items()))


def dense_map(frontier: DataFrame, edges: DataFrame, where: Column | None = None) -> DataFrame:
    """The distinct vertices that edges out of the frontier reach."""
    return edge_map(frontier, edges, where).distinct()


def gather(messages: DataFrame, **aggregates: Column) -> DataFrame:
    """Messages of (id, ...) put together by vertex; sums and minima are combined before the shuffle."""
    return messages.groupBy("id").agg(*(c.alias(k) for k, c in aggregates.items()))

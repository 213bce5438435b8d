"""A directed multigraph as two DataFrames: vertices(id) and edges(src, dst)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """Parallel edges and loops stay; degrees and sums count them. Isolated vertices exist if `vertices` lists them."""

    vertices: DataFrame
    edges: DataFrame
    #: The vertices are the edges' ends and no others, so that stored edges tell them as well.
    implied: bool = False
    #: It is known that every edge is there in both directions equally often, so that plans may store one for both.
    symmetric: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, declared: int | None = None) -> Graph:
        """A graph over the given vertices, over 0..declared-1 and the edges' ends, or over the ends alone."""
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        implied = vertices is None and declared is None
        if vertices is None:
            ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
            if declared is not None:
                ends = ends.unionByName(edges.sparkSession.range(declared))
            vertices = ends.distinct()
        return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges, implied)

    def symmetrized(self) -> Graph:
        """Every edge in both directions; a loop stays one edge. Edges are read once for both."""
        there, back = F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
        both = F.when(F.col("src") != F.col("dst"), F.array(there, back)).otherwise(F.array(there))
        return Graph(self.vertices, self.edges.select(F.explode(both).alias("edge")).select("edge.*"), self.implied)

    def deduplicated(self) -> Graph:
        return Graph(self.vertices, self.edges.distinct(), self.implied, self.symmetric)

    def without_loops(self) -> Graph:
        return Graph(self.vertices, self.edges.filter("src != dst"))

    def undirected(self) -> Graph:
        return replace(self.symmetrized().deduplicated(), symmetric=True)

    def plus(self, other: Graph) -> Graph:
        """The edges of both, with multiplicity; the vertices of either."""
        return Graph(self.vertices.unionByName(other.vertices).distinct(), self.edges.unionByName(other.edges), self.implied and other.implied)

    def minus(self, other: Graph) -> Graph:
        """Each edge as often as it is here more than in the other; all vertices of this one."""
        return Graph(self.vertices, self.edges.select("src", "dst").exceptAll(other.edges.select("src", "dst")))

    def common(self, other: Graph) -> Graph:
        """Each edge as often as it is in both; the vertices that both have."""
        return Graph(self.vertices.join(other.vertices, "id", "left_semi"), self.edges.select("src", "dst").intersectAll(other.edges.select("src", "dst")))

    def shifted(self, by: int) -> Graph:
        """All ids plus `by`: formats count from 1 or from 0."""
        return Graph(self.vertices.select((F.col("id") + by).alias("id")), self.edges.select((F.col("src") + by).alias("src"), (F.col("dst") + by).alias("dst")))

    def degrees(self) -> DataFrame:
        """id and degree, the number of stored out-edges."""
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    def stats(self) -> DataFrame:
        """One row: num_nodes, num_edges."""
        n = self.vertices.agg(F.count(F.lit(1)).alias("num_nodes"))
        m = self.edges.agg(F.count(F.lit(1)).alias("num_edges"))
        return n.join(m, F.lit(True))  # two single rows

    def adjacency(self) -> DataFrame:
        """id, degree and nbrs (ascending, with multiplicity) of each vertex."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
        nbrs = F.coalesce("nbrs", F.array().cast("array<long>"))
        return self.vertices.join(lists, "id", "left").select("id", F.size(nbrs).cast("long").alias("degree"), nbrs.alias("nbrs"))

    def neighbours(self, keys: DataFrame) -> DataFrame:
        """The out-edges of the vertices in keys(id)."""
        return self.edges.join(keys.select(F.col("id").alias("src")).distinct(), "src", "left_semi")

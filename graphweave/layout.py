"""Edges as bucketed tables, stored once and read by every superstep.

A stored graph keeps its edges dealt by one end into the buckets of a table, sorted by it, so that a join
on that end needs no exchange of edges, whichever plan reads them and however often. They are files in
the shared folder: a lost executor takes none of them along. The edges of a hub, a vertex of more than
`HUB` edges at that end, are dealt once more by a salt; what travels to a hub's edges is copied to each
of its salts, and what comes from them is put together again by the superstep's own aggregation.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.graph import Graph
from graphweave.plans.stages import discard, measured, shared_dir

#: Edges of a vertex that stay in one bucket; edges of a bucket, about.
HUB, BUCKET = 4_000_000, 8_000_000


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df as a table of the shared folder whose buckets hold the rows of equal keys, sorted by them: one file a bucket."""
    spark, name, path = df.sparkSession, f"graphweave_{uuid.uuid4().hex}", shared_dir(df.sparkSession)
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:]).option("path", path).saveAsTable(name)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.table(name)


def buckets_for(spark: SparkSession, n: int) -> int:
    """Buckets of n edges: as many as shuffles have partitions, more where they would be large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))


@dataclass(frozen=True)
class EdgeTable:
    """Edges dealt by the end `by`; `hubs` has id and salts of the vertices whose edges are in several buckets."""

    by: str
    edges: DataFrame
    buckets: int
    hubs: DataFrame | None
    #: Columns of an edge beside its ends.
    values: tuple[str, ...] = ()

    @property
    def far(self) -> str:
        return "dst" if self.by == "src" else "src"

    def meet(self, rows: DataFrame) -> DataFrame:
        """rows(id, ...) with each edge at their vertex: `id` is then the edge's other end, `at` the vertex itself; the edge's own values come along."""
        own = [c for c in rows.columns if c != "id"]
        if self.hubs is None:
            keyed, keys = rows.withColumnRenamed("id", self.by), [self.by]
        else:
            salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
            keyed, keys = rows.join(self.hubs, "id", "left").select(F.col("id").alias(self.by), *own, salts), [self.by, "salt"]
        # the rows are hashed, not the edges, which stay where their bucket is read
        return keyed.hint("shuffle_hash").join(self.edges, keys).select(F.col(self.far).alias("id"), F.col(self.by).alias("at"), *own, *self.values)

    def vertices(self, graph: Graph) -> DataFrame:
        """The vertices of the graph whose edges these are, without computing its edges again where they tell them."""
        if not graph.implied:
            return graph.vertices
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def vertex(self, graph: Graph, id_: int) -> DataFrame:
        """id of that vertex, if the graph has it: `vertices` without looking at the others."""
        if not graph.implied:
            return graph.vertices.filter(F.col("id") == id_).select("id")
        return self.edges.filter((F.col("src") == id_) | (F.col("dst") == id_)).limit(1).select(F.lit(id_).cast("long").alias("id"))

    def degrees(self, graph: Graph) -> DataFrame:
        """id and degree, the number of out-edges, of all vertices of that graph, in one aggregation."""
        counted = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("n")))).alias("end")).select("end.*")
        if not graph.implied:
            counted = counted.filter("n = 1").unionByName(graph.vertices.select("id", F.lit(0).alias("n")))
        return counted.groupBy("id").agg(F.sum("n").alias("degree"))

    def release(self) -> None:
        """Deletes the table's files."""
        discard(self.edges)


def store(edges: DataFrame, by: str = "src", values: tuple[str, ...] = ()) -> EdgeTable:
    """The edges as a table dealt by one end."""
    return store_by(edges, (by,), values)[0]


def store_by(edges: DataFrame, ends: tuple[str, ...], values: tuple[str, ...] = ()) -> list[EdgeTable]:
    """A table dealt by each of these ends. The edges are computed once; hubs are found by counting before anything is dealt."""
    kept, seen = measured(edges.select("src", "dst", *values), spreads=True)
    out = [_dealt(kept, seen["n"], by, values) for by in ends]
    discard(kept)
    return out


def _dealt(kept: DataFrame, n: int, by: str, values: tuple[str, ...]) -> EdgeTable:
    buckets, hubs = buckets_for(kept.sparkSession, n), None
    if n > HUB:  # else no vertex can have so many
        counts = kept.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > HUB)
        found, seen = measured(counts.select("id", F.ceil(F.col("degree") / HUB).cast("int").alias("salts")), spreads=True)
        hubs = found if seen["n"] else None
    if hubs is None:
        return EdgeTable(by, bucketed(kept, [by], buckets), buckets, None, tuple(values))
    other = "dst" if by == "src" else "src"
    dealt = kept.join(hubs.select(F.col("id").alias(by), "salts"), by, "left")
    salt = F.pmod(F.xxhash64(other), F.coalesce("salts", F.lit(1))).cast("int")
    table = bucketed(dealt.select("src", "dst", *values, salt.alias("salt")), [by, "salt"], buckets)
    return EdgeTable(by, table, buckets, hubs, tuple(values))

"""Graphs derived from the driver's tables. Left sides get even ids, right sides odd ones."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.graph import Graph

_SPARSE = "l_quantity = 1 AND l_discount <= 0.05 AND l_tax <= 0.04"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_suppliers(spark: SparkSession, sf_dir: str, where: str = "true") -> Graph:
    """Parts and the suppliers that ship them, in both directions, each pair once."""
    pairs = _table(spark, sf_dir, "lineitem").filter(where).select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).distinct()
    return replace(Graph.from_edges(pairs).symmetrized(), symmetric=True)


def weighted(spark: SparkSession, sf_dir: str) -> Graph:
    """The parts-suppliers graph with a weight on each edge, the least quantity of its lines."""
    least = _table(spark, sf_dir, "lineitem").groupBy((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")).agg(F.min("l_quantity").alias("weight"))
    both = least.unionByName(least.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Graph(both.select(F.col("src").alias("id")).distinct(), both, implied=True)


def sparse(spark: SparkSession, sf_dir: str) -> Graph:
    return parts_suppliers(spark, sf_dir, _SPARSE)


def sparse_all(spark: SparkSession, sf_dir: str) -> Graph:
    """The sparse graph over all parts and suppliers, most of them isolated."""
    ids = _table(spark, sf_dir, "part").select((2 * F.col("p_partkey")).alias("id")).unionByName(_table(spark, sf_dir, "supplier").select((2 * F.col("s_suppkey") + 1).alias("id")))
    return Graph(ids, sparse(spark, sf_dir).edges)


def customers_orders(spark: SparkSession, sf_dir: str) -> Graph:
    pairs = _table(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst")).distinct()
    return Graph.from_edges(pairs).symmetrized()


def orders_parts(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders to their parts, directed, an edge for each line."""
    return Graph.from_edges(_table(spark, sf_dir, "lineitem").select((2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst")))


def shipments(spark: SparkSession, sf_dir: str, where: str = "true") -> Graph:
    """Parts to the suppliers that ship them, directed, an edge for each line."""
    return Graph.from_edges(_table(spark, sf_dir, "lineitem").filter(where).select((2 * F.col("l_partkey")).alias("src"), (2 * F.col("l_suppkey") + 1).alias("dst")))


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions to nations to customers and suppliers."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("src"), (100 + F.col("n_nationkey")).alias("dst"))
    customer = _table(spark, sf_dir, "customer").select((100 + F.col("c_nationkey")).alias("src"), (1000 + 2 * F.col("c_custkey")).alias("dst"))
    supplier = _table(spark, sf_dir, "supplier").select((100 + F.col("s_nationkey")).alias("src"), (1001 + 2 * F.col("s_suppkey")).alias("dst"))
    return Graph.from_edges(nation.union(customer).union(supplier))


#: The same edges in SQL, as a list of common table expressions that ends in e(src, dst) and v(id).
def sql(name: str, vertices: str = "SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e)") -> str:
    pairs = "SELECT DISTINCT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b FROM lineitem"
    both = "SELECT a::BIGINT AS src, b::BIGINT AS dst FROM p UNION ALL SELECT b, a FROM p"
    every = "SELECT (2 * p_partkey)::BIGINT AS id FROM part UNION ALL SELECT 2 * s_suppkey + 1 FROM supplier"
    if name == "sparse_all":
        name, vertices = "sparse", every
    edges = {
        "parts_suppliers": f"p AS ({pairs}), e AS ({both})",
        "sparse": f"p AS ({pairs} WHERE {_SPARSE}), e AS ({both})",
        "customers_orders": f"p AS (SELECT DISTINCT 2 * o_custkey AS a, 2 * o_orderkey + 1 AS b FROM orders), e AS ({both})",
        "orders_parts": "e AS (SELECT (2 * l_orderkey)::BIGINT AS src, (2 * l_partkey + 1)::BIGINT AS dst FROM lineitem)",
        "geography": "e AS (SELECT n_regionkey::BIGINT AS src, (100 + n_nationkey)::BIGINT AS dst FROM nation UNION ALL SELECT 100 + c_nationkey, 1000 + 2 * c_custkey FROM customer UNION ALL SELECT 100 + s_nationkey, 1001 + 2 * s_suppkey FROM supplier)",
    }
    return f"{edges[name]}, v AS ({vertices})"

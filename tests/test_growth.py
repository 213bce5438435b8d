"""What a task holds, and what is read or computed once, where inputs are large."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from graphweave import catalog, sources
from graphweave import fixtures as fx
from graphweave.graph import Graph
from graphweave.layout import EdgeTable, store
from graphweave.plans import components, labels, pagerank, reach, stages
from tests.test_graph import graph, levels, pairs, random_edges
from tests.test_layout import exchanges_over, plan_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["parts_suppliers", "sparse"])
def test_both_directions_are_read_once(spark, name):
    assert plan_of(getattr(fx, name)(spark, SF).edges).count("FileScan") == 1


def test_shuffles_are_spread_by_input(spark, monkeypatch):
    key, edges = "spark.sql.shuffle.partitions", stages.written(spark.range(20_000).select((F.col("id") % 5000).alias("src"), F.col("id").alias("dst")))
    monkeypatch.setattr(stages, "SHARE", 4096)
    with stages.spread(edges.distinct()):
        assert int(spark.conf.get(key)) > 8
    assert spark.conf.get(key) == "4"
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which would put these small ones together
    try:
        kept = []
        monkeypatch.setattr(components, "written", lambda df, **how: kept.append(stages.written(df, **how)) or kept[-1])
        monkeypatch.setattr(components, "MANY", 100)
        assert components.connected_components(edges).agg(F.countDistinct("component")).first()[0] == 5000
        assert all(x.rdd.getNumPartitions() >= 1 and len(x.inputFiles()) > 4 for x in kept[:1])
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_vertices_of_labels_are_those_of_edges(spark):
    """Also those whose only edges lead to null, and null; the vertices are not computed beside the labels."""
    g = graph(spark, [(0, 1), (4, 3), (5, 5), (7, None), (None, 9)])
    assert pairs(labels.wcc(g)) == {(0, 0), (1, 0), (3, 3), (4, 3), (5, 5), (7, 7), (9, 9), (None, None)}
    unused = g.vertices.filter(F.raise_error(F.lit("vertices are computed")).isNotNull())
    assert pairs(labels.wcc(replace(g, vertices=unused))) == pairs(labels.wcc(g))


def test_hops_exchange_no_edges(spark, monkeypatch):
    edges = random_edges(21, 25, 60)
    held = []
    monkeypatch.setattr(reach, "store", lambda *a: held.append(store(*a)) or held[-1])
    found = reach.within(graph(spark, edges), spark.range(1), 2)
    assert dict(pairs(found)) == {v: n for v, n in levels(edges, 0).items() if n <= 2}
    name = held[0].edges._jdf.queryExecution().analyzed().toString().split("graphweave_")[1][:32]
    assert exchanges_over(found, f"graphweave_{name}") == []


def test_symmetric_edges_are_met_once(spark, monkeypatch):
    g = graph(spark, random_edges(3, 40, 120)).undirected()
    want = dict(pairs(pagerank.pagerank_delta(replace(g, symmetric=False))))
    met, meet = [], EdgeTable.meet
    monkeypatch.setattr(EdgeTable, "meet", lambda self, rows: met.append(self.by) or meet(self, rows))
    assert dict(pairs(pagerank.pagerank_delta(g))) == pytest.approx(want) and set(met) == {"dst"}


def test_degrees_of_neighbours_come_from_the_edges(spark, monkeypatch):
    g = graph(spark, random_edges(5, 30, 80)).undirected()
    monkeypatch.setattr(fx, "parts_suppliers", lambda *a: g)
    want = pairs(catalog.neighbour_h_index(spark, SF))
    unused = g.vertices.filter(F.raise_error(F.lit("vertices are computed")).isNotNull())
    monkeypatch.setattr(fx, "parts_suppliers", lambda *a: Graph(unused, g.edges, True, True))
    assert pairs(catalog.neighbour_h_index(spark, SF)) == want and len(want) == g.vertices.count()


class Sizes(DataSource):
    """Leaves the bytes of the largest batch that a writer gets."""

    @classmethod
    def name(cls):
        return "graphbytes"

    def schema(self):
        return "value binary, begins binary"

    def writer(self, schema, overwrite):
        return _SizesWriter(self.options["path"])


class _SizesWriter(DataSourceArrowWriter):
    def __init__(self, path):
        self.path = path

    def write(self, batches):
        with open(f"{self.path}/most", "w") as f:
            f.write(str(max(b.nbytes for b in batches)))
        return WriterCommitMessage()


def test_binary_files_are_written_in_small_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "BinaryFiles", Sizes)
    edges = spark.range(0, 4_000_000, 1, 1).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    sources.write_binedge(Graph.from_edges(edges), str(tmp_path / "g"), both=False)
    assert int((tmp_path / "g" / "most").read_text()) < 2 * sources.PIECE

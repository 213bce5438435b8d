"""Files written and read again, and files by hand."""

import struct

import pytest

from graphweave import harness, sources
from graphweave.graph import Graph


def edges_of(g):
    return sorted(tuple(r) for r in g.edges.collect())


@pytest.mark.parametrize("fmt", sources.FORMATS)
@pytest.mark.parametrize("n", [3, 1025])
def test_round_trip(spark, tmp_path, fmt, n):
    edges = [(i, (i * i + 1) % n) for i in range(n)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.range(n))
    path = str(tmp_path / f"g.{fmt}")
    writer = getattr(sources, f"write_{fmt}")
    writer(g, path, both=False) if fmt == "binedge" else writer(g, path)
    back = sources.read_graph(spark, path)
    assert back.edges.count() == n
    if fmt != "edgelist":
        assert edges_of(back) == sorted(edges)


def test_binary_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    """Hubs, isolated vertices and splits of few bytes; a file alone or its parts in a folder."""
    edges = [(0, i) for i in range(200)] + [(i, (i * 7) % 300) for i in range(50, 290, 3)] + [(7, 7), (7, 7)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), spark.range(300))
    sources.write_binadj(g, str(tmp_path / "a.binadj"))
    parts = sorted((tmp_path / "a.binadj").iterdir())
    (tmp_path / "b.binadj").write_bytes(b"".join(p.read_bytes() for p in parts))
    sources.write_binedge(g, f"file://{tmp_path}/a.binedge")
    monkeypatch.setattr(sources, "SPLIT", 64)
    for name in ("a.binadj", "b.binadj"):
        back = sources.read_graph(spark, str(tmp_path / name))
        assert edges_of(back) == sorted(edges) and back.vertices.count() == 300
    # as is usual, both directions, a loop once
    assert edges_of(sources.read_graph(spark, f"file://{tmp_path}/a.binedge")) == sorted(edges + [(b, a) for a, b in edges if a != b])
    (tmp_path / "c.binadj").write_bytes((tmp_path / "b.binadj").read_bytes()[:-4])
    with pytest.raises(Exception, match="do not fill|declared"):
        sources.read_graph(spark, str(tmp_path / "c.binadj")).edges.count()
    (tmp_path / "d.binedge").write_bytes(b"1234")
    with pytest.raises(Exception, match="cut off"):
        sources.read_graph(spark, str(tmp_path / "d.binedge")).edges.count()


def test_adjlist_by_hand(spark, tmp_path):
    (tmp_path / "a.adjlist").write_text("3 2\n2 3\n\n1\n")
    g = sources.read_graph(spark, str(tmp_path / "a.adjlist"))
    assert edges_of(g) == [(0, 1), (0, 2), (2, 0)]
    assert g.vertices.count() == 3
    (tmp_path / "b.adjlist").write_text("4 1\n2\n")
    with pytest.raises(ValueError, match="declared"):
        sources.read_graph(spark, str(tmp_path / "b.adjlist"))


def test_edgelist_by_hand(spark, tmp_path):
    (tmp_path / "a.edgelist").write_text("# Nodes: 5 Edges: 2\n#x\n\n30 10 7\n10\t20\n")
    g = sources.read_graph(spark, str(tmp_path / "a.edgelist"))
    assert edges_of(g) == [(0, 1), (1, 2)]
    assert sorted(r.id for r in g.vertices.collect()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025])
def test_binedge_reads_every_edge(spark, tmp_path, n):
    (tmp_path / "a.binedge").write_bytes(b"".join(struct.pack("<ii", i, i + 1) for i in range(n)))
    assert sources.read_graph(spark, str(tmp_path / "a.binedge")).edges.count() == n


def test_binadj_by_hand(spark, tmp_path):
    (tmp_path / "a.binadj").write_bytes(struct.pack("<7i", 3, 2, 1, 2, 0, 1, 0))
    g = sources.read_graph(spark, str(tmp_path / "a.binadj"))
    assert edges_of(g) == [(0, 2), (2, 0)]
    assert g.vertices.count() == 3


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unknown format"):
        sources.read_graph(spark, "x.csv")


def test_tables_and_logs(spark, tmp_path):
    g = Graph.from_edges(spark.createDataFrame([(0, 1)], "src long, dst long"))
    sources.save(g, str(tmp_path / "t"))
    assert edges_of(sources.load(spark, str(tmp_path / "t"))) == [(0, 1)]
    assert tuple(sources.load_stats(spark, str(tmp_path / "t")).first()) == (2, 1)
    log = harness.sweep(spark, {"count": lambda: g.degrees().selectExpr("count(*)")}, [1, 2], 2)
    harness.write_log(log, str(tmp_path / "roads_count_thread.csv"))
    back = harness.read_log(spark, str(tmp_path / "roads_count_thread.csv"))
    assert {(r.dataset, r.algo, r.testcase) for r in back.collect()} == {("roads", "count", "thread")}
    summary = harness.summarize(back).collect()
    assert sorted(r.thread for r in summary) == [1, 2] and all(r.avg_s > 0 for r in summary)

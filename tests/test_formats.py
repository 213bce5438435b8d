"""Binary formats as data sources, the index of vertex offsets and what a filter reads."""

import random

import pytest

from graphweave import sources
from graphweave.graph import Graph
from graphweave.sources import formats


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = random.Random(3)
    edges = sorted((rng.randrange(300), rng.randrange(300)) for _ in range(4000))
    g = Graph(spark.range(310), spark.createDataFrame(edges, "src long, dst long"))
    path = str(tmp_path_factory.mktemp("formats"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a file for each shuffle partition
    sources.write_binadj(g, f"{path}/g.binadj")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sources.write_binedge(g, f"{path}/g.binedge", both=False)
    formats.register(spark)
    return path, edges


def rows(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_marks_cut_where_vertices_begin(monkeypatch):
    monkeypatch.setattr(sources, "SPLIT", 40)
    marks = sources.Marks()
    for some in ([8, 20], [24, 60, 64], [], [200]):
        marks.add(sources.np.array(some, sources.np.int64))
    assert marks.done(300) == [(8, 60, 3), (60, 200, 2), (200, 300, 1)]
    assert sources.Marks().done(8) == []


def test_the_same_edges_with_and_without_index(spark, saved):
    path, edges = saved
    store, folder = sources._opened(f"{path}/g.binadj")
    names = [file for file, _ in formats.files_of(f"{path}/g.binadj")]
    assert all(sources.indexed(x) is not None for x in names) and sum(n for x in names for *_, n in sources.indexed(x)) == 310
    with_index = rows(sources.read_graph(spark, f"{path}/g.binadj").edges)
    bare = f"{path}/bare.binadj"
    store.create_dir(bare)
    for x in names:
        store.copy_file(x, f"{bare}/{x.rpartition('/')[2]}")
    assert sources.indexed(formats.files_of(bare)[0][0]) is None
    assert with_index == edges == rows(sources.read_graph(spark, bare).edges)
    with pytest.raises(Exception, match="no index"):
        spark.read.format("binadj").load(bare).count()


def test_formats_read_all_edges(spark, saved):
    path, edges = saved
    assert rows(spark.read.format("binadj").load(f"{path}/g.binadj")) == edges
    assert rows(spark.read.format("binedge").load(f"{path}/g.binedge")) == edges


def test_ranges_read_few_splits(spark, saved):
    path, edges = saved
    read = lambda **k: spark.read.format("binadj").options(**k).load(f"{path}/g.binadj")
    assert len(formats.files_of(f"{path}/g.binadj")) == read().rdd.getNumPartitions() == 4
    for low, high in ((20, 31), (7, 7), (0, 299), (290, 900)):
        assert rows(read(least=low, most=high)) == [e for e in edges if low <= e[0] <= high]
    assert read(most=19).rdd.getNumPartitions() == 1 and read(least=5000).count() == 0
    df = read()
    assert [df.count(), df.filter("src < 20").count(), df.count()] == [4000, sum(a < 20 for a, _ in edges), 4000]

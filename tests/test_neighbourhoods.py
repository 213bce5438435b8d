"""Callbacks over neighbours, set operations between graphs, point reads of saved graphs, random graphs that SQL repeats."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphweave import generate, sources
from graphweave.functions import draw
from graphweave.graph import Graph
from graphweave.operators import callbacks
from graphweave.operators.callbacks import h_index, vertex_apply
from tests.test_graph import graph, pairs, random_edges


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def spread(ids, starts, columns):
    """Number and sum of the even neighbours of a piece, and the rows that the call got of its vertex."""
    ends = np.append(starts[1:], len(columns["dst"]))
    even = np.where(columns["dst"] % 2 == 0, columns["dst"], 0)
    return {"id": ids, "n": ends - starts, "total": np.add.reduceat(even, starts)}


@pytest.mark.parametrize("piece", [1, 7, 100_000])
def test_hubs_are_called_in_pieces(spark, monkeypatch, piece):
    """A hub of most edges, one pair of it 500 times, and vertices of few."""
    monkeypatch.setattr(callbacks, "PIECE", piece)
    edges = [(0, k) for k in range(900)] + [(0, 4)] * 500 + random_edges(2, 40, 90)
    rows = spark.createDataFrame(edges, "id long, dst long")
    got = vertex_apply(rows, spread, "id long, n long, total long", {"n": F.sum("n"), "most": F.max("n"), "total": F.sum("total")})
    got = {r.id: (r.n, r.total, r.most) for r in got.collect()}
    want = Counter(a for a, _ in edges)
    assert {v: x[:2] for v, x in got.items()} == {v: (n, sum(b for a, b in edges if a == v and b % 2 == 0)) for v, n in want.items()}
    assert max(x[2] for x in got.values()) <= piece


@pytest.mark.parametrize("piece", [1, 5, 100_000])
def test_whole_vertices_are_called_once(spark, monkeypatch, piece):
    monkeypatch.setattr(callbacks, "PIECE", piece)
    rng = random.Random(4)
    rows = [(v, value, rng.randrange(1, 4)) for v in range(30) for value in rng.sample(range(1, 60), rng.randrange(1, 20))]
    want = {}
    for v in range(30):
        values = [value for u, value, n in rows if u == v for _ in range(n)]
        want[v] = max(h for h in range(len(values) + 1) if sum(x >= h for x in values) >= h)
    df = spark.createDataFrame(rows, "id long, value long, n long")
    got = vertex_apply(df, h_index, "id long, h long", order=("-value",)).collect()
    assert len(got) == 30 and {r.id: r.h for r in got} == want
    assert vertex_apply(df.limit(0), h_index, "id long, h long", order=("-value",)).collect() == []


def test_set_operations_count_copies(spark):
    a, b = graph(spark, [(0, 1)] * 3 + [(1, 2), (2, 2), (5, 6)]), graph(spark, [(0, 1), (2, 2), (2, 2), (7, 8)])
    assert bag(a.minus(b).edges) == {(0, 1): 2, (1, 2): 1, (5, 6): 1}
    assert bag(a.common(b).edges) == {(0, 1): 1, (2, 2): 1}
    assert bag(a.plus(b).edges) == {(0, 1): 4, (1, 2): 1, (2, 2): 3, (5, 6): 1, (7, 8): 1}
    assert pairs(a.minus(b).vertices) == pairs(a.vertices) and pairs(a.common(b).vertices) == {(0,), (1,), (2,)}
    assert a.plus(b).vertices.count() == 7 and a.minus(a).edges.count() == 0 and a.common(Graph.from_edges(b.edges.limit(0))).edges.count() == 0


def scanned(df):
    """The plan's scan, and the rows and files that it has read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().apply(0)
    metric = lambda name: leaf.metrics().apply(name).value()
    return metric("numOutputRows"), metric("numFiles"), leaf.toString()


def test_point_reads_read_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "ROW_GROUP", 1 << 15)
    edges = spark.range(200_000).select((F.col("id") % 5000).alias("src"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("dst"))
    path = f"{tmp_path}/g"
    sources.save(Graph.from_edges(edges), path)
    keys = spark.createDataFrame([(7,), (7,), (4999,), (None,), (9_999_999,)], "id long")
    found = sources.edges_at(spark, path, keys)
    rows, files, plan = scanned(found)
    assert bag(found) == bag(edges.filter("src IN (7, 4999)")) and sum(bag(found).values()) == 80
    assert "PushedFilters: [Or(" in plan and rows < 20_000
    target = edges.filter("src = 3").first().dst
    found = sources.edges_at(spark, path, spark.createDataFrame([(target,)], "id long"), "dst")
    rows, files, plan = scanned(found)
    assert pairs(found) == {(3, target)} and f"EqualTo(dst,{target})" in plan
    assert rows < 50_000  # the groups whose Bloom filter has it, where bounds would leave all 200,000
    assert sources.edges_at(spark, path, keys.limit(0)).count() == 0
    monkeypatch.setattr(sources, "POINTS", 1)
    assert bag(sources.edges_at(spark, path, keys)) == bag(edges.filter("src IN (7, 4999)"))


def test_uniform_graphs_repeat(spark):
    rows = spark.range(300).withColumnRenamed("id", "key")
    draw = lambda key, k: int(hashlib.md5(f"42:{key}:{k}".encode()).hexdigest()[:15], 16) % 50
    want = {(draw(k, i), draw(k, 1 - i)) for k in range(300) for i in (0, 1)}
    assert pairs(generate.uniform(rows, 50).edges) == {(a, b) for a, b in want if a != b}
    assert generate.uniform(rows, 50).vertices.count() == 50
    assert generate.uniform(rows, 0).edges.count() == 0 and generate.uniform(rows.limit(0), 5).edges.count() == 0


def test_attached_rows_keep_their_columns(spark):
    rows = spark.range(400).select(F.col("id").alias("e"), (F.col("id") * 3).alias("order"))
    got = generate.attached(rows, 4).collect()
    assert all(r.order == 3 * r.e and r.src == 4 + r.e // 4 and 0 <= r.dst <= r.src for r in got)
    assert {r.dst for r in got if r.e < 4} <= {0, 1, 2, 3, 4}
    again = {(r.e, r.dst) for r in generate.attached(rows.repartition(7), 4).collect()}
    assert again == {(r.e, r.dst) for r in got}


def test_draws_of_late_steps(spark):
    """From step 16 on, 134,775,813 times the step is no int any more."""
    steps = [0, 1, 15, 16, 126, 7560]
    rows = spark.range(3).withColumn("w", (F.col("id") * 333).cast("int"))
    got = {s: [r.d for r in rows.select(draw(F.col("w"), F.lit(s), F.lit(1000)).alias("d")).collect()] for s in steps}
    assert got == {s: [(w * 1103515245 + s * 134775813 + 42 * 69069) % 2**31 // 256 % 1000 for w in (0, 333, 666)] for s in steps}

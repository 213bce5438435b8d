"""Stored edges, hubs dealt to several buckets, the fix-point runner and vertex programs."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from graphweave import layout
from graphweave.graph import Graph
from graphweave.layout import store, store_by
from graphweave.plans import fixpoint, labels, pagerank, programs, reach
from tests.test_graph import graph, levels, pairs, random_edges


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges_over(df, table):
    """Lines of the plan from an exchange down to the scan of a table, if an exchange lies over it."""
    lines, depth_of = plan_of(df).split("\n"), lambda x: len(x) - len(x.lstrip(" :+-*()0123456789"))
    out = []
    for k, line in enumerate(lines):
        if table in line and "FileScan" in line:
            depth = depth_of(line)
            for above in reversed(lines[:k]):
                if depth_of(above) < depth:
                    depth = depth_of(above)
                    if "Exchange" in above:
                        out.append(above)
                    if "Join" in above:
                        break
    return out


def test_a_superstep_does_not_exchange_edges(spark):
    g = graph(spark, random_edges(1, 200, 900))
    held = store(g.edges, "dst")
    name = held.edges._jdf.queryExecution().analyzed().toString().split("graphweave_")[1][:32]
    state = spark.range(200).select("id", F.lit(1.0).alias("p"))
    met = held.meet(state)
    assert f"graphweave_{name}" in plan_of(met) and exchanges_over(met, f"graphweave_{name}") == []
    assert "Bucketed: true" in plan_of(met)
    held.release()


def test_hubs_span_buckets(spark, monkeypatch):
    """A star: no bucket has over twice the median rows, and each plan gives what it gives without salts."""
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    g = Graph.from_edges(star).symmetrized()
    plain = {"bfs": pairs(reach.bfs(g)), "label": pairs(labels.min_label(g)), "rank": dict(pairs(pagerank.pagerank(g, 2))), "delta": dict(pairs(pagerank.pagerank_delta(g, 0.3)))}
    assert store(g.edges).hubs is None
    monkeypatch.setattr(layout, "HUB", 100)
    monkeypatch.setattr(layout, "BUCKET", 1000)
    for held in store_by(g.edges, ("src", "dst")):
        assert [tuple(r) for r in held.hubs.collect()] == [(0, 40)]
        sizes = [r["count"] for r in held.edges.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        assert dict(pairs(held.degrees(g))) == {0: 4000} | dict.fromkeys(range(1, 4001), 1)
        met = held.meet(spark.range(1))
        assert sorted((r.id, r.at) for r in met.collect()) == [(k, 0) for k in range(1, 4001)]
    assert pairs(reach.bfs(g)) == plain["bfs"] and pairs(labels.min_label(g)) == plain["label"]
    assert dict(pairs(pagerank.pagerank(g, 2))) == pytest.approx(plain["rank"])
    assert dict(pairs(pagerank.pagerank_delta(g, 0.3))) == pytest.approx(plain["delta"])


def test_vertices_told_by_edges(spark):
    g = graph(spark, [(0, 1), (1, 2), (5, 5)])
    held = store(g.edges)
    assert g.implied and g.undirected().implied and not g.without_loops().implied
    assert {r.id for r in held.vertices(g).collect()} == {0, 1, 2, 5}
    lone = graph(spark, [(0, 1)], 4)
    assert not lone.implied and pairs(store(lone.edges).degrees(lone)) == {(0, 1), (1, 0), (2, 0), (3, 0)}


def test_bitmaps(spark):
    ids = [0, 1, 7, 8, 32767, 32768, 32769, 65536, 10**12, -1, -5, -40000]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    bits = reach.bitmaps(df.union(df))
    assert bits.select(F.sum(F.bitmap_count("bits"))).first()[0] == len(ids)
    asked = spark.createDataFrame([(i + d,) for i in ids for d in (-1, 0, 1)], "id long").distinct()
    want = {i + d for i in ids for d in (-1, 0, 1)} - set(ids)
    assert {r.id for r in reach.outside(asked, bits).collect()} == want


def test_long_paths_merge_levels_and_changes(spark, monkeypatch):
    monkeypatch.setattr(reach, "MERGE", 3)
    monkeypatch.setattr(fixpoint, "MERGE", 2)
    path = [(i, i + 1) for i in range(11)] + [(4, 0), (11, 5)]
    g = graph(spark, path, 13)
    assert dict(pairs(reach.bfs(g))) == levels(path, 0)
    assert dict(pairs(labels.min_label(g))) == {**dict.fromkeys(range(12), 0), 12: 12}


def test_a_program_ends_after_most_steps(spark):
    g = graph(spark, [(i, i + 1) for i in range(9)])
    held = store(g.edges)
    first = held.vertices(g).select("id", F.col("id").alias("label"))
    got = fixpoint.vertex_program(first, held, {"label": F.col("label")}, {"least": F.min("label")}, {"label": F.col("least")}, F.col("least") < F.col("label"), most=3)
    assert dict(pairs(got)) == {v: max(0, v - 3) for v in range(10)}


def test_shortest_paths(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice([0.0, 0.5, 1.0, 2.5, 7.0])) for _ in range(120)]
    best, queue = {}, [(0.0, edges[0][0])]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(queue, (d + w, b))
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    g = Graph(spark.range(41), df)
    assert dict(pairs(programs.shortest_paths(g, edges[0][0]))) == pytest.approx(best)
    assert programs.shortest_paths(g, 40).collect()[0][:] == (40, 0.0) and programs.shortest_paths(g, 99).count() == 0


def test_k_core(spark):
    one = {(a, b) for a, b in random_edges(12, 40, 110) if a != b}
    edges = one | {(b, a) for a, b in one}
    for k in (1, 3, 4, 9):
        alive = {v for e in edges for v in e}
        while True:
            degree = {v: sum(a == v and b in alive for a, b in edges) for v in alive}
            out = {v for v in alive if degree[v] < k}
            if not out:
                break
            alive -= out
        assert dict(pairs(programs.k_core(graph(spark, sorted(edges)), k))) == {v: degree[v] for v in alive}


def test_late_supersteps_send_the_changed_alone(spark, monkeypatch):
    """Two far parts, one of which settles at once: later supersteps meet the edges of the other only."""
    chain = [(i, i + 1) for i in range(100, 112)]
    pair = [(k, k + 1) for k in range(0, 60, 2)]
    g = graph(spark, chain + pair).symmetrized()
    met = []
    meet = layout.EdgeTable.meet

    def counted(self, rows):
        out = meet(self, rows)
        met.append((self.by, out.count()))
        return out

    monkeypatch.setattr(layout.EdgeTable, "meet", counted)
    pagerank.pagerank_delta(g, 0.01)
    first, later = met[0], [n for by, n in met[3:] if by == "dst"]
    assert first == ("dst", 84) and later and max(later) <= 24 and [n for by, n in met if by == "src"][-1] == 0


def test_reach_within_is_one_query(spark):
    edges = random_edges(21, 25, 60)
    g, start = graph(spark, edges, 25), [edges[0][0], edges[5][0]]
    keys = spark.createDataFrame([(v,) for v in start], "id long")
    for hops in (0, 1, 3):
        want = {}
        for s in start:
            for v, n in levels(edges, s).items():
                if n <= hops:
                    want[v] = min(n, want.get(v, n))
        assert dict(pairs(reach.within(g, keys, hops))) == want

"""Small graphs by hand, random graphs against plain Python, and invariants."""

import math
import random
from collections import deque

import pytest

from graphweave import generate
from graphweave.graph import Graph
from graphweave.operators.numbering import first_seen, numbered
from graphweave.plans import labels, pagerank, reach, walk
from graphweave.plans.components import connected_components


def graph(spark, edges, n=None):
    df = spark.createDataFrame(edges, "src long, dst long")
    return Graph.from_edges(df, spark.range(n) if n is not None else None)


def pairs(df):
    return {tuple(r) for r in df.collect()}


def random_edges(seed, n=30, m=40):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def levels(edges, source):
    out, queue = {source: 0}, deque([source])
    while queue:
        u = queue.popleft()
        for a, b in edges:
            if a == u and b not in out:
                out[b] = out[u] + 1
                queue.append(b)
    return out


def test_transforms_keep_multiplicity(spark):
    g = graph(spark, [(0, 1), (0, 1), (1, 1), (2, 0)], 4)
    assert pairs(g.degrees()) == {(0, 2), (1, 1), (2, 1), (3, 0)}
    assert g.symmetrized().edges.count() == 7
    assert g.without_loops().edges.count() == 3
    assert pairs(g.undirected().edges) == {(0, 1), (1, 0), (1, 1), (2, 0), (0, 2)}
    assert {(r.id, tuple(r.nbrs)) for r in g.adjacency().collect()} == {(0, (1, 1)), (1, (1,)), (2, (0,)), (3, ())}
    assert tuple(g.stats().first()) == (4, 4)


@pytest.mark.parametrize("edges,n,expected", [([], 1, {0: 0}), ([], 0, {}), ([(0, 1), (1, 2), (2, 0)], 3, {0: 0, 1: 1, 2: 2}), ([(0, 0), (0, 1), (2, 3)], 4, {0: 0, 1: 1})])
def test_bfs_by_hand(spark, edges, n, expected):
    assert dict(pairs(reach.bfs(graph(spark, edges, n)))) == expected


def test_random_graph_against_plain_python(spark):
    edges = random_edges(5)
    g = graph(spark, edges, 30)
    assert dict(pairs(reach.bfs(g, edges[0][0]))) == levels(edges, edges[0][0])
    want = {v: min(u for u in range(30) if v in levels(edges, u)) for v in range(30)}
    assert dict(pairs(labels.min_label(g))) == want
    both = edges + [(b, a) for a, b in edges]
    want = {v: min(levels(both, v)) for v in range(30)}
    assert dict(pairs(labels.wcc(g))) == want
    assert dict(pairs(labels.min_label(g.symmetrized()))) == want


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.range(64).selectExpr("id AS src", "id + 1 AS dst")
    assert {r.component for r in connected_components(path).collect()} == {0}
    assert connected_components(spark.createDataFrame([(3, 3), (None, 1)], "src long, dst long")).collect()[0][:] == (3, 3)
    assert connected_components(path.filter("false")).count() == 0


def test_pagerank(spark):
    edges = [(a, b) for a, b in random_edges(7) if a != b]
    edges += [(b, a) for a, b in edges]
    g = graph(spark, edges)
    degree, near = {}, {}
    for a, b in edges:
        degree[a] = degree.get(a, 0) + 1
        near.setdefault(a, []).append(b)
    p = {v: 1 / degree[v] for v in degree}
    for k in range(10):
        s = {v: 0.15 + 0.85 * sum(p[w] for w in near[v]) for v in degree}
        p = {v: s[v] / degree[v] for v in degree}
    got = dict(pairs(pagerank.pagerank(g)))
    assert got == pytest.approx(s)
    assert sum(got.values()) == pytest.approx(len(degree))
    assert dict(pairs(pagerank.pagerank(graph(spark, [(0, 1)])))) == pytest.approx({0: 0.15, 1: 0.15})
    p, active = {v: 1 / degree[v] for v in degree}, set(degree)
    while active:
        new = {v: (0.15 + 0.85 * sum(p[w] for w in near[v])) / degree[v] if v in active else p[v] for v in degree}
        active = {w for v in active if abs(new[v] - p[v]) > 0.05 for w in near[v]}
        p = new
    assert dict(pairs(pagerank.pagerank_delta(g, 0.05))) == pytest.approx({v: p[v] * degree[v] for v in degree})


def test_walks_follow_edges_and_repeat(spark):
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (0, 2)]
    g = graph(spark, edges, 4)
    rows = sorted(pairs(walk.random_walk(g, 8, 5)))
    assert rows == sorted(pairs(walk.random_walk(g, 8, 5)))
    at = {(w, k): v for w, k, v in rows}
    assert all(k == 0 or (at[w, k - 1], v) in edges for (w, k), v in at.items())
    assert all(at[w, 0] in (0, 1, 2) for w in range(8))
    assert walk.random_walk(graph(spark, [], 3), 2, 2).count() == 0


def test_numbering(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS x")
    assert all(r.x == r.number for r in numbered(df, "x").collect())
    edges = spark.createDataFrame([(0, 30, 10), (1, 10, 20), (2, 20, 30)], "k long, src long, dst long")
    coded, ids = first_seen(edges, "k")
    assert pairs(ids) == {(30, 0), (10, 1), (20, 2)}
    assert pairs(coded) == {(0, 1), (1, 2), (2, 0)}


def test_generators(spark):
    er = generate.erdos_renyi(spark, 300)
    assert 0.6 < er.edges.count() / (299 * math.log(300)) < 1.4
    ba = generate.barabasi_albert(spark, 200, 3)
    assert ba.vertices.count() == 200
    assert ba.edges.filter("src = dst").count() == 0
    assert set(pairs(labels.count(labels.wcc(ba)))) == {(1,)}


def test_queries_over_all_rows(spark, tmp_path):
    """Adjacency, round trips and walks take every pair, not those of few lines alone."""
    from graphweave import catalog

    lines = [(p, (p * 7 + k) % 50) for p in range(1200) for k in range(3)]
    orders = [(o, o % 90) for o in range(400)]
    d = str(tmp_path)
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{d}/orders.parquet")
    run = lambda name: [tuple(r) for r in catalog.QUERIES[name](spark, d).collect()]
    near = {}
    for p, s in lines:
        near.setdefault(2 * p, set()).add(2 * s + 1)
        near.setdefault(2 * s + 1, set()).add(2 * p)
    near = {v: sorted(x) for v, x in near.items()}
    assert sorted(run("adjacency_all")) == sorted((v, len(x), " ".join(map(str, x))) for v, x in near.items())
    draw = lambda w, k, n: (w * 1103515245 + k * 134775813 + 42 * 69069) % 2147483648 // 256 % n
    want, steps = [], len(near) // 1000
    for w in range(1000):
        at = sorted(near)[draw(w, 0, len(near))]
        want.append((w, 0, at))
        for k in range(1, steps + 1):
            at = near[at][draw(w, k, len(near[at]))]
            want.append((w, k, at))
    assert steps == 1 and sorted(run("random_walk_all")) == sorted(want)
    assert run("random_walk_visits_all") == [(1000 * steps,)]
    pairs = [(2 * c, 2 * o + 1) for o, c in orders]
    both = sorted(pairs + [(b, a) for a, b in pairs])
    place = {}
    for a, b in both:
        place.setdefault(a, len(place))
        place.setdefault(b, len(place))
    for fmt in ("adjlist", "binedge", "binadj"):
        assert sorted(run(f"round_trip_{fmt}_all")) == sorted((place[a], place[b]) for a, b in both)
    assert sorted(run("round_trip_edgelist_all")) == sorted((place[a], place[b]) for a, b in both)


def test_empty_graphs_have_results(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert connected_components(none).count() == 0
    for g, n in ((Graph.from_edges(none), 0), (Graph.from_edges(none, spark.range(3)), 3)):
        assert [x.count() for x in (labels.wcc(g), labels.min_label(g), pagerank.pagerank(g), pagerank.pagerank_delta(g))] == [n] * 4
        assert reach.bfs(g, 1).count() == min(n, 1) and walk.random_walk(g, 3, 9).count() == 0


def test_walkers_that_stop_keep_their_way(spark):
    """A path of seven edges: a walk crosses several written steps and ends at the sink; a loop goes on."""
    g = graph(spark, [(i, i + 1) for i in range(7)] + [(20, 20)])
    ways = {}
    for r in walk.random_walk(g, 40, 10).collect():
        ways.setdefault(r.walker, []).append((r.step, r.v))
    assert len(ways) == 40
    for way in ways.values():
        way.sort()
        start = way[0][1]
        want = [20] * 11 if start == 20 else list(range(start, 8))
        assert way == list(enumerate(want))
    assert {w[0][1] for w in ways.values()} >= {0, 20}


def test_pagerank_along_incoming_edges(spark):
    edges = random_edges(3)
    back = [(b, a) for a, b in edges]
    one = {r.id: r.rank for r in pagerank.pagerank(graph(spark, edges, 30), 6, direction="in").collect()}
    other = {r.id: r.rank for r in pagerank.pagerank(graph(spark, back, 30), 6).collect()}
    assert one == pytest.approx(other)
    with pytest.raises(RuntimeError, match="supersteps"):
        pagerank.pagerank_delta(graph(spark, edges, 30), 1e-9, most=2)

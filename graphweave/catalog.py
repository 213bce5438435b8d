"""The registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave import fixtures as fx
from graphweave import generate, harness, sources
from graphweave.graph import Graph
from graphweave.operators.callbacks import h_index, vertex_apply
from graphweave.operators.numbering import first_seen, numbered
from graphweave.operators.superstep import dense_map, edge_map, gather, vertex_map
from graphweave.plans import labels, pagerank, programs, reach, walk
from graphweave.plans.stages import shared_dir, written
from graphweave.sources import formats

QUERIES: dict = {}
SQL: dict[str, str] = {}
WALKERS, STEPS = 20, 6


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(graph: str, query: str) -> str:
    return f"WITH {fx.sql(graph)} {query}"


_DEGREE = "SELECT id, coalesce(n, 0)::BIGINT AS degree FROM v LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) ON src = id"
_REACH = "r(id) AS (SELECT 0::BIGINT UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)"


def _pagerank_sql(graph: str, iterations: int = 10, where: str = "true", turned: bool = False) -> str:
    """Chained expressions: q holds rank / degree, the last one ranks."""
    steps = [f"g AS ({_DEGREE})", "q0 AS (SELECT id, degree, CASE WHEN degree > 0 THEN 1.0::DOUBLE / degree END AS p FROM g)"]
    for k in range(1, iterations + 1):
        value = "(0.15 + 0.85 * coalesce(s, 0))"
        steps.append(f"q{k} AS (SELECT g.id, g.degree, {value + ' / nullif(g.degree, 0)' if k < iterations else value} AS p FROM g LEFT JOIN (SELECT e.src, sum(x.p) AS s FROM e JOIN q{k - 1} x ON x.id = e.dst GROUP BY e.src) ON src = g.id)")
    edges = fx.sql(graph).replace("e AS (", "e0 AS (").replace("v AS (", "e AS (SELECT dst AS src, src AS dst FROM e0), v AS (") if turned else fx.sql(graph)
    return f"WITH {edges}, {', '.join(steps)} SELECT id, round(p, 6) AS rank FROM q{iterations} WHERE {where}"


@_query("graph_stats", _with("parts_suppliers", "SELECT (SELECT count(*) FROM v)::BIGINT AS num_nodes, (SELECT count(*) FROM e)::BIGINT AS num_edges"))
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return fx.parts_suppliers(spark, d).stats()


@_query("degrees", _with("sparse_all", _DEGREE))
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return fx.sparse_all(spark, d).degrees()


@_query("degrees_all", _with("orders_parts", _DEGREE))
def degrees_all(spark: SparkSession, d: str) -> DataFrame:
    return fx.orders_parts(spark, d).degrees()


@_query("degree_hist", _with("parts_suppliers", f"SELECT degree, count(*)::BIGINT AS cnt FROM ({_DEGREE}) GROUP BY degree"))
def degree_hist(spark: SparkSession, d: str) -> DataFrame:
    return fx.parts_suppliers(spark, d).degrees().groupBy("degree").agg(F.count(F.lit(1)).alias("cnt"))


@_query("hubs", "SELECT dst AS id, count(*)::BIGINT AS degree FROM (SELECT (2 * l_partkey + 1) % 3 AS dst FROM lineitem) GROUP BY dst HAVING count(*) > 1024")
def hubs(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of more than 1,024 edges, among three that share all order lines."""
    lines = fx.orders_parts(spark, d).edges
    return Graph.from_edges(lines.select((F.col("dst") % 3).alias("src"), F.col("src").alias("dst"))).degrees().filter("degree > 1024")


@_query("pagerank_in", _pagerank_sql("orders_parts", 5, turned=True))
def pagerank_in(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of orders and their parts, pulled along edges that come in."""
    return pagerank.pagerank(fx.orders_parts(spark, d), 5, direction="in").select("id", F.round("rank", 6).alias("rank"))


@_query("symmetrize", _with("orders_parts", "SELECT src, dst, count(*)::BIGINT AS mult FROM (SELECT * FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst) GROUP BY src, dst"))
def symmetrize(spark: SparkSession, d: str) -> DataFrame:
    return fx.orders_parts(spark, d).symmetrized().edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"))


@_query("dedup_edges", _with("orders_parts", "SELECT DISTINCT src, dst FROM e"))
def dedup_edges(spark: SparkSession, d: str) -> DataFrame:
    return fx.orders_parts(spark, d).deduplicated().edges


@_query("drop_self_loops", "SELECT (l_partkey % 97)::BIGINT AS src, (l_suppkey % 97)::BIGINT AS dst FROM lineitem WHERE l_partkey % 97 <> l_suppkey % 97")
def drop_self_loops(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return Graph.from_edges(lines.select((F.col("l_partkey") % 97).alias("src"), (F.col("l_suppkey") % 97).alias("dst"))).without_loops().edges


@_query("undirected", _with("orders_parts", "SELECT src, dst FROM e UNION SELECT dst, src FROM e"))
def undirected(spark: SparkSession, d: str) -> DataFrame:
    return fx.orders_parts(spark, d).undirected().edges


@_query("shift_ids", _with("orders_parts", "SELECT src - 1 AS src, dst - 1 AS dst FROM e"))
def shift_ids(spark: SparkSession, d: str) -> DataFrame:
    return fx.orders_parts(spark, d).shifted(-1).edges


@_query("first_seen_encode", "SELECT raw, row_number() OVER (ORDER BY place) - 1 AS id FROM (SELECT raw, min(place) AS place FROM (SELECT 2 * o_custkey AS raw, 2 * o_orderkey AS place FROM orders UNION ALL SELECT 2 * o_orderkey + 1, 2 * o_orderkey + 1 FROM orders) GROUP BY raw)")
def first_seen_encode(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return first_seen(orders.select((2 * F.col("o_custkey")).alias("src"), (2 * F.col("o_orderkey") + 1).alias("dst"), "o_orderkey"), "o_orderkey")[1]


@_query("adjacency", _with("sparse_all", "SELECT id, count(dst)::BIGINT AS degree, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS nbrs FROM v LEFT JOIN e ON src = id GROUP BY id"))
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return fx.sparse_all(spark, d).adjacency().withColumn("nbrs", F.array_join(F.col("nbrs").cast("array<string>"), " "))


@_query("adjacency_all", _with("parts_suppliers", "SELECT id, count(dst)::BIGINT AS degree, coalesce(string_agg(dst::VARCHAR, ' ' ORDER BY dst), '') AS nbrs FROM v LEFT JOIN e ON src = id GROUP BY id"))
def adjacency_all(spark: SparkSession, d: str) -> DataFrame:
    return fx.parts_suppliers(spark, d).adjacency().withColumn("nbrs", F.array_join(F.col("nbrs").cast("array<string>"), " "))


@_query("neighbors_of", _with("parts_suppliers", "SELECT src, dst FROM e WHERE src IN (SELECT 2 * p_partkey FROM part WHERE p_size = 7)"))
def neighbors_of(spark: SparkSession, d: str) -> DataFrame:
    keys = spark.read.parquet(f"{d}/part.parquet").filter("p_size = 7").select((2 * F.col("p_partkey")).alias("id"))
    return fx.parts_suppliers(spark, d).neighbours(keys)


def _small_parts(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").filter("p_size <= 5").select((2 * F.col("p_partkey")).alias("id"))


_FRONTIER = "f AS (SELECT 2 * p_partkey AS id FROM part WHERE p_size <= 5)"


@_query("edge_map", f"WITH {fx.sql('parts_suppliers')}, {_FRONTIER} SELECT dst AS id, count(*)::BIGINT AS n, sum(src)::BIGINT AS total FROM f JOIN e ON src = f.id WHERE dst % 4 = 1 GROUP BY dst")
def edge_map_query(spark: SparkSession, d: str) -> DataFrame:
    sent = edge_map(_small_parts(spark, d), fx.parts_suppliers(spark, d).edges, F.col("dst") % 4 == 1, value=F.col("src"))
    return gather(sent, n=F.count(F.lit(1)), total=F.sum("value"))


@_query("vertex_map", f"WITH {fx.sql('parts_suppliers')}, {_FRONTIER} SELECT src AS id, count(*)::BIGINT AS n, min(dst)::BIGINT AS low, max(dst)::BIGINT AS high FROM f JOIN e ON src = f.id GROUP BY src")
def vertex_map_query(spark: SparkSession, d: str) -> DataFrame:
    return vertex_map(_small_parts(spark, d), fx.parts_suppliers(spark, d).edges, n=F.count(F.lit(1)), low=F.min("dst"), high=F.max("dst"))


@_query("dense_map", f"WITH {fx.sql('parts_suppliers')}, {_FRONTIER} SELECT DISTINCT dst AS id FROM f JOIN e ON src = f.id")
def dense_map_query(spark: SparkSession, d: str) -> DataFrame:
    return dense_map(_small_parts(spark, d), fx.parts_suppliers(spark, d).edges)


_LEVELS = """b(id, level) USING KEY (id) AS (
  SELECT 0::BIGINT, 0 UNION
  SELECT e.dst, min(b.level + 1) FROM b JOIN e ON e.src = b.id WHERE NOT EXISTS (SELECT 1 FROM recurring.b r WHERE r.id = e.dst) GROUP BY 1)
SELECT id, level FROM b"""


@_query("bfs_levels", f"WITH RECURSIVE {fx.sql('parts_suppliers')}, {_LEVELS}")
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs(fx.parts_suppliers(spark, d))


@_query("bfs_levels_directed", f"WITH RECURSIVE {fx.sql('geography')}, {_LEVELS}")
def bfs_levels_directed(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs(fx.geography(spark, d))


@_query("bfs_count", f"WITH RECURSIVE {fx.sql('parts_suppliers')}, {_REACH} SELECT count(*)::BIGINT AS visited FROM r")
def bfs_count(spark: SparkSession, d: str) -> DataFrame:
    return reach.bfs_count(fx.parts_suppliers(spark, d))


@_query("dfs_count", f"WITH RECURSIVE {fx.sql('geography')}, {_REACH} SELECT count(*)::BIGINT AS visited FROM r")
def dfs_count(spark: SparkSession, d: str) -> DataFrame:
    return reach.dfs_count(fx.geography(spark, d))


@_query("reach_within", f"WITH RECURSIVE {fx.sql('parts_suppliers')}, r(id, hops) AS (SELECT 0::BIGINT, 0 UNION SELECT e.dst, hops + 1 FROM r JOIN e ON e.src = r.id WHERE hops < 3) SELECT id, min(hops)::INTEGER AS hops FROM r GROUP BY id")
def reach_within(spark: SparkSession, d: str) -> DataFrame:
    """What three hops from part 0 reach: one recursive query."""
    return reach.within(fx.parts_suppliers(spark, d), spark.range(1), 3)


@_query(
    "shortest_paths",
    """WITH RECURSIVE p AS (SELECT 2 * l_partkey AS a, 2 * l_suppkey + 1 AS b, min(l_quantity) AS weight FROM lineitem GROUP BY ALL),
e AS (SELECT a AS src, b AS dst, weight FROM p UNION ALL SELECT b, a, weight FROM p),
r(id, distance) USING KEY (id) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION
  SELECT e.dst, min(r.distance + e.weight) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r o ON o.id = e.dst GROUP BY e.dst HAVING min(r.distance + e.weight) < coalesce(min(o.distance), 'infinity'::DOUBLE))
SELECT id, distance FROM r""",
)
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Distances from part 0, an edge being as long as the least quantity that was ordered of it."""
    return programs.shortest_paths(fx.weighted(spark, d), 0)


@_query(
    "k_core",
    f"""WITH RECURSIVE {fx.sql('parts_suppliers')}, r(k, id) AS (SELECT 0, id FROM v UNION ALL
  SELECT r.k + 1, e.src FROM r JOIN e ON e.src = r.id JOIN r t ON t.id = e.dst WHERE r.k < 40 GROUP BY r.k, e.src HAVING count(*) >= 26)
SELECT id, count(*)::BIGINT AS degree FROM (SELECT id FROM r WHERE k = 40) JOIN e ON e.src = id WHERE e.dst IN (SELECT id FROM r WHERE k = 40) GROUP BY id""",
)
def k_core(spark: SparkSession, d: str) -> DataFrame:
    """Parts and suppliers that keep 26 partners among themselves."""
    return programs.k_core(fx.parts_suppliers(spark, d), 26)


_LABELS = """w(id, label) USING KEY (id) AS (
  SELECT id, id FROM v UNION
  SELECT e.dst, min(w.label) FROM w JOIN e ON e.src = w.id JOIN recurring.w r ON r.id = e.dst GROUP BY e.dst HAVING min(w.label) < min(r.label))"""


@_query("wcc_labels", f"WITH RECURSIVE {fx.sql('sparse_all')}, {_LABELS} SELECT id, label FROM w")
def wcc_labels(spark: SparkSession, d: str) -> DataFrame:
    return labels.wcc(fx.sparse_all(spark, d))


@_query("wcc_count", f"WITH RECURSIVE {fx.sql('sparse')}, {_LABELS} SELECT count(DISTINCT label)::BIGINT AS n FROM w")
def wcc_count(spark: SparkSession, d: str) -> DataFrame:
    return labels.count(labels.wcc(fx.sparse(spark, d)))


@_query("wcc_labels_all", f"WITH RECURSIVE {fx.sql('orders_parts')}, e2 AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), {_LABELS.replace('JOIN e ', 'JOIN e2 e ')} SELECT id, label FROM w")
def wcc_labels_all(spark: SparkSession, d: str) -> DataFrame:
    """Orders and parts that belong together, over all lines."""
    return labels.wcc(fx.orders_parts(spark, d))


@_query("wcc_count_all", f"WITH RECURSIVE {fx.sql('customers_orders')}, {_LABELS} SELECT count(DISTINCT label)::BIGINT AS n FROM w")
def wcc_count_all(spark: SparkSession, d: str) -> DataFrame:
    return labels.count(labels.wcc(fx.customers_orders(spark, d)))


@_query("wcc_sizes", f"WITH RECURSIVE {fx.sql('customers_orders')}, {_LABELS} SELECT label, count(*)::BIGINT AS size FROM w GROUP BY label")
def wcc_sizes(spark: SparkSession, d: str) -> DataFrame:
    return labels.sizes(labels.wcc(fx.customers_orders(spark, d)))


@_query("min_label_directed", f"WITH RECURSIVE {fx.sql('orders_parts')}, {_LABELS} SELECT id, label FROM w")
def min_label_directed(spark: SparkSession, d: str) -> DataFrame:
    return labels.min_label(fx.orders_parts(spark, d))


@_query("min_label_hashmin", f"WITH RECURSIVE {fx.sql('sparse')}, {_LABELS} SELECT id, label FROM w")
def min_label_hashmin(spark: SparkSession, d: str) -> DataFrame:
    return labels.min_label(fx.sparse(spark, d))


@_query("pagerank10", _pagerank_sql("parts_suppliers"))
def pagerank10(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(fx.parts_suppliers(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@_query("pagerank10_sparse", _pagerank_sql("sparse_all"))
def pagerank10_sparse(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(fx.sparse_all(spark, d)).select("id", F.round("rank", 6).alias("rank"))


@_query("pagerank_node0", _pagerank_sql("parts_suppliers", where="id = 0"))
def pagerank_node0(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank(fx.parts_suppliers(spark, d)).filter("id = 0").select("id", F.round("rank", 6).alias("rank"))


def _delta_sql(graph: str, steps: int, eps: float = 0.01) -> str:
    out = [f"g AS ({_DEGREE})", "q0 AS MATERIALIZED (SELECT id, degree, CASE WHEN degree > 0 THEN 1.0::DOUBLE / degree END AS p, degree > 0 AS active FROM g)"]
    for k in range(1, steps + 1):
        out.append(f"n{k} AS MATERIALIZED (SELECT q.id, q.degree, CASE WHEN q.active THEN (0.15 + 0.85 * coalesce(s, 0)) / q.degree ELSE q.p END AS p, q.p AS old, q.active AS was FROM q{k - 1} q LEFT JOIN (SELECT e.src, sum(x.p) AS s FROM e JOIN q{k - 1} x ON x.id = e.dst GROUP BY e.src) ON src = q.id)")
        out.append(f"q{k} AS MATERIALIZED (SELECT id, degree, p, degree > 0 AND id IN (SELECT e.dst FROM e JOIN n{k} ON n{k}.id = e.src WHERE was AND abs(p - old) > {eps}) AS active FROM n{k})")
    return f"WITH {fx.sql(graph)}, {', '.join(out)} SELECT id, round(CASE WHEN degree > 0 THEN p * degree ELSE 0.15 END, 6) AS rank FROM q{steps}"


@_query("pagerank_delta", _delta_sql("parts_suppliers", 14))
def pagerank_delta(spark: SparkSession, d: str) -> DataFrame:
    return pagerank.pagerank_delta(fx.parts_suppliers(spark, d)).select("id", F.round("rank", 6).alias("rank"))


def _walk_sql(graph: str, walkers: int, steps: int, last: str) -> str:
    draw = lambda w, k, n: f"((({w} * 1103515245 + {k} * 134775813 + 42 * 69069) % 2147483648) // 256 % {n})"
    out = ["o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM e)", "g AS (SELECT src AS v, count(*) AS degree, row_number() OVER (ORDER BY src) - 1 AS place FROM e GROUP BY src)"]
    out.append(f"w0 AS (SELECT r.range AS walker, 0 AS step, g.v FROM range({walkers}) r JOIN g ON g.place = {draw('r.range', 0, '(SELECT count(*) FROM g)')})")
    for k in range(1, steps + 1):
        out.append(f"w{k} AS (SELECT w.walker, {k} AS step, o.dst AS v FROM w{k - 1} w JOIN g ON g.v = w.v JOIN o ON o.src = w.v AND o.k = {draw('w.walker', k, 'g.degree')})")
    every = " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(steps + 1))
    return f"WITH {fx.sql(graph)}, {', '.join(out)}, every AS ({every}) {last}"


@_query("random_walk", _walk_sql("sparse", WALKERS, STEPS, "SELECT walker, step, v FROM every"))
def random_walk(spark: SparkSession, d: str) -> DataFrame:
    return walk.random_walk(fx.sparse(spark, d), WALKERS, STEPS)


@_query("random_walk_visits", _walk_sql("orders_parts", 1000, 3, "SELECT count(*)::BIGINT AS visited FROM every WHERE step < 4"))
def random_walk_visits(spark: SparkSession, d: str) -> DataFrame:
    """Walkers stop on parts, which have no out-edges."""
    return walk.walk_visits(fx.orders_parts(spark, d), 1000, 4)


def _long_walk_sql(graph: str, last: str) -> str:
    """Walks of 1,000 walkers over |V| / 1,000 steps, as a recursion."""
    draw = lambda w, k, n: f"((({w} * 1103515245 + {k} * 134775813 + 42 * 69069) % 2147483648) // 256 % {n})"
    return f"""WITH RECURSIVE {fx.sql(graph)}, o AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM e),
g AS (SELECT src AS v, count(*) AS degree, row_number() OVER (ORDER BY src) - 1 AS place FROM e GROUP BY src),
w(walker, step, v) AS (SELECT r.range, 0, g.v FROM range(1000) r JOIN g ON g.place = {draw("r.range", 0, "(SELECT count(*) FROM g)")} UNION ALL
  SELECT w.walker, w.step + 1, o.dst FROM w JOIN g ON g.v = w.v JOIN o ON o.src = w.v AND o.k = {draw("w.walker", "(w.step + 1)", "g.degree")} WHERE w.step < (SELECT count(*) FROM v) // 1000)
{last}"""


@_query("random_walk_all", _long_walk_sql("parts_suppliers", "SELECT walker, step, v FROM w"))
def random_walk_all(spark: SparkSession, d: str) -> DataFrame:
    """1,000 walkers over all pairs, which have no sinks, and |V| / 1,000 steps."""
    return walk.random_walk(fx.parts_suppliers(spark, d), 1000)


@_query("random_walk_visits_all", _long_walk_sql("parts_suppliers", "SELECT count(*)::BIGINT AS visited FROM w WHERE step < (SELECT count(*) FROM v) // 1000"))
def random_walk_visits_all(spark: SparkSession, d: str) -> DataFrame:
    """The reference's default: 1,000 walkers and |V| / 1,000 steps."""
    return walk.walk_visits(fx.parts_suppliers(spark, d), 1000)


@_query("log_summary", "SELECT event_type AS algo_name, user_id % 8 AS thread, round(avg((value * 1000)::BIGINT * 1e-6), 6) AS avg_s FROM events GROUP BY ALL")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark runs: user as thread count, value as time."""
    events = spark.read.parquet(f"{d}/events.parquet")
    log = events.select(F.col("event_type").alias("algo_name"), (F.col("user_id") % 8).alias("thread"), F.bround(F.col("value") * 1000).cast("long").alias("time"))
    return harness.summarize(log).withColumn("avg_s", F.round("avg_s", 6))


def _dense(graph: Graph) -> Graph:
    """The graph with ids 0..V-1, as adjacency formats need."""
    edges, ids = first_seen(graph.edges, F.struct("src", "dst"))
    return Graph(written(ids.select("id")), written(edges))


_DENSE_SQL = (
    ", n AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) AS k FROM e),"
    " s AS (SELECT raw, row_number() OVER (ORDER BY min(k)) - 1 AS id FROM (SELECT src AS raw, 2 * k AS k FROM n UNION ALL SELECT dst, 2 * k + 1 FROM n) GROUP BY raw)"
    " SELECT a.id AS src, b.id AS dst FROM e JOIN s a ON a.raw = e.src JOIN s b ON b.raw = e.dst"
)


def _round_trip(fmt: str, of):
    def run(spark: SparkSession, d: str) -> DataFrame:
        # ids of an edge list are any; they are numbered when it is read, in the order of the lines
        graph, path = of(spark, d) if fmt == "edgelist" else _dense(of(spark, d)), f"{shared_dir(spark)}.{fmt}"
        writer = getattr(sources, f"write_{fmt}")
        writer(graph, path, both=False) if fmt == "binedge" else writer(graph, path)
        return sources.read_graph(spark, path).edges

    return run


for _fmt in ("adjlist", "edgelist", "binedge", "binadj"):
    _query(f"round_trip_{_fmt}", f"WITH {fx.sql('sparse')}{_DENSE_SQL}")(_round_trip(_fmt, fx.sparse))
    _query(f"round_trip_{_fmt}_all", f"WITH {fx.sql('customers_orders')}{_DENSE_SQL}")(_round_trip(_fmt, fx.customers_orders))


@_query("round_trip_binedge_both", f"WITH {fx.sql('orders_parts')}, d AS (WITH x AS (SELECT 1){_DENSE_SQL}) SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d WHERE src <> dst")
def round_trip_binedge_both(spark: SparkSession, d: str) -> DataFrame:
    """A directed multigraph, written as is usual: each edge in both directions."""
    path = f"{shared_dir(spark)}.binedge"
    sources.write_binedge(_dense(fx.orders_parts(spark, d)), path)
    return sources.read_graph(spark, path).edges


@_query("binadj_range", f"WITH {fx.sql('customers_orders')}, d AS (WITH x AS (SELECT 1){_DENSE_SQL}) SELECT src, dst FROM d WHERE src <= 99")
def binadj_range(spark: SparkSession, d: str) -> DataFrame:
    """All pairs written as a binary adjacency list, and the edges of its first hundred vertices read by the offset index."""
    path = f"{shared_dir(spark)}.binadj"
    sources.write_binadj(_dense(fx.customers_orders(spark, d)), path)
    formats.register(spark)
    return spark.read.format("binadj").option("most", 99).load(path)


@_query("save_load", _with("orders_parts", "SELECT src, dst, count(*)::BIGINT AS mult FROM e GROUP BY src, dst"))
def save_load(spark: SparkSession, d: str) -> DataFrame:
    path = shared_dir(spark)
    sources.save(fx.orders_parts(spark, d), path)
    return sources.load(spark, path).edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"))


@_query("save_load_stats", _with("orders_parts", "SELECT (SELECT count(*) FROM v)::BIGINT AS num_nodes, (SELECT count(*) FROM e)::BIGINT AS num_edges, (SELECT count(*) FROM v)::BIGINT AS saved_nodes"))
def save_load_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics kept beside the tables, and the number of vertices in them."""
    path = shared_dir(spark)
    sources.save(fx.orders_parts(spark, d), path)
    saved = sources.load(spark, path).vertices.agg(F.count(F.lit(1)).alias("saved_nodes"))
    return sources.load_stats(spark, path).join(saved, F.lit(True))  # two single rows


@_query("log_csv", "SELECT event_type AS algo_name, user_id % 64 AS cache_mb, 'events' AS dataset, 'all' AS algo, 'cache' AS testcase, count(*)::BIGINT AS runs, round(avg((value * 1000)::BIGINT * 1e-6), 6) AS avg_s FROM events GROUP BY ALL")
def log_csv(spark: SparkSession, d: str) -> DataFrame:
    """Events as benchmark runs, written as CSV and read again."""
    events, path = spark.read.parquet(f"{d}/events.parquet"), f"{shared_dir(spark)}/events_all_cache.csv"
    log = events.select(F.col("event_type").alias("algo_name"), F.lit(1).alias("thread"), (F.col("user_id") % 64).cast("int").alias("cache_mb"), F.bround(F.col("value") * 1000).cast("long").alias("time"), F.col("value").alias("res"))
    harness.write_log(log, path)
    back = harness.read_log(spark, path)
    named = back.groupBy("algo_name", "cache_mb", "dataset", "algo", "testcase").agg(F.count(F.lit(1)).alias("runs"))
    seconds = harness.summarize(back, "cache_mb").withColumn("avg_s", F.round("avg_s", 6))
    return named.join(seconds, ["algo_name", "cache_mb"]).select(F.col("cache_mb").cast("long").alias("cache_mb"), "algo_name", "dataset", "algo", "testcase", "runs", "avg_s")


def _invariants(graph: Graph) -> DataFrame:
    """num_nodes; edges without their reverse, loops, repeated edges and vertices unknown, which should all be 0."""
    e = graph.edges
    alone = e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count_if(F.col("src") < F.col("dst")).alias("up"), F.count_if(F.col("src") > F.col("dst")).alias("down"))
    bad = alone.agg(F.count_if(F.col("up") != F.col("down")).alias("asymmetric"), F.count_if(F.col("a") == F.col("b")).alias("loops"), F.count_if(F.col("up") > 1).alias("repeated"))
    unknown = e.join(graph.vertices, e.src == graph.vertices.id, "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    return graph.stats().select("num_nodes").join(bad, F.lit(True)).join(unknown, F.lit(True))  # single rows


_SOUND = "SELECT count(*)::BIGINT AS num_nodes, 0::BIGINT AS asymmetric, 0::BIGINT AS loops, 0::BIGINT AS repeated, 0::BIGINT AS unknown FROM part"


@_query("gen_er_like", None)
def gen_er_like(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of a random graph over as many vertices as there are parts."""
    return generate.erdos_renyi(spark, spark.read.parquet(f"{d}/part.parquet").count()).degrees()


@_query("gen_er_sound", _SOUND)
def gen_er_sound(spark: SparkSession, d: str) -> DataFrame:
    """What holds of every simple undirected graph holds of a random one over as many vertices as there are parts."""
    return _invariants(generate.erdos_renyi(spark, spark.read.parquet(f"{d}/part.parquet").count()))


@_query("gen_ba_like", None)
def gen_ba_like(spark: SparkSession, d: str) -> DataFrame:
    """Degrees of a preferential-attachment graph over as many vertices as there are parts."""
    return generate.barabasi_albert(spark, spark.read.parquet(f"{d}/part.parquet").count(), 5).degrees()


@_query("gen_ba_sound", _SOUND.replace(" FROM part", ", 0::BIGINT AS poor FROM part"))
def gen_ba_sound(spark: SparkSession, d: str) -> DataFrame:
    """As `gen_er_sound`; poor are vertices without edges, of which preferential attachment makes none."""
    graph = generate.barabasi_albert(spark, spark.read.parquet(f"{d}/part.parquet").count(), 5)
    return _invariants(graph).join(graph.degrees().agg(F.count_if(F.col("degree") == 0).alias("poor")), F.lit(True))  # single rows


_SHIPPED = "SELECT (2 * l_partkey)::BIGINT AS src, (2 * l_suppkey + 1)::BIGINT AS dst FROM lineitem WHERE l_returnflag"


@_query("graph_difference", f"{_SHIPPED} = 'N' EXCEPT ALL {_SHIPPED} <> 'N'")
def graph_difference(spark: SparkSession, d: str) -> DataFrame:
    """Shipments that were kept, each as often as it is beyond those that were looked at for return."""
    return fx.shipments(spark, d, "l_returnflag = 'N'").minus(fx.shipments(spark, d, "l_returnflag <> 'N'")).edges


@_query("graph_common", f"SELECT src, dst, count(*)::BIGINT AS mult FROM ({_SHIPPED} = 'N' INTERSECT ALL {_SHIPPED} <> 'N') GROUP BY src, dst")
def graph_common(spark: SparkSession, d: str) -> DataFrame:
    both = fx.shipments(spark, d, "l_returnflag = 'N'").common(fx.shipments(spark, d, "l_returnflag <> 'N'"))
    return both.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("mult"))


@_query("neighbour_h_index", f"WITH {fx.sql('parts_suppliers')}, g AS ({_DEGREE}), n AS (SELECT e.src, g.degree, row_number() OVER (PARTITION BY e.src ORDER BY g.degree DESC) AS place FROM e JOIN g ON g.id = e.dst) SELECT src AS id, max(least(degree, place))::BIGINT AS h FROM n GROUP BY src")
def neighbour_h_index(spark: SparkSession, d: str) -> DataFrame:
    """The largest h for each vertex such that h of its neighbours have h edges or more: a callback over degrees that Spark has counted."""
    graph = fx.parts_suppliers(spark, d)
    edges = written(graph.edges, spreads=True)
    # edges lead both ways, so that every vertex has some
    degrees = edges.groupBy(F.col("src").alias("dst")).agg(F.count(F.lit(1)).alias("degree"))
    counted = edges.join(degrees, "dst").groupBy(F.col("src").alias("id"), F.col("degree").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return vertex_apply(counted, h_index, "id long, h long", order=("-value",))


_LAST_DAY = "SELECT 2 * o_orderkey AS id FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)"
_HEAVY = "SELECT 2 * p_partkey + 1 AS id FROM part WHERE p_size = (SELECT max(p_size) FROM part) AND p_retailprice = (SELECT max(p_retailprice) FROM part WHERE p_size = (SELECT max(p_size) FROM part))"


@_query("point_read_out", _with("orders_parts", f"SELECT src, dst FROM e WHERE src IN ({_LAST_DAY})"))
def point_read_out(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the last day's orders, read from a saved graph by what Parquet keeps of sources."""
    path, orders = shared_dir(spark), spark.read.parquet(f"{d}/orders.parquet")
    sources.save(fx.orders_parts(spark, d), path)
    last = orders.join(orders.agg(F.max("o_orderdate").alias("o_orderdate")), "o_orderdate", "left_semi")
    return sources.edges_at(spark, path, last.select((2 * F.col("o_orderkey")).alias("id")))


@_query("point_read_in", _with("orders_parts", f"SELECT src, dst FROM e WHERE dst IN ({_HEAVY})"))
def point_read_in(spark: SparkSession, d: str) -> DataFrame:
    """The lines of the dearest of the largest parts, by what it keeps of destinations, among which edges are not sorted."""
    path, part = shared_dir(spark), spark.read.parquet(f"{d}/part.parquet")
    sources.save(fx.orders_parts(spark, d), path)
    dearest = part.agg(F.max(F.struct("p_size", "p_retailprice")).alias("m")).select("m.*")
    return sources.edges_at(spark, path, part.join(dearest, ["p_size", "p_retailprice"], "left_semi").select((2 * F.col("p_partkey") + 1).alias("id")), "dst")


_MD5_DRAW = "('0x' || substr(md5('42:' || {} || ':{}'), 1, 15))::BIGINT % (SELECT count(*) FROM customer)"


@_query("gen_er_orders", f"WITH d AS (SELECT {_MD5_DRAW.format('o_orderkey', 0)} AS a, {_MD5_DRAW.format('o_orderkey', 1)} AS b FROM orders), e AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM d WHERE a <> b) SELECT a AS src, b AS dst FROM e UNION ALL SELECT b, a FROM e")
def gen_er_orders(spark: SparkSession, d: str) -> DataFrame:
    """A uniform random graph over as many vertices as there are customers, an edge drawn for each order."""
    customers = spark.read.parquet(f"{d}/customer.parquet").count()
    return generate.uniform(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("key")), customers).edges


_FOLLOW = """n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS e FROM orders),
f(e, p) AS (SELECT e, (2 * e + 1)::UBIGINT FROM n UNION ALL
  SELECT e, xor(y, y >> 32) % p FROM (SELECT e, p, ((xor(x, x >> 29)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS y
    FROM (SELECT e, p, ((p::UHUGEINT * 11400714819323198485::UHUGEINT + 42) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM f WHERE p % 2 = 1 AND p // 2 >= 5)))"""


@_query("gen_ba_orders", f"WITH RECURSIVE {_FOLLOW} SELECT n.o_orderkey, 5 + n.e // 5 AS src, (CASE WHEN p % 2 = 0 THEN 5 + p // 2 // 5 ELSE p // 2 END)::BIGINT AS dst FROM f JOIN n ON n.e = f.e WHERE p % 2 = 0 OR p // 2 < 5")
def gen_ba_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as edges of a graph that grows by preferential attachment in the order of their keys, five a vertex."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    return generate.attached(numbered(orders, "o_orderkey", name="e"), 5).select("o_orderkey", "src", "dst")

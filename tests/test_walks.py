"""Walks of many steps: no job for a step, records in several files, vertices that lead nowhere."""

import uuid

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from graphweave.functions import draw, drawn
from graphweave.graph import Graph
from graphweave.plans import walk
from graphweave.sources import records
from tests.test_graph import graph, pairs, random_edges


def steps_of(edges, walkers, steps):
    """All rows of a walk; null comes after all numbers and leads nowhere."""
    near = {}
    last = lambda v: (v is None, v or 0)
    for a, b in sorted(edges, key=lambda e: (last(e[0]), last(e[1]))):
        near.setdefault(a, []).append(b)
    number = lambda w, k, n: (w * 1103515245 + k * 134775813 + 42 * 69069) % 2147483648 // 256 % n
    rows = set()
    for w in range(walkers):
        v = list(near)[number(w, 0, len(near))]
        rows.add((w, 0, v))
        for k in range(1, steps + 1):
            if v is None or v not in near:
                break
            v = near[v][number(w, k, len(near[v]))]
            rows.add((w, k, v))
    return rows


def rows_of(df):
    got = [(r.walker, r.step, r.v) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def jobs_of(spark, run):
    name = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("run", [walk.random_walk, walk.walk_visits])
def test_steps_are_no_jobs(spark, run):
    g = graph(spark, random_edges(4, 30, 90)).undirected()
    few, many = (jobs_of(spark, lambda k=k: run(g, 7, k).collect()) for k in (2, 60))
    assert few == many > 0


def test_records_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_BITS", 3)
    monkeypatch.setattr(records, "OPEN", 2)
    monkeypatch.setattr(walk, "ROWS", 50)
    edges = random_edges(8, 60, 150)
    assert rows_of(walk.random_walk(graph(spark, edges), 30, 40)) == steps_of(edges, 30, 40)


@pytest.mark.parametrize("joined", [False, True])
def test_sinks_and_nulls(spark, monkeypatch, joined):
    """Parallel edges count; a store that Arrow does not know has its steps joined, with the same rows."""
    if joined:
        monkeypatch.setattr(walk, "shared_folder", lambda spark: None)
    edges = [(1, 2), (1, 2), (1, None), (2, 3), (2, 1), (None, 1), (4, 4), (5, 1), (5, None)]
    want = steps_of(edges, 50, 9)
    assert {v for _, _, v in want} == {1, 2, 3, 4, 5, None}
    assert rows_of(walk.random_walk(graph(spark, edges), 50, 9)) == want
    assert rows_of(walk.random_walk(graph(spark, edges), 50, 0)) == steps_of(edges, 50, 0)


def test_steps_by_vertices(spark):
    """|V| counts sinks, and isolated vertices that a graph lists."""
    star = [(0, k) for k in range(1, 40)]
    assert max(r.step for r in walk.random_walk(graph(spark, star).symmetrized(), 4).collect()) == 10
    assert pairs(walk.walk_visits(graph(spark, star).symmetrized(), 4)) == {(40,)}
    assert pairs(walk.walk_visits(graph(spark, star), 4)) == {(8,)}
    loop = Graph.from_edges(spark.createDataFrame([(0, 0)], "src long, dst long"), declared=12)
    assert pairs(walk.walk_visits(loop, 4)) == {(12,)}
    assert pairs(walk.walk_visits(graph(spark, star), 50)) == {(0,)}


def test_draws_of_tasks_are_those_of_columns(spark):
    df = spark.range(0, 10**9, 10**7 + 19).select("id", (F.col("id") % 977 + 1).alias("size"), draw(F.col("id"), F.lit(123_456), F.col("id") % 977 + 1).alias("k")).toPandas()
    assert (drawn(df["id"].to_numpy(), 123_456, df["size"].to_numpy()) == df["k"]).all()


def test_a_cut_file_is_told(spark, tmp_path):
    rows = spark.range(20).select("id", F.col("id").alias("x"))
    with pytest.raises(RuntimeError, match="records"):
        records.write_records(rows, "id", 21, str(tmp_path / "r"))
    kept = records.write_records(rows, "id", 20, f"file://{tmp_path}/s")
    assert kept.reader()(np.array([7, 0, 19, 7])).ravel().tolist() == [7, 0, 19, 7]
    kept.release(spark)
    assert not (tmp_path / "s").exists()


def test_other_stores_are_read_by_threads(spark, tmp_path, monkeypatch):
    """In the order of the places, and of files that are opened anew meanwhile."""
    monkeypatch.setattr(records, "FILE_BITS", 2)
    monkeypatch.setattr(records, "OPEN", 2)
    rows = spark.range(50).select("id", (F.col("id") * 3).alias("x"), (-F.col("id")).alias("y"))
    kept = records.write_records(rows, "id", 50, str(tmp_path / "r"), 150)
    monkeypatch.setattr(records, "_opened", lambda path: (fs.SubTreeFileSystem("/", fs.LocalFileSystem()), path.lstrip("/")))
    places = np.random.default_rng(1).integers(0, 50, 2000)
    assert kept.kind == "<i4" and (kept.reader()(places) == np.stack([places * 3, -places], 1)).all()

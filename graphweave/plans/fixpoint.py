"""One loop for all fix points: supersteps that write what changed, until nothing does.

A step is a plan; what it gives is written, counted while it is written, and read by the next step. What
steps give is kept as changes beside a table of first values, and merged into it every `MERGE` steps, so
that a superstep writes the vertices that changed and not all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.layout import EdgeTable, bucketed
from graphweave.plans.stages import discard, measured

#: Steps whose changes become one table.
MERGE = 8


def loop(first: DataFrame, step: Callable[[int, DataFrame], DataFrame], most: int | None = None, kept: Callable[[DataFrame], None] | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """The last table of step(k, table) for k = 1, 2, ..., and its metrics.

    It ends when a table has no row, or its metric `left` is 0, or after `most` steps. `kept` gets each
    table but the last and then owns it; without it a table is deleted when the next one is written.
    """
    rows, seen = measured(first, **metrics)
    k = 0
    while seen["n"] and seen.get("left", 1) and (most is None or k < most):
        k += 1
        before = rows
        rows, seen = measured(step(k, before), **metrics)
        if kept is None:
            discard(before)
        else:
            kept(before)
    return rows, seen


class State:
    """Values by vertex: a bucketed table of id and columns, and the changes of the steps since."""

    def __init__(self, first: DataFrame, buckets: int):
        self.buckets, self.base, self.changes = buckets, bucketed(first, ["id"], buckets), []
        self.columns = [c for c in self.base.columns if c != "id"]

    def _latest(self) -> DataFrame | None:
        """The last change of each changed vertex."""
        steps = [c.select("id", *self.columns, F.lit(k).alias("_step")) for k, c in enumerate(self.changes)]
        if len(steps) < 2:
            return steps[0].drop("_step") if steps else None
        values = F.max_by(F.struct(*self.columns), "_step").alias("_now")
        return reduce(DataFrame.unionByName, steps).groupBy("id").agg(values).select("id", "_now.*")

    def _merged(self, rows: DataFrame) -> DataFrame:
        latest = self._latest()
        if latest is None:
            return rows
        now = latest.select("id", F.struct(*self.columns).alias("_now"))
        return rows.join(now, "id", "left").withColumns({c: F.when(F.col("_now").isNotNull(), F.col("_now")[c]).otherwise(F.col(c)) for c in self.columns}).drop("_now")

    def of(self, messages: DataFrame) -> DataFrame:
        """messages(id, ...) of known vertices, with the vertices' values."""
        return self._merged(messages.join(self.base, "id"))

    def all(self) -> DataFrame:
        return self._merged(self.base)

    def add(self, change: DataFrame) -> None:
        """Takes a written table of changed rows; it is deleted when a later call merges it."""
        if len(self.changes) == MERGE:
            merged = bucketed(self.all(), ["id"], self.buckets)
            for old in (self.base, *self.changes):
                discard(old)
            self.base, self.changes = merged, []
        self.changes.append(change.select("id", *self.columns))


def vertex_program(first: DataFrame, edges: EdgeTable, send: dict[str, Column], gather: dict[str, Column], apply: dict[str, Column], changed: Column, sends: Column | None = None, most: int | None = None) -> DataFrame:
    """id and the columns of `first` when no vertex sends anything any more, or after `most` supersteps.

    Vertices that changed, and for which `sends` holds if it is given, send the columns of `send` along
    their edges, evaluated over their values, those of the edge and `at`, their id; at first all vertices
    count as changed. A vertex gathers what it is sent by the aggregates of `gather`; where `changed`
    holds, over its values and what it gathered, it takes the values of `apply`.
    """
    state = State(first, edges.buckets)
    sends = F.lit(True) if sends is None else sends

    def step(k: int, before: DataFrame) -> DataFrame:
        if k > 1:
            state.add(before)
        sent = edges.meet(before.filter(sends)).select("id", *(c.alias(name) for name, c in send.items()))
        got = sent.groupBy("id").agg(*(c.alias(name) for name, c in gather.items()))
        moved = state.of(got).filter(changed)
        return moved.select("id", *(apply.get(c, F.col(c)).alias(c) for c in state.columns))

    rows, seen = loop(state.base.filter(sends), step, most, kept=lambda table: None, left=F.count_if(sends))
    if seen["n"]:
        state.add(rows)
    return state.all()

"""Callbacks over vertices and their neighbours, for what no expression over columns says.

A callback gets the rows of many vertices at once as numpy arrays, sorted by vertex, and where each vertex
begins, so that it can be written without a loop over vertices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from graphweave.plans.stages import ship

#: Rows that one call gets, about; in pieces no more of a vertex.
PIECE = 100_000

#: (ids, starts, columns) -> columns of the result: the rows of ids[k] are starts[k] up to starts[k + 1].
Callback = Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]]


def _calls(batches: Iterator[pa.RecordBatch], most: int, whole: bool) -> Iterator[dict[str, np.ndarray]]:
    """The columns of sorted batches in chunks of about `most` rows, which end where a vertex does if `whole`."""
    held: list[dict[str, np.ndarray]] = []
    n = 0

    def joined() -> dict[str, np.ndarray]:
        return {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for b in batches:
        for at in range(0, b.num_rows, most):
            part = b.slice(at, most)
            held.append({c: part.column(c).to_numpy(zero_copy_only=False) for c in part.schema.names})
            n += part.num_rows
            if n < most:
                continue
            if not whole:
                rows = joined()
                for k in range(0, n - n % most, most):
                    yield {c: x[k : k + most] for c, x in rows.items()}
                held, n = [{c: x[n - n % most :] for c, x in rows.items()}], n % most
            elif held[0]["id"][0] != held[-1]["id"][-1]:  # else one vertex has all of it
                rows = joined()
                cut = int(np.searchsorted(rows["id"], rows["id"][-1]))
                yield {c: x[:cut] for c, x in rows.items()}
                held, n = [{c: x[cut:] for c, x in rows.items()}], n - cut
    if n:
        yield joined()


def vertex_apply(rows: DataFrame, call: Callback, schema: str, merge: dict[str, Column] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """What `call` gives for the vertices of rows(id, ...), no column of which is null.

    With `merge` a vertex's rows are given in pieces: all rows are dealt to sorted ranges, so a hub spans
    tasks, and no call gets more than `PIECE` rows; `call` returns `id` and partial results, which the
    aggregates of `merge` put together. Without it a call gets all rows of its vertices, sorted by `order`
    (names, a minus sign for descending); a vertex is then held by one task, and rows should be few a vertex.
    """
    keys = ["id", *(c for c in rows.columns if c != "id")]
    if merge is not None:
        dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    else:
        by = [rows[c[1:]].desc() if c.startswith("-") else rows[c] for c in order]
        dealt = rows.repartition("id").sortWithinPartitions("id", *by)
    most, whole = PIECE, merge is None

    def work(batches):
        for columns in _calls(batches, most, whole):
            ids = columns["id"]
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in call(ids[starts], starts, columns).items()})

    ship(rows.sparkSession)
    found = dealt.select(*keys).mapInArrow(work, schema)
    return found if merge is None else found.groupBy("id").agg(*(c.alias(k) for k, c in merge.items()))


def h_index(ids: np.ndarray, starts: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of rows (id, value, n), by value descending: the largest h such that h of the values (value n times) are h or more."""
    so_far = np.cumsum(columns["n"])
    before = np.concatenate([[0], so_far])[starts]
    reached = so_far - np.repeat(before, np.diff(np.append(starts, len(so_far))))
    return {"id": ids, "h": np.maximum.reduceat(np.minimum(columns["value"], reached), starts)}

"""Dense numbers without a single task that sees all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweave.plans.stages import written

_ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def numbered(df: DataFrame, *order: Column | str, name: str = "number", spreads: bool = False) -> DataFrame:
    """df with its rows numbered 0, 1, ... in that order, which must be total; `spreads` is that of `written`.

    Rows are dealt to sorted ranges; only the number of rows of each range goes to the driver.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(sorted_.withColumn("_row", F.monotonically_increasing_id()), spreads)
    return _offset(rows, name)


def _offset(rows: DataFrame, name: str) -> DataFrame:
    part = F.shiftright("_row", _ROW_BITS)
    sizes = sorted(rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before)], "_part long, _before long")
    # a row for each partition
    placed = rows.join(F.broadcast(offsets), part == F.col("_part"))
    return placed.withColumn(name, F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_row", "_part", "_before")


def first_seen(edges: DataFrame, order: Column | str) -> tuple[DataFrame, DataFrame]:
    """Edges with dense ids in order of first appearance, source before destination, and the dictionary (raw, id)."""
    place = F.struct(F.col(order) if isinstance(order, str) else order)
    seen = edges.select(F.posexplode(F.array("src", "dst")).alias("end", "raw"), place.alias("place"))
    first = seen.groupBy("raw").agg(F.min(F.struct("place", "end")).alias("first"))
    ids = written(numbered(first, "first", name="id").select("raw", "id"))
    coded = edges.select("src", "dst").join(ids.select(F.col("raw").alias("src"), F.col("id").alias("s")), "src").join(ids.select(F.col("raw").alias("dst"), F.col("id").alias("d")), "dst")
    return coded.select(F.col("s").alias("src"), F.col("d").alias("dst")), ids

"""Binary graph files as Spark data sources: `spark.read.format("binadj").load(path)`, likewise "binedge".

Partitions are splits of files. Those of an adjacency list know their vertices from the index that the
writer leaves beside each file, so that for a range of vertices only the splits that hold them are read.
The range is given by options, not taken from filters: Spark 4.1 keeps what was pushed into a Python
source with the DataFrame, and its next plan without a filter would lose rows. Register with `register(spark)`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphweave.plans.stages import ship
from graphweave.sources import _EDGES, SPLIT, _ints, _opened, indexed, lists_of


def files_of(path: str) -> list[tuple[str, int]]:
    """Path and length of a file, or of the part files of a folder, in the order of their names."""
    store, own = _opened(path)
    info = store.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(own))
    named = sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name[:1] not in "._")
    prefix = path[: len(path) - len(own)] if path.endswith(own) else ""
    return [(prefix + name, size) for name, size in named]


class Split(InputPartition):
    """Bytes of a file; of an adjacency list also the first vertex and the number of vertices in them."""

    def __init__(self, file: str, start: int, end: int, first: int = 0, n: int = 0):
        self.file, self.start, self.end, self.first, self.n = file, start, end, first, n


class _Source(DataSource):
    def schema(self) -> str:
        return "src long, dst long"


class BinEdge(_Source):
    """Pairs of little-endian int32."""

    @classmethod
    def name(cls) -> str:
        return "binedge"

    def reader(self, schema) -> DataSourceReader:
        return _Pairs(self.options["path"])


class BinAdj(_Source):
    """V and E, then each vertex's degree and neighbours; every file needs its index.

    Options: least and most, the vertices whose edges are read.
    """

    @classmethod
    def name(cls) -> str:
        return "binadj"

    def reader(self, schema) -> DataSourceReader:
        least, most = (self.options.get(k) for k in ("least", "most"))
        return _Lists(self.options["path"], int(least or 0), (1 << 63) - 1 if most is None else int(most))


class _Pairs(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Split]:
        return [Split(file, at, min(at + SPLIT, size)) for file, size in files_of(self.path) for at in range(0, size, SPLIT)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        for data in _ints(split.file, split.start, split.end):
            if len(data) % 2:
                raise ValueError(f"{split.file}: a pair is cut off")
            pairs = data.reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_EDGES)


class _Lists(DataSourceReader):
    def __init__(self, path: str, least: int, most: int):
        self.path, self.least, self.most = path, least, most

    def partitions(self) -> list[Split]:
        cuts = []
        for file, _ in files_of(self.path):
            known = indexed(file)
            if known is None:
                raise ValueError(f"{file} has no index of vertex offsets; read it with read_graph")
            cuts += [(file, *cut) for cut in known]
        firsts = [0, *accumulate(n for *_, n in cuts)]
        found = [Split(file, start, end, first, n) for (file, start, end, n), first in zip(cuts, firsts)]
        # one split at least, or Spark has nothing to plan
        return [s for s in found if s.first <= self.most and s.first + s.n > self.least] or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if split.n:
            for batch in lists_of(split.file, split.start, split.end, split.first):
                src = batch["src"].to_numpy()
                ok = (src >= self.least) & (src <= self.most)
                yield batch if ok.all() else batch.filter(pa.array(ok))


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session."""
    ship(spark)
    for source in (BinEdge, BinAdj):
        spark.dataSource.register(source)

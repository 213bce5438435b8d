"""Numbered records of a fixed length, for plans that read few of many, at places that they learn as they go.

A step of such a plan by a join or a filter is a job and a look at all rows; here it is one read of a few
bytes. Files lie in the folder that driver and executors share, are written by Spark and read by tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweave.plans.stages import discard_at, shared_dir, spread
from graphweave.sources import _opened, _write_ints

#: Records of a file are 2 to this power; files that a task holds open; reads at once from a store that is not local.
FILE_BITS, OPEN, READS = 20, 256, 32


def shared_folder(spark: SparkSession) -> str | None:
    """A new folder as `shared_dir` has it, if Arrow can read it: stores that only Hadoop knows have no reads inside Python tasks."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    try:
        _opened(path)
    except (OSError, ValueError, NotImplementedError):
        return None
    return path if path.startswith("file:") or "://" in path else None


@dataclass(frozen=True)
class Records:
    """Records 0, 1, ... of `width` whole numbers, in files that each hold the same number of them but the last."""

    path: str
    width: int
    kind: str
    bits: int

    def reader(self) -> Callable[[np.ndarray], np.ndarray]:
        """For use in a task: a function that gives the records at these places, a row for each."""
        (store, folder), kind, bits = _opened(self.path), np.dtype(self.kind), self.bits
        size = kind.itemsize * self.width

        @lru_cache(OPEN)
        def opened(k: int):
            return store.open_input_file(f"{folder}/part-{k:05d}")

        def one(place: int) -> bytes:
            return opened(place >> bits).read_at(size, (place & (1 << bits) - 1) * size)

        # what a local read takes is less than what a thread costs; elsewhere reads wait for the store
        each = map if isinstance(store, fs.LocalFileSystem) else ThreadPoolExecutor(READS).map
        return lambda places: np.frombuffer(b"".join(each(one, places.tolist())), kind).astype(np.int64).reshape(len(places), self.width)

    def release(self, spark: SparkSession) -> None:
        """Deletes the files."""
        discard_at(spark, self.path)


def write_records(rows: DataFrame, place: str, n: int, path: str, most: int | None = None) -> Records:
    """The columns of rows but `place`, which has the numbers 0..n-1, each once; `most` bounds what they hold, if that
    is known. A file is a task's, sorted by place."""
    bits, kind = FILE_BITS, "<i8" if most is None or most >= 1 << 31 else "<i4"
    files = max(1, -(-n // (1 << bits)))
    dealt = rows.repartitionById(files, F.shiftright(place, bits).cast("int")).sortWithinPartitions(place).drop(place)
    with spread(rows):
        _write_ints(dealt, path, kind=kind)
    made = Records(path, len(dealt.columns), kind, bits)
    store, folder = _opened(path)
    found = {x.base_name: x.size for x in store.get_file_info(fs.FileSelector(folder)) if x.base_name.startswith("part-")}
    size = np.dtype(kind).itemsize * made.width
    if found != {f"part-{k:05d}": size * min(1 << bits, n - (k << bits)) for k in range(files)}:
        raise RuntimeError(f"{path}: files do not hold the records that their names say")
    return made

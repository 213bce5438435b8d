"""Intermediate tables: the lineage cut between the steps of an iteration."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import ExitStack, contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a plan's input files that a shuffle partition gets, about, where `spread` holds.
SHARE = 8 << 20

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python workers need it and may have no copy."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # the driver serves it from here
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; where that is unset, in the warehouse folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting that holds for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame):
    """While it holds, shuffles have a partition for each `SHARE` of the files that df reads, where that is more
    than the session has, so that what a task sorts or hashes does not grow with the input. Adaptive execution
    puts small ones together. What Spark has no size of, as rows of the driver, counts as nothing."""
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    size = sum(n for n in sizes if n < 1 << 62)
    key = "spark.sql.shuffle.partitions"
    return setting(spark, key, str(max(int(spark.conf.get(key)), -(-size // SHARE))))


def written(df: DataFrame, spreads: bool = False) -> DataFrame:
    """df, written to a shared folder and read again; with `spreads` as `spread` has it.

    The new plan is a scan: its size estimate is the files' size, so that estimates do not grow from
    step to step, and a lost executor costs nothing that was computed before. The shuffle files behind
    it are freed once it is written, by a session setting that holds while it is.
    """
    spark, path, schema = df.sparkSession, shared_dir(df.sparkSession), df.schema
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    with ExitStack() as held:
        held.enter_context(setting(spark, _CLEANUP, "true"))
        if spreads:
            held.enter_context(spread(df))
        df.write.parquet(path)
    # results may read it as long as the application runs, and nothing after that
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(schema).parquet(path)


def measured(df: DataFrame, spreads: bool = False, **metrics) -> tuple[DataFrame, dict]:
    """`written`, and n (rows) and the other metrics, which are taken while it is written and cost no job of their own."""
    seen = Observation()
    kept = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in metrics.items())), spreads)
    return kept, seen.get


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by `written`."""
    spark = df.sparkSession
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        discard_at(spark, path)


def discard_at(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

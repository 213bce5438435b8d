"""Benchmark runs and the summary of their logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "algo_name string, thread int, cache_mb int, time long, res double"


def sweep(spark: SparkSession, algorithms: dict[str, Callable[[], DataFrame]], partitions: Iterable[int], repeats: int = 3) -> DataFrame:
    """A log row for each algorithm, number of shuffle partitions (as thread) and repeat: microseconds and the one value returned."""
    before, rows = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for name, run in algorithms.items():
            for n in partitions:
                spark.conf.set("spark.sql.shuffle.partitions", n)
                for _ in range(repeats):
                    spark.catalog.clearCache()
                    began = time.perf_counter()
                    value = float(run().first()[0])
                    rows.append((name, n, 0, int((time.perf_counter() - began) * 1e6), value))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    return spark.createDataFrame(rows, LOG)


def write_log(log: DataFrame, path: str) -> None:
    """The log as CSV part files in a folder, which bears the log's name."""
    log.write.csv(path, header=True)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log rows, and dataset, algo and testcase from names like dataset_algo_testcase.csv, of a file or of a folder of part files."""
    steps = F.split(F.input_file_name(), "/")
    name = F.when(F.element_at(steps, -1).startswith("part-"), F.element_at(steps, -2)).otherwise(F.element_at(steps, -1))
    log = spark.read.csv(path, schema=LOG, header=True).withColumn("_name", F.substring_index(name, ".", 1))
    parts = F.split("_name", "_")
    return log.select("*", *(F.get(parts, F.lit(i)).alias(k) for i, k in enumerate(("dataset", "algo", "testcase")))).drop("_name")


def summarize(log: DataFrame, by: str = "thread") -> DataFrame:
    """Mean seconds of each algorithm and value of `by` (thread or cache_mb)."""
    return log.groupBy("algo_name", by).agg(F.avg(F.col("time") * 1e-6).alias("avg_s"))

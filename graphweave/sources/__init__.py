"""Graph files: METIS-like and SNAP-like text, binary edge and adjacency lists, and the engine's own tables.

Text and tables are read and written by Spark, binary files by the tasks through Arrow's file systems:
paths may be local ones or URIs of a store that Arrow knows (file, hdfs, s3, gs, ...). A path may be a
file or a folder of part files; the lines, or bytes, of a folder follow each other in the order of the
files' names.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from graphweave.graph import Graph
from graphweave.operators.numbering import first_seen
from graphweave.plans.stages import setting, ship, written

FORMATS = ("adjlist", "edgelist", "binedge", "binadj")
#: Bytes of a binary file that a task reads, and of those that it holds at once.
SPLIT, PIECE = 64 << 20, 4 << 20
#: Bytes of a row group of saved edges; keys that become a filter.
ROW_GROUP, POINTS = 16 << 20, 1000
_EDGES = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0) and value of each line. Splits are numbered by file and offset; only their sizes go to the driver."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    kept = written(text.withColumn("row", F.monotonically_increasing_id()))
    parts = sorted(kept.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).collect())
    before = [0, *accumulate(p.n for p in parts)]
    offsets = spark.createDataFrame([(p.file, p.start, p.first, b) for p, b in zip(parts, before)], "file string, start long, first long, before long")
    # a row for each split of the input
    return kept.join(F.broadcast(offsets), ["file", "start"]).select((F.col("before") + F.col("row") - F.col("first")).alias("line"), "value")


def _tokens() -> Column:
    return F.filter(F.split("value", "\\s+"), lambda x: x != "")


def read_adjlist(spark: SparkSession, path: str) -> Graph:
    """Line 0 is `V E ...`; line i holds the neighbours of vertex i, counted from 1, and becomes vertex i - 1. A blank line is an isolated vertex."""
    lines = written(lines_of(spark, path).select("line", _tokens().alias("t")))
    head = lines.filter("line = 0").first()
    if head is None or len(head.t) < 2:
        raise ValueError("an adjacency list starts with the numbers of vertices and edges")
    n, rows = int(head.t[0]), lines.count() - 1
    if rows != n:
        raise ValueError(f"{n} vertices are declared, {rows} have a line")
    edges = lines.filter("line > 0").select((F.col("line") - 1).alias("src"), F.explode("t").alias("t")).select("src", (F.col("t").cast("long") - 1).alias("dst"))
    return Graph(spark.range(n), edges)


def read_edgelist(spark: SparkSession, path: str) -> Graph:
    """`src dst ...` a line, ids numbered by first appearance. `#` starts a comment; `# Nodes: N ...` and `p N M` declare N vertices at least."""
    lines = lines_of(spark, path).select("line", F.trim("value").alias("value")).filter("value != ''")
    head = F.regexp_extract("value", r"^(?:#\s*Nodes:|p)\s+(\d+)", 1)
    declared = lines.select(F.max(F.when(head != "", head.cast("long")))).first()[0] or 0
    pairs = lines.filter(~F.col("value").rlike(r"^(#|p\s)")).select("line", _tokens().alias("t"))
    pairs = pairs.select("line", F.get("t", F.lit(0)).cast("long").alias("src"), F.coalesce(F.get("t", F.lit(1)), F.raise_error(F.concat(F.lit("no second id in line "), F.col("line").cast("string")))).cast("long").alias("dst"))
    edges, ids = first_seen(pairs, "line")
    return Graph.from_edges(edges, declared=max(declared, ids.count()))


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it, of a local path or a URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (a URI or path) and length of each file; no content is read."""
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")


def _ints(file: str, start: int, end: int):
    """The int32 from one byte of a file to another, in pieces."""
    store, path = _opened(file)
    with store.open_input_file(path) as f:
        for at in range(start, end, PIECE):
            yield np.frombuffer(f.read_at(min(PIECE, end - at), at), "<i4")


def read_binedge(spark: SparkSession, path: str) -> Graph:
    """Pairs of little-endian int32, all of them; splits fall between pairs, and each is a task's."""

    def work(batches):
        for b in batches:
            for file, start, end in zip(*(b[c].to_pylist() for c in ("file", "start", "end")), strict=True):
                if (end - start) % 8:
                    raise ValueError(f"{file}: a pair is cut off")
                for data in _ints(file, start, end):
                    pairs = data.reshape(-1, 2).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=_EDGES)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(SPLIT).cast("long")))
    splits = _files(spark, path).filter("length > 0").select("file", "length", starts.alias("start"))
    splits = splits.select("file", "start", F.least(F.col("start") + SPLIT, "length").alias("end"))
    edges = splits.repartition("file", "start").mapInArrow(work, "src long, dst long")
    return Graph.from_edges(edges)


def indexed(file: str) -> list[tuple[int, int, int]] | None:
    """The cuts (start, end, vertices) of a part file by the index beside it, if there is one."""
    store, path = _opened(file)
    if store.get_file_info(_index_of(path)).type != fs.FileType.File:
        return None
    with store.open_input_file(_index_of(path)) as f:
        return [tuple(map(int, x)) for x in np.frombuffer(f.read(), "<i8").reshape(-1, 3)]


def lists_of(file: str, start: int, end: int, v: int):
    """The edges of the vertices v, v + 1, ... whose lists lie between two bytes of a file, in batches."""
    data = np.concatenate(list(_ints(file, start, end)))
    view, at, places = memoryview(data), 0, []
    while at < len(data):
        places.append(at)
        at += view[at] + 1
    places = np.array(places)
    src = np.repeat(np.arange(v, v + len(places)), data[places])
    dst = np.delete(data, places).astype(np.int64)
    for i in range(0, len(src), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(src[i : i + (1 << 17)]), pa.array(dst[i : i + (1 << 17)])], schema=_EDGES)


def read_binadj(spark: SparkSession, path: str) -> Graph:
    """int32 V and E, then degree and neighbours of each vertex.

    Records have no fixed length. Where the writer left an index of vertex offsets beside a file, it tells
    the splits; a file without one is read twice: first by one task, which steps from degree to degree and
    notes where a vertex begins about every `SPLIT` bytes; then each split by a task of its own. A file of
    a folder begins with a vertex.
    """
    named = [r.file for r in _files(spark, path).select("file").sort("file").collect()]  # a row for each file
    if not named:
        return Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    head = named[0]
    cuts_schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("n", pa.int64())])

    def cuts(batches):
        for b in batches:
            for file, length in zip(b["file"].to_pylist(), b["length"].to_pylist(), strict=True):
                if (known := indexed(file)) is not None:
                    if known:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((file, *cut) for cut in known), strict=True), cuts_schema.types, strict=True)], schema=cuts_schema)
                    continue
                begin = at = 2 if file == head else 0  # in int32
                n, base, out, total = 0, 0, [], length // 4
                for data in _ints(file, 0, total * 4):
                    view, end = memoryview(data), base + len(data)
                    while at < end:
                        if (at - begin) * 4 >= SPLIT:
                            out.append((file, begin * 4, at * 4, n))
                            begin, n = at, 0
                        at += view[at - base] + 1
                        n += 1
                    base = end
                if at > total or length % 4:
                    raise ValueError(f"{file}: vertices do not fill the file")
                if n:
                    out.append((file, begin * 4, at * 4, n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), cuts_schema.types, strict=True)], schema=cuts_schema)

    found = written(_files(spark, path).repartition("file").mapInArrow(cuts, "file string, start long, end long, n long"))
    splits = sorted((r.file, r.start, r.end, r.n) for r in found.collect())  # a row for each split of SPLIT bytes
    first = [0, *accumulate(n for *_, n in splits)]
    declared = int(next(iter(_ints(head, 0, 8)), [0])[0])
    if declared != first[-1]:
        raise ValueError(f"{path}: {declared} vertices are declared, {first[-1]} found")

    def edges(batches):
        for b in batches:
            for split in zip(*(b[c].to_pylist() for c in ("file", "start", "end", "v")), strict=True):
                yield from lists_of(*split)

    if not splits:
        return Graph(spark.range(0), spark.createDataFrame([], "src long, dst long"))
    placed = spark.createDataFrame([(f, s, e, v) for (f, s, e, _), v in zip(splits, first)], "file string, start long, end long, v long")
    return Graph(spark.range(declared), placed.repartition("v").mapInArrow(edges, "src long, dst long"))


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> Graph:
    """A graph in the format given, else in that of the path's extension."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2]
    readers = {"adjlist": read_adjlist, "edgelist": read_edgelist, "binedge": read_binedge, "binadj": read_binadj}
    if fmt not in readers:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    return readers[fmt](spark, path)


def write_adjlist(graph: Graph, path: str) -> None:
    """Ids must be 0..V-1. Part files hold ranges of vertices in the order of their names."""
    n, m = graph.stats().first()
    lists = graph.shifted(1).adjacency().select("id", F.array_join(F.col("nbrs").cast("array<string>"), " ").alias("value"))
    head = graph.edges.sparkSession.createDataFrame([(0, f"{n} {m}")], "id long, value string")
    lists.unionByName(head).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def write_edgelist(graph: Graph, path: str) -> None:
    """A comment line, then `src dst` lines in the order of both, in part files of ranges."""
    n, m = graph.stats().first()
    head = graph.edges.sparkSession.createDataFrame([(None, None, f"# Nodes: {n} Edges: {m}")], "src long, dst long, value string")
    lines = head.unionByName(graph.edges.select("src", "dst", F.concat_ws(" ", "src", "dst").alias("value")))
    lines.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").select("value").write.text(path)


class BinaryFiles(DataSource):
    """A sink of raw bytes: each task writes the values of its rows, one after another, to a file of its own.

    Options: path, a folder that all executors share, or a URI of a store; marks, whether rows tell where
    vertices begin in their value, so that an index of vertex offsets is left beside each file.
    """

    @classmethod
    def name(cls) -> str:
        return "graphbytes"

    def schema(self) -> str:
        return "value binary, begins binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _BytesWriter(self.options["path"], self.options.get("marks") == "true")


class _Part(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class Marks:
    """Cuts of a file into about `SPLIT` bytes, each where a vertex begins: (start, end, vertices)."""

    def __init__(self):
        self.cuts: list[tuple[int, int, int]] = []
        self.start, self.n = -1, 0

    def add(self, begins: np.ndarray) -> None:
        """Takes the bytes at which the next vertices begin, ascending."""
        while len(begins):
            if self.start < 0:
                self.start = int(begins[0])
            k = int(np.searchsorted(begins, self.start + SPLIT))
            self.n += k
            begins = begins[k:]
            if len(begins):
                self.cuts.append((self.start, int(begins[0]), self.n))
                self.start, self.n = -1, 0

    def done(self, end: int) -> list[tuple[int, int, int]]:
        return self.cuts + ([(self.start, end, self.n)] if self.n else [])


def _index_of(path: str) -> str:
    """The index of a part file, in a folder beside that of the files, which stay all there is in theirs."""
    folder, _, name = path.rpartition("/")
    return f"{folder}.offsets/{name}"


class _BytesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, marks: bool):
        self.uri, self.marks = path, marks

    def write(self, batches) -> _Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, path = _opened(self.uri)
        part = f"{path}/.part-{context.partitionId():05d}-{context.taskAttemptId()}"
        marks, at = Marks(), 0
        with store.open_output_stream(part) as f:
            for b in batches:
                for value, begins in zip(b["value"], b["begins"], strict=True):
                    data = value.as_buffer()
                    f.write(data)
                    if self.marks:
                        marks.add(at + np.frombuffer(begins.as_buffer(), "<i8"))
                    at += data.size
        if self.marks:
            with store.open_output_stream(_index_of(part)) as f:
                f.write(np.array(marks.done(at), "<i8").tobytes())
        return _Part(part)

    def commit(self, messages) -> None:
        """Only files of tasks that count get their name; others are never seen by readers."""
        store, _ = _opened(self.uri)
        for m in messages:
            if m is not None:
                folder, _, name = m.path.rpartition("/")
                final = f"{folder}/{name[1:].rpartition('-')[0]}"
                if self.marks:  # before the file: a file without its index is read without it
                    store.move(_index_of(m.path), _index_of(final))
                store.move(m.path, final)

    def abort(self, messages) -> None:
        store, _ = _opened(self.uri)
        for m in messages:
            if m is not None:
                store.delete_file(m.path)
                if self.marks:
                    store.delete_file(_index_of(m.path))


def _write_ints(rows: DataFrame, path: str, vertices: bool = False, kind: str = "<i4") -> None:
    """The rows' columns as int32 or another kind of integer, row by row, in the order in which they come.

    With `vertices` a column `begins` tells whether a vertex begins with the row, and an index is left of it.
    """
    names = [c for c in rows.columns if c != "begins"]
    schema = pa.schema([("value", pa.binary()), ("begins", pa.binary())])
    least, most, size = np.iinfo(kind).min, np.iinfo(kind).max, np.dtype(kind).itemsize

    def packed(batches):
        for b in batches:
            data = np.stack([b[c].to_numpy() for c in names], 1)
            if len(data) and (data.min() < least or data.max() > most):
                raise ValueError(f"an id does not fit into {8 * size} bits")
            begins = np.flatnonzero(b["begins"].to_numpy(zero_copy_only=False)) * size * len(names) if vertices else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([data.astype(kind).tobytes()], pa.binary()), pa.array([begins.astype("<i8").tobytes()], pa.binary())], schema=schema)

    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(BinaryFiles)
    store, folder = _opened(path)
    store.create_dir(folder)
    if vertices:
        store.create_dir(_index_of(f"{folder}/").rstrip("/"))
    # a row of packed values is as long as a batch of ids, and so many rows would be all that a task has
    with setting(rows.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE)):
        rows.mapInArrow(packed, "value binary, begins binary").write.format("graphbytes").option("marks", "true" if vertices else "false").mode("append").save(path)


def write_binedge(graph: Graph, path: str, both: bool = True) -> None:
    """Pairs of int32 in part files; by default each edge in both directions, a loop once."""
    _write_ints((graph.symmetrized() if both else graph).edges.select("src", "dst"), path)


def write_binadj(graph: Graph, path: str) -> None:
    """V, E and the vertices' lists, in part files of vertex ranges: put together in the order of their names they are one file. Ids must be 0..V-1.

    A list is written as its edges come, sorted behind the vertex's degree, and is never held whole. Beside
    each file an index is left of where vertices begin, about every `SPLIT` bytes, by which readers split it.
    """
    n, m = graph.stats().first()
    head = graph.edges.sparkSession.createDataFrame([(-1, 0, n), (-1, 1, m)], "id long, place long, value long")
    degrees = graph.degrees().select("id", F.lit(-1).cast("long").alias("place"), F.col("degree").alias("value"))
    edges = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("place"), F.col("dst").alias("value"))
    rows = head.unionByName(degrees).unionByName(edges)
    begins = ((F.col("place") == -1) & (F.col("id") >= 0)).alias("begins")
    _write_ints(rows.repartitionByRange("id").sortWithinPartitions("id", "place").select("value", begins), path, vertices=True)


def save(graph: Graph, path: str) -> None:
    """The engine's own tables: vertices, edges in ranges of sources, and their statistics.

    A filter on src reads the files, row groups and pages of its range alone; one on dst reads the row
    groups whose dictionary or Bloom filter may have the value, for which row groups are kept small.
    """
    graph.vertices.write.parquet(f"{path}/vertices")
    edges = graph.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write
    for key, value in {"block.size": ROW_GROUP, "bloom.filter.enabled#dst": "true", "bloom.filter.adaptive.enabled": "true", "bloom.filter.max.bytes": ROW_GROUP // 8}.items():
        edges = edges.option(f"parquet.{key}", value)
    edges.parquet(f"{path}/edges")
    graph.stats().write.parquet(f"{path}/stats")


def edges_at(spark: SparkSession, path: str, keys: DataFrame, end: str = "src") -> DataFrame:
    """The edges of a saved graph whose end (src or dst) is one of keys(id).

    Up to `POINTS` keys become a filter that Parquet compares with what it keeps of files, row groups and
    pages; more are joined, so nothing grows on the driver.
    """
    edges, wanted = load(spark, path).edges, keys.select(F.col("id").cast("long").alias(end)).filter(f"{end} IS NOT NULL").distinct()
    few = [k for (k,) in wanted.limit(POINTS + 1).collect()]
    if len(few) > POINTS:
        return edges.join(wanted, end, "left_semi")
    return edges.filter(_any_of(end, sorted(few)))


def _any_of(end: str, keys: list[int]) -> Column:
    """A balanced tree of equalities: beyond ten values Spark hands Parquet an IN by its bounds alone."""
    if not keys:
        return F.lit(False)
    if len(keys) == 1:
        return F.col(end) == keys[0]
    half = len(keys) // 2
    return _any_of(end, keys[:half]) | _any_of(end, keys[half:])


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics that `save` kept: no edge is read."""
    return spark.read.parquet(f"{path}/stats")

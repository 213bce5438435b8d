"""Approximate nearest neighbours by largest inner product, over balanced posting lists.

A coordinate is added to each vector that makes all of one length, so that the largest inner product is
the least distance. Centroids come from a bounded sample; their number follows the number of vectors up
to a bound. A vector is posted to its nearest centroid and, where it lies near a boundary, to others
that are about as near and not behind one already taken. Centroids are searched by best-first walks over
a neighbour graph in the tasks' memory. A query reads the lists whose centroids are at most `ratio`
times as far as the nearest; the ratio is the least that covers `COVERED` of the true neighbours inside
the sample, so that it is wide where the vectors have no clusters. Where these lists hold too few
candidates, it reads the next nearest ones as well.

Lists that lie near each other are put together to blocks of about as many postings; a list that very
many vectors share is cut into several. A query travels to each block once, with the lists that it
reads there, and not to each list. A block has a fixed share of all postings until that share fills a
task's memory, so that a query is copied a bounded number of times; beyond, what is sent follows the
inner products to compute, at some 80 MB for each 10^9 of them. Vectors travel in the width in which
they are stored; scores are computed in double precision.

Defined results: vectors that are null or zero, hold null or non-finite components, or have not the
commonest length take no part; fewer candidates than asked for give fewer rows; equal scores are ordered
by vec_id; rows with the same vec_id count as one candidate with the larger score, and none is its own
neighbour; rows without vec_id take no part; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.llm.common import rows, sampled, slices, table, written

#: Vectors and queries of the sample, vectors a centroid, most centroids, rounds of k-means.
SAMPLE, SAMPLE_QUERIES, PER_LIST, MOST_LISTS, ROUNDS = 20_000, 400, 256, 4096, 8
#: Lists a vector is posted to at most, how much farther those beyond the first may be, neighbours of a centroid in the graph.
REPLICAS, BOUNDARY, LINKS = 3, 1.05, 24
COVERED, EVERY, NEAREST = 0.95, 20, 20
#: Blocks that share all postings, least and most postings of one, most queries that meet a block in one task.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, CHUNK = 16, 1024, 1 << 16, 1 << 14
#: Numbers that a step of dense work holds at once, in the driver as in the tasks.
DENSE = 4_000_000


def usable(vectors: DataFrame, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """vec_id and x (as stored) of the rows that take part, but for their length."""
    x = F.col(col)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _parts(n: int, width: int):
    """Slices of n rows, so many that `width` numbers a row stay within DENSE."""
    step = max(1, DENSE // max(1, width))
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


class Index:
    """Centroids, their graph and the ratio that selects lists. No step holds a table of all vectors by all centroids."""

    def __init__(self, sample: np.ndarray, n: int, longest: float, nearest: int):
        rng = np.random.Generator(np.random.PCG64(3))
        self.longest = longest
        # equal vectors give one centroid
        x = self.lifted(np.unique(sample, axis=0))
        k = max(1, min(MOST_LISTS, -(-n // PER_LIST), len(x)))
        self.centroids = x[rng.choice(len(x), k, replace=False)]
        for _ in range(ROUNDS):
            of = self._nearest(x)
            order = np.argsort(of, kind="stable")
            counts = np.bincount(of, minlength=k)
            has = counts > 0
            sums = np.zeros_like(self.centroids)
            sums[has] = np.add.reduceat(x[order], (np.cumsum(counts) - counts)[has])
            self.centroids = sums / np.maximum(counts, 1)[:, None]
            # a centroid without vectors moves into the fullest list, which this splits
            full = np.argsort(-counts)
            for i, empty in enumerate(np.flatnonzero(~has)):
                members = np.flatnonzero(of == full[i % k])
                self.centroids[empty] = x[rng.choice(members)] if len(members) else x[rng.integers(len(x))]
        self.order = self._in_order(np.arange(k))
        self.graph = self._linked(rng)
        self.ratio = self._ratio(sample, rng, nearest)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Data vectors, brought to one length by one more coordinate."""
        rest = np.sqrt(np.maximum(self.longest - (x**2).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        """Query vectors, scaled to the same length."""
        scale = np.sqrt(self.longest) / np.linalg.norm(x, axis=1)
        return np.concatenate([x * scale[:, None], np.zeros((len(x), 1))], 1)

    def _distances(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0))

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._distances(x[part]).argmin(1) for part in _parts(len(x), len(self.centroids))])

    def _in_order(self, ids: np.ndarray) -> np.ndarray:
        """Centroids so that those near each other stand near each other: halves along the direction of most spread, again and again."""
        if len(ids) < 3:
            return ids
        c = self.centroids[ids] - self.centroids[ids].mean(0)
        axis = c[np.argmax((c**2).sum(1))]
        for _ in range(5):
            axis = c.T @ (c @ axis)
            axis = axis / max(np.linalg.norm(axis), 1e-300)
        ids, half = ids[np.argsort(c @ axis, kind="stable")], len(ids) // 2
        return np.concatenate([self._in_order(ids[:half]), self._in_order(ids[half:])])

    def _linked(self, rng: np.random.Generator) -> np.ndarray:
        k = len(self.centroids)
        near = np.empty((k, min(LINKS, k - 1)), np.int64)
        for part in _parts(k, k):
            apart = self._distances(self.centroids[part])
            apart[np.arange(len(apart)), np.arange(part.start, part.stop)] = np.inf
            near[part] = np.argsort(apart, 1)[:, : near.shape[1]]
        # a few long links keep the graph in one piece
        return np.concatenate([near, rng.integers(0, k, (k, min(4, k)))], 1)

    def search(self, x: np.ndarray, wanted: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their distances, row by row, nearest first; inf stands for none. For few rows at once.

        All rows walk at once: the nearest centroids that are not yet expanded bring in their
        neighbours, until no row has one left within the ratio among its nearest `wanted`.
        """
        k, n = len(self.centroids), len(x)
        wanted = min(wanted, k)
        seen, distance = np.zeros((n, k), bool), np.full((n, k), np.inf)
        expanded = np.zeros((n, k), bool)
        entry = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        seen[:, entry] = True
        distance[:, entry] = np.linalg.norm(x[:, None] - self.centroids[entry][None], axis=2)
        rows_ = np.arange(n)
        while len(rows_):
            open_ = np.where(expanded[rows_], np.inf, distance[rows_])
            best = open_.argmin(1)
            reach = np.partition(distance[rows_], wanted - 1, 1)[:, wanted - 1]
            limit = np.minimum(reach, distance[rows_].min(1) * (ratio * 1.1))
            going = open_[np.arange(len(rows_)), best] <= limit
            going &= np.isfinite(open_[np.arange(len(rows_)), best])
            rows_, best = rows_[going], best[going]
            expanded[rows_, best] = True
            near = self.graph[best]
            new = ~seen[rows_[:, None], near]
            r, j = np.nonzero(new)
            seen[rows_[r], near[r, j]] = True
            distance[rows_[r], near[r, j]] = np.linalg.norm(x[rows_[r]] - self.centroids[near[r, j]], axis=1)
        order = np.argsort(distance, 1)[:, :wanted]
        return order, np.take_along_axis(distance, order, 1)

    def _in_parts(self, x: np.ndarray, one) -> tuple[np.ndarray, np.ndarray]:
        """Rows and lists by a function of few rows."""
        found = [(part.start + row, lists) for part in _parts(len(x), 8 * len(self.centroids)) for row, lists in [one(x[part])]]
        return tuple(np.concatenate(y) for y in zip(*found, strict=True))

    def posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of data vectors and the lists they are posted to."""
        return self._in_parts(x, self._posted)

    def _posted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists, distance = self.search(self.lifted(x), 4 * REPLICAS, BOUNDARY)
        take = distance <= distance[:, :1] * BOUNDARY + 1e-12
        for j in range(1, lists.shape[1]):
            for i in range(j):  # not behind a list already taken
                between = np.linalg.norm(self.centroids[lists[:, j]] - self.centroids[lists[:, i]], axis=1)
                take[:, j] &= ~take[:, i] | (between >= distance[:, j] * 0.9)
        take &= np.cumsum(take, 1) <= REPLICAS
        row, j = np.nonzero(take)
        return row, lists[row, j]

    def probed(self, x: np.ndarray, owned: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of queries and the lists they read: those within the ratio, and the next nearest until the lists own `least` candidates."""
        return self._in_parts(x, lambda part: self._probed(part, owned, least))

    def _probed(self, x: np.ndarray, owned: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        x = self.asked(x)
        lists, distance = self.search(x, len(self.centroids), self.ratio)
        row, j = np.nonzero(distance <= distance[:, :1] * self.ratio + 1e-12)
        lists = lists[row, j]
        few = np.bincount(row, owned[lists], len(x)) < min(least, owned.sum())
        if few.any():
            apart = self._distances(x[few])
            order = np.argsort(apart, 1, kind="stable")
            before = np.cumsum(owned[order], 1) - owned[order]
            apart = np.take_along_axis(apart, order, 1)
            more, j = np.nonzero((before < least) | (apart <= apart[:, :1] * self.ratio + 1e-12))
            old = ~few[row]
            row, lists = np.concatenate([row[old], np.flatnonzero(few)[more]]), np.concatenate([lists[old], order[more, j]])
        return row, lists

    def _ratio(self, sample: np.ndarray, rng: np.random.Generator, nearest: int) -> float:
        if len(sample) < 2:
            return 1.0
        ask = rng.choice(len(sample), min(SAMPLE_QUERIES, len(sample)), replace=False)
        row, lists = self.posted(sample)  # rows ascend
        begin = np.searchsorted(row, np.arange(len(sample) + 1))
        need = []
        for part in _parts(len(ask), len(sample)):
            score = sample[ask[part]] @ sample.T
            score[np.arange(len(score)), ask[part]] = -np.inf
            true = np.argpartition(-score, min(nearest, len(sample) - 1) - 1, 1)[:, : min(nearest, len(sample) - 1)]
            distance = self._distances(self.asked(sample[ask[part]]))
            for d, t in zip(distance, true, strict=True):
                need += [d[lists[begin[i] : begin[i + 1]]].min() / max(d.min(), 1e-12) for i in t]
        return float(np.quantile(need, COVERED, method="higher"))


class Layout:
    """Which blocks the postings of each list lie in."""

    def __init__(self, order: np.ndarray, sizes: np.ndarray):
        """order: lists, near ones near each other; sizes: postings of each list."""
        most = int(np.clip(sizes.sum() // BLOCKS, LEAST_BLOCK, MOST_BLOCK))
        self.first, self.parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
        block, filled = 0, 0
        for k in order:
            if filled and filled + sizes[k] > most:
                block, filled = block + 1, 0
            self.first[k], self.parts[k] = block, max(1, -(-sizes[k] // most))
            if self.parts[k] > 1:  # a list larger than a block has blocks of its own
                block, filled = block + self.parts[k], 0
            else:
                filled += sizes[k]

    def reads(self, row: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A row for each query, block and list in it, in the order of query and block."""
        times = self.parts[lists]
        at = np.repeat(np.arange(len(row)), times)
        block = self.first[lists][at] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        order = np.lexsort((block, row[at]))
        return row[at][order], block[order], lists[at][order]


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best_of_block(q: pd.DataFrame, p: pd.DataFrame, width: str, nearest: int) -> pd.DataFrame:
    """Each query's nearest in the lists that it reads of a block."""
    read = lambda column: np.frombuffer(b"".join(column), width).astype(np.float64)
    p = p.sort_values("list", kind="stable")
    pi, at = p["vec_id"].to_numpy(), p["list"].to_numpy()
    px = read(p["x"]).reshape(len(p), -1)
    begin = np.flatnonzero(np.append(True, np.diff(at) != 0))
    span = dict(zip(at[begin].tolist(), zip(begin, np.append(begin[1:], len(at)))))
    by_id = np.argsort(pi, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(pi[by_id]) != 0))
    k = min(nearest, len(first))
    out = []
    for part in _parts(len(q), len(p)):
        own = q.iloc[part]
        qi, qx = own["vec_id"].to_numpy(), read(own["x"]).reshape(len(own), -1)
        lists = [np.frombuffer(x, "<i4") for x in own["lists"]]
        row, lists = np.repeat(np.arange(len(own)), list(map(len, lists))), np.concatenate(lists)
        order = np.argsort(lists, kind="stable")
        row, lists = row[order], lists[order]
        score = np.full((len(own), len(p)), -np.inf)
        for j in np.unique(lists):
            if int(j) in span:
                some, (a, b) = row[slice(*np.searchsorted(lists, [j, j + 1]))], span[int(j)]
                score[some, a:b] = qx[some] @ px[a:b].T
        score[qi[:, None] == pi[None, :]] = -np.inf
        # postings of one vec_id are one candidate, with the larger score
        distinct = score if len(first) == len(pi) else np.maximum.reduceat(score[:, by_id], first, 1)
        least = np.partition(distinct, len(first) - k, 1)[:, len(first) - k]
        # all that tie with the last within rounding, by the sum in one fixed order
        floor = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
        i, j = np.nonzero((score >= floor[:, None]) & np.isfinite(score))
        exact = (qx[i] * px[j]).sum(1)
        order = np.lexsort((pi[j], -exact, i))
        i, ids, exact = i[order], pi[j][order], exact[order]
        once = np.sort(np.unique(np.stack([i, ids], 1), axis=0, return_index=True)[1]) if len(i) else i
        i, ids, exact = i[once], ids[once], exact[once]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        out.append(pd.DataFrame({"query_id": qi[i[keep]], "vec_id": ids[keep], "score": exact[keep]}))
    return pd.concat(out)


def fitted(vectors: DataFrame, nearest: int = NEAREST) -> tuple[DataFrame, Index | None]:
    """vec_id and x of the vectors that take part, and the index fitted on a sample of them; none if there are none."""
    v = usable(vectors)
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    common = v.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("longest")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return v, None
    v = v.filter(F.size("x") == common.d)
    sample = sampled(v, "vec_id", SAMPLE, common.n).toArrow().combine_chunks()
    # one row of each vec_id: copies of a query's own row are not its neighbours, and would make the ratio narrow
    sample = sample.take(pa.array(np.sort(np.unique(sample["vec_id"].to_numpy(), return_index=True)[1])))["x"].combine_chunks()
    return v, Index(_matrix(sample, len(sample)).astype(np.float64), common.n, common.longest, nearest)


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the nearest found of each query; vectors has vec_id and embedding."""
    spark = vectors.sparkSession
    v, index = fitted(vectors, nearest)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = "<f4" if v.schema["x"].dataType.elementType.typeName() == "float" else "<f8"
    bytes_of = lambda x: [r.tobytes() for r in x.astype(width)]

    def posts(batches):
        schema = pa.schema([("list", pa.int32()), ("vec_id", pa.int64()), ("x", pa.binary())])
        for b in slices(batches, 500):
            if b.num_rows:
                x = _matrix(b["x"], b.num_rows)
                row, lists = index.posted(x.astype(np.float64))
                yield rows(schema, lists, b["vec_id"].take(pa.array(row)), pa.array(bytes_of(x), pa.binary()).take(pa.array(row)))

    data = written(v.mapInArrow(posts, "list int, vec_id long, x binary"))
    sizes, owned = np.zeros((2, len(index.centroids)), np.int64)
    for k, n in data.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each list: MOST_LISTS at most
        sizes[k] = n
    for k, n in data.groupBy("vec_id").agg(F.min("list").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        owned[k] = n  # each candidate counts in one list
    layout = Layout(index.order, sizes)

    def asks(batches):
        schema = pa.schema([("block", pa.int64()), ("vec_id", pa.int64()), ("x", pa.binary()), ("lists", pa.binary())])
        for b in slices(batches, 200):
            if b.num_rows:
                x = _matrix(b["x"], b.num_rows)
                row, block, lists = layout.reads(*index.probed(x.astype(np.float64), owned, nearest + 1))
                new = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(block) != 0)))
                of = pa.array(row[new])
                yield rows(schema, block[new], b["vec_id"].take(of), pa.array(bytes_of(x), pa.binary()).take(of), [y.astype("<i4").tobytes() for y in np.split(lists, new[1:])])

    queries = written(v.filter(is_query).mapInArrow(asks, "block long, vec_id long, x binary, lists binary"))
    # a row for each list
    places = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(layout.first, layout.parts))], "list int, first long, parts long")
    placed = data.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).alias("block"), "list", "vec_id", "x")
    chunks = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))  # a row for each block
    queries = queries.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).drop("chunks")
    placed = placed.join(chunks, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def search(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        return _best_of_block(q, p, width, nearest) if len(q) and len(p) else pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(_BEST.names, ("int64", "int64", "float64"))})

    found = queries.groupBy("block", "chunk").cogroup(placed.groupBy("block", "chunk")).applyInPandas(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every query row of the embeddings."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)

"""Near-duplicate documents: SetSketch registers, banding, likelihood, exact verification.

A document's set is its distinct 5-word shingles. A SetSketch register is the least of exponentially
distributed hashes of the set's elements, truncated to a grid of exponentially spaced values; equal
registers are likelier the more two sets overlap. Documents that agree in all registers of a band meet
in a bucket. Of a pair, the joint likelihood of the two sketches, given both set sizes, estimates the
similarity; pairs that may be similar enough are verified on their full sets.

Documents with equal sets are one class from the start. In a bucket every class is compared with one
leader, not with every other. Members of buckets that do not hang together then are compared where they
share a shingle among their rarest, so many that any link between them shows. So a group of near copies
takes about as many comparisons as it has members, and yet no link between different components is missed.

Defined results: null and empty texts have empty sets and are linked with nothing; texts of any length
are taken whole; equal rows are in one class; rows with the same doc_id count as one document that has
the links of all its texts; rows without doc_id count as one document where their texts are equal, which
has no part in naming a component: a component is named by its least doc_id, null if it has none, and of
one without any doc_id one text stays; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweave.llm.common import blocks, lowered, mix, rows, settings, slices, table, texts, words_of, written
from graphweave.plans.components import connected_components
from graphweave.plans.stages import discard

SHINGLE, PERCENT = 5, 75
#: Registers and those of a band: a pair at the threshold misses every band with probability 5e-6.
REGISTERS, BAND = 128, 4
#: The grid's base, the hashes' rate, the last register value.
BASE, RATE, LIMIT = 1.02, 20.0, (1 << 16) - 2
#: Bits of the filter that keeps texts without company from travelling.
SIEVE = 1 << 25
#: A pair whose likelihood peaks this many standard errors below the threshold is not verified.
ERRORS = 6
_SPREAD = np.random.Generator(np.random.PCG64(0x5E75)).integers(1, 1 << 63, (2, max(REGISTERS, SHINGLE)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def key_of(doc_id: Column, text: Column) -> Column:
    """The doc_id, or where that is null a hash of the text: it meets a doc_id as seldom as two shingles meet."""
    return F.coalesce(doc_id, F.xxhash64(F.coalesce(text, F.lit(""))))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each distinct shingle of each document in a block, sorted by document and hash, and its document."""
    starts, _, words = words_of(data)
    doc = np.searchsorted(offsets, starts, "right") - 1
    n = len(words)
    if not n:
        return words, doc
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    left = np.append(first[1:], n).repeat(np.diff(np.append(first, n))) - np.arange(n)  # words from here to the document's end
    size = np.minimum(left, SHINGLE)
    sums = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        part = words[k:] * _SPREAD[1, k]
        sums[: n - k] += np.where(size[: n - k] > k, part, np.uint64(0))
    begins = np.zeros(n, bool)
    begins[first] = True
    use = (left >= SHINGLE) | begins  # a shorter document is one shingle
    doc, sums = doc[use], mix(sums[use] + size[use].astype(np.uint64))
    order = np.lexsort((sums, doc))
    doc, sums = doc[order], sums[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (sums[1:] != sums[:-1])
    return sums[new], doc[new]


def registers(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of registers for each set; `first` is where the sets begin."""
    out = np.empty((len(first), REGISTERS), np.uint16)
    for k in range(REGISTERS):
        least = np.minimum.reduceat(hashes * _SPREAD[0, k] + _SPREAD[1, -1 - k], first)
        x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64.0001) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, LIMIT + 1)
    return out


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, absent, n (set size), identity (of the set) and sketch of each row of doc_id, absent and text; the last two are null for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("absent", pa.bool_()), ("n", pa.int64()), ("identity", pa.binary()), ("sketch", pa.binary())])

    def work(batches):
        for b in slices(batches, 500):
            for keys, data, offsets in blocks(list(zip(b["doc_id"].to_pylist(), b["absent"].to_pylist(), strict=True)), [lowered(x) for x in b["text"].to_pylist()]):
                ids, absent = zip(*keys, strict=True)
                hashes, doc = shingles(data, offsets)
                sizes, identity, sketch = np.bincount(doc, minlength=len(ids)), [None] * len(ids), [None] * len(ids)
                if len(doc):
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    both = np.stack([np.add.reduceat(mix(hashes + np.uint64(k)), first) for k in (1, 2)], 1)
                    regs = registers(hashes, first)
                    for i, d in enumerate(doc[first]):
                        identity[d], sketch[d] = both[i].tobytes(), regs[i].tobytes()
                yield rows(schema, ids, absent, sizes, identity, sketch)

    return docs.select("doc_id", "absent", "text").mapInArrow(work, "doc_id long, absent boolean, n long, identity binary, sketch binary")


def sets_of(docs: DataFrame) -> DataFrame:
    """id and items (the set's sorted hashes) of each row of doc_id and text."""
    schema = pa.schema([("id", pa.int64()), ("items", pa.binary())])

    def work(batches):
        for b in slices(batches, 500):
            for ids, data, offsets in blocks(b["doc_id"].to_pylist(), [lowered(x) for x in b["text"].to_pylist()]):
                hashes, doc = shingles(data, offsets)
                cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
                yield rows(schema, ids, [hashes[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)])

    return docs.select("doc_id", "text").mapInArrow(work, "id long, items binary")


def likely(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity at which the joint likelihood of two sketches peaks, for each row."""
    share = (na / (na + nb))[:, None]
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(na / nb, nb / na)[:, None]

    def log_ratio(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    over, under = log_ratio(share - (1 - share) * grid), log_ratio(1 - share - share * grid)
    # registers grow with the set, so the larger set has the larger registers
    tiny = 1e-12
    value = more * np.log(over + tiny) + less * np.log(under + tiny) + (REGISTERS - more - less) * np.log(np.maximum(1 - over - under, tiny))
    return np.take_along_axis(grid, value.argmax(1)[:, None], 1)[:, 0]


def promising(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs a, b whose sizes and sketches allow a link."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    least = PERCENT / 100 - ERRORS * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5

    def work(batches):
        for x in slices(batches, 4000):
            if x.num_rows:
                na, nb = (x[c].to_numpy().astype(np.float64) for c in ("na", "nb"))
                sa, sb = (np.frombuffer(b"".join(x[c].to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sa", "sb"))
                keep = pa.array(likely(na, nb, sa, sb) >= least)
                yield rows(schema, x["a"].filter(keep), x["b"].filter(keep))

    return written(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(work, "a long, b long").distinct())


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links, by their full sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches):
        for x in batches:
            keep = []
            for p, q in zip(x["xa"], x["xb"], strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))
                shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * shared >= PERCENT * (len(p) + len(q) - shared))
            keep = pa.array(keep, pa.bool_())
            yield rows(schema, x["a"].filter(keep), x["b"].filter(keep))

    with settings(pairs.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="256"):
        return written(both.select("a", "b", "xa", "xb").mapInArrow(work, "a long, b long").distinct())


class _Links:
    """Links found so far and the components they make."""

    def __init__(self, classes: DataFrame, sets: DataFrame, links: DataFrame | None):
        """classes: id, n and sketch; sets: id and items, of the same ids; links: those that hold from the start."""
        self.classes, self.sets, self.links, self.labels = classes, sets, links, None
        if links is not None:
            self._label()

    def _label(self) -> None:
        if self.labels is not None:
            discard(self.labels)
        self.labels = written(connected_components(self.links, "a", "b"))

    def labelled(self, nodes: DataFrame) -> DataFrame:
        """The rows with label, the component of their id."""
        if self.labels is None:
            return nodes.withColumn("label", F.col("id"))
        return nodes.join(self.labels, "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")

    def settle(self, pairs: DataFrame) -> None:
        """Adds all links among the pairs that join components: first one pair of each b, then those that two of these do not bridge."""
        if pairs.isEmpty():
            return
        first = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        found = verified(first, self.sets)
        rest = pairs.join(first, ["a", "b"], "left_anti")
        for x in ("a", "b"):
            hung = found.select(F.col("b").alias(x), F.col("a").alias(f"h{x}"))
            rest = rest.join(hung, x, "left").withColumn(f"h{x}", F.coalesce(f"h{x}", x))
        more = verified(rest.filter("ha != hb").select("a", "b"), self.sets)
        discard(first)
        found = found.unionByName(more)
        self.links = found if self.links is None else self.links.unionByName(found)
        self._label()


def _bands(classes: DataFrame) -> DataFrame:
    """band and id: the buckets of each class."""
    width = 2 * BAND
    band = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substr("sketch", i * width + 1, F.lit(width))))
    return classes.select("id", F.explode(band).alias("band"))


def _met(classes: DataFrame) -> DataFrame:
    """band, id and n (classes in the bucket) of the buckets that hold several. All that follows works on this table, which has no lone classes."""
    buckets = _bands(classes)
    sizes = written(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = written(buckets.join(sizes, "band"))
    discard(sizes)
    return met


def _leaders(met: DataFrame) -> DataFrame:
    """Pairs of each bucket's leader and each other class of the bucket.

    The leader is the class with most company over all its buckets: of a text and its altered copies,
    the text, which is nearer to the copies than they are to each other.
    """
    company = met.groupBy("id").agg(F.sum("n").alias("company"))
    ranked = met.select("band", "id").join(written(company), "id")
    first = written(ranked.groupBy("band").agg(F.min(F.struct(-F.col("company"), F.col("id"))).alias("first")).select("band", F.col("first.id").alias("leader")))
    pairs = met.select("band", "id").join(first, "band").filter("id != leader")
    return pairs.select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()


def _sieve(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, of fixed size: with very many ids it lets all pass, which costs time alone."""
    at = F.explode(F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(SIEVE)) for k in range(2)))).alias("at")
    bits = ids.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS INT)))").alias("bits"))
    got, out = bits.toArrow(), np.zeros(SIEVE // 64, np.int64)  # SIEVE / 64 rows at most
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def _sets_of_some(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and items of the documents whose doc_id is among the ids: the texts of few others travel."""
    sieve = _sieve(ids)

    def work(batches):
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for k in range(2):
                at = b[f"at{k}"].to_numpy()
                keep &= sieve[at >> 6] >> (at & 63) & 1 == 1
            if keep.any():
                yield b.select(["doc_id", "text"]).filter(pa.array(keep))

    marks = [F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(SIEVE)).alias(f"at{k}") for k in range(2)]
    some = docs.select("doc_id", "text", *marks).mapInArrow(work, "doc_id long, text string")
    return written(sets_of(some.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")))


def _still_apart(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of members (id, label) with different labels whose sets may be similar enough: none that are is missed.

    With a set's shingles in one fixed order, rare ones first, two sets that share at least `need`
    shingles share one among the first |set| - need + 1 of each. Shingles of one set alone come first and
    meet nothing, so they are counted but not sent: an altered copy that is too far from the others has
    so many of its own that nothing of it is left.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("item", pa.int64())])

    def work(batches):
        for b in batches:
            for i, x in zip(b["id"].to_pylist(), b["items"], strict=True):
                items = np.frombuffer(x.as_buffer(), np.int64)
                yield rows(schema, np.full(len(items), i), np.full(len(items), len(items)), items)

    items = sets.join(members.select("id"), "id", "left_semi").mapInArrow(work, "id long, n long, item long")
    counts = written(items.groupBy("item").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    shared = items.join(counts, "item")
    own = W.partitionBy("id")  # no longer than a text
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("m", "item")) - 1
    heads = shared.withColumn("place", place).filter(f"place <= n - ({PERCENT} * n + 99) div 100")
    heads = written(heads.select("id", "n", "item", "place").join(members, "id"))
    discard(counts)
    by_label = heads.groupBy("item", "label").agg(F.count(F.lit(1)).alias("m"))
    most = written(by_label.groupBy("item").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("m")).filter("m > most.m").select("item", F.col("most.label").alias("top")))
    met = written(heads.join(most, "item"))
    # of two labels one is not the commonest with that shingle
    left = met.filter("label != top").select("item", *(F.col(c).alias(f"{c}_x") for c in ("id", "n", "place", "label")))
    right = met.select("item", *(F.col(c).alias(f"{c}_y") for c in ("id", "n", "place", "label")))
    need = f"(({PERCENT} * (n_x + n_y) + {99 + PERCENT}) div {100 + PERCENT})"
    pairs = left.join(right, "item").filter(f"label_x != label_y AND 100 * least(n_x, n_y) >= {PERCENT} * greatest(n_x, n_y) AND place_x <= n_x - {need} AND place_y <= n_y - {need}")
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def _same_document(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes that hold texts of one doc_id: such a document has the links of all its texts."""
    several = sketches.filter("n > 0").groupBy("doc_id").agg(F.min("identity").alias("low"), F.max("identity").alias("high")).filter("low != high").select("doc_id")
    held = sketches.join(written(several), "doc_id", "left_semi").select("doc_id", "identity").join(classes.select("identity", "id"), "identity").select("doc_id", "id").distinct()
    least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
    return written(held.join(least, "doc_id").select("a", F.col("id").alias("b")).filter("a != b").distinct())


def _judged(docs: DataFrame) -> DataFrame:
    """key (of `key_of`) and the columns of `near_duplicates` of each document; inside, keys are the ids."""
    named = texts(docs)
    docs = named.select(key_of(F.col("doc_id"), F.col("text")).alias("doc_id"), "text", F.col("doc_id").isNull().alias("absent"))
    sketches = written(sketched(docs))
    # ids come before keys made of texts
    least = F.min(F.struct("absent", "doc_id", "n", "sketch"))
    classes = written(sketches.filter("n > 0").groupBy("identity").agg(least.alias("x")).select("identity", F.col("x.doc_id").alias("id"), "x.absent", "x.n", "x.sketch"))
    met, same = _met(classes), _same_document(sketches, classes)
    ids = written(met.select("id").distinct())
    nodes = written(classes.join(ids, "id", "left_semi").select("id", "n", "sketch"))
    found = _Links(nodes, _sets_of_some(docs, ids), None if same.isEmpty() else same)
    pairs = promising(_leaders(met), nodes)
    found.settle(pairs)
    marked = found.labelled(met.select("band", "id"))
    mixed = marked.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("n > 2 AND low != high").select("band")
    members = written(marked.join(written(mixed), "band", "left_semi").select("id", "label").distinct())
    discard(met)
    if not members.isEmpty():
        found.settle(promising(_still_apart(members, found.sets), nodes))
    labels = written(found.labelled(classes.select("identity", "id", "absent")).select("identity", "id", "absent", "label"))
    for x in (found.sets, nodes, classes):
        discard(x)
    # a label is the least key of a component; its name the least doc_id
    name = F.min(F.struct("absent", "id")).alias("name")
    strange = written(labels.filter("absent").select("label").distinct())
    named = labels.join(strange, "label", "left_semi").groupBy("label").agg(name).select("label", "name.*")
    labels = labels.select("identity", "label").join(written(named), "label", "left")
    labels = labels.select("identity", F.coalesce("id", "label").alias("name"), F.coalesce("absent", F.lit(False)).alias("nameless"))
    done = sketches.select("doc_id", "absent", "n", "identity").join(written(labels), "identity", "left")
    name, nameless = F.coalesce("name", "doc_id"), F.coalesce("nameless", "absent")
    own = lambda c, absent: F.when(~absent, c)
    return done.select(F.col("doc_id").alias("key"), own(F.col("doc_id"), F.col("absent")).alias("doc_id"), F.col("n").alias("n_shingles"), own(name, nameless).alias("component_id"), (F.col("doc_id") == name).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept of each document."""
    return _judged(docs).drop("key")


def op2_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Component and verdict of each document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents, columns as they were, of which one of each group stays: that with the least doc_id."""
    gone = _judged(docs).filter("NOT kept").select(F.col("key").alias("_gone")).distinct()
    d = docs.select(F.struct("*").alias("_row"))
    return d.join(gone, key_of(F.col("_row.doc_id").cast("long"), F.col("_row.text")) == F.col("_gone"), "left_anti").select("_row.*")

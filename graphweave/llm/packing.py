"""Packing of tokenized documents into sequences by a grouping genetic algorithm.

A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent into the other,
drops the bins that hold the same pieces, and puts the displaced pieces back: first in exchange for
smaller ones where a bin becomes fuller, then by best fit, largest first. The pieces are dealt to shards
of bounded size by hash; each shard is evolved on several islands, whose elites migrate around a ring
between epochs. Bins that stay below `WELL_FILLED` are dissolved after a level, and their pieces meet in
at most half as many shards on the next, until one is left: the loss of dealing them out is a few bins
in all rather than a bin a shard. All bins that best fit leaves unfilled evolve, on every level: for
`PATIENCE` children without gain, or until no packing can have fewer bins.

Only lengths travel through the evolution. Texts are tokenized once, where they lie, to the ids that
`tokenizers` gives by its JSON file: texts are cut at the file's added tokens, which have their own ids;
what lies between is encoded by the file's ranks, with tiktoken where its backtracking and its merges
of long pre-tokens allow, else with the splitter and rank queue of `bpe`, which know no limit.

Defined results: a null or empty text is the end token alone; a document longer than a sequence is
cut into whole sequences behind a first piece that holds the rest; repeated rows are packed each by
itself; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import random
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweave.llm.bpe import Codec
from graphweave.llm.common import rows, slices, table, texts, written

CAPACITY, END_ID = 1024, 2
#: Pieces a shard, islands a shard, epochs (migrations and one more), packings of an island, children without gain that end an epoch.
SHARD, ISLANDS, EPOCHS, POPULATION, PATIENCE = 16_384, 2, 2, 4, 24
#: Pieces of a shard that evolve at least.
FREE = 1024
#: Tokens from which a bin is left as it is when a level ends, elites that migrate, bins that a crossover opens, pieces of a bin up to which pairs are exchanged.
WELL_FILLED, ELITES, OPENED, PAIRED = CAPACITY - 8, 2, 2, 8


#: Characters between two spaces from which a text is left to the rank queue: beyond, tiktoken's merges cost the square of a pre-token.
LONG = 1000


def read_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and added tokens of a `tokenizers` file of byte-level BPE whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(map(byte.__getitem__, word)): i for word, i in file["model"]["vocab"].items()}
    merges = [x.split(" ") if isinstance(x, str) else x for x in file["model"]["merges"]]
    order = [file["model"]["vocab"][x + y] for x, y in merges]
    added = {x["content"]: x["id"] for x in file["added_tokens"]}
    if order != sorted(set(order)) or any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in file["added_tokens"]):
        raise ValueError(f"{path}: ids out of the merges' order, or added tokens that take their surroundings")
    return ranks, added


class Encoding:
    """Encodes texts as `tokenizers` does by that file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        ranks, self.added = read_json(path)
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.codec = Codec(ranks, pattern)
        # of added tokens that start at one place the longest is taken
        self.cut = regex.compile(f"({'|'.join(map(regex.escape, sorted(self.added, key=len, reverse=True)))})").split if self.added else lambda text: [text]

    def _plain(self, text: str) -> np.ndarray:
        if len(text) < LONG or max(map(len, text.split()), default=0) < LONG:
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # more backtracking than its regex engine allows
                pass
        return np.array(self.codec.encode(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """The ids, and the end token's behind them."""
        out = [np.array([self.added[x]], np.uint32) if k % 2 else self._plain(x) for k, x in enumerate(self.cut(text))]
        return np.concatenate([*out, [END_ID]]).astype("<u4")


_ENCODINGS: dict[tuple[str, str], Encoding] = {}


def encoding(path: str, pattern: str) -> Encoding:
    """A worker's encoding by that file, made once."""
    if (path, pattern) not in _ENCODINGS:
        _ENCODINGS.clear()
        _ENCODINGS[path, pattern] = Encoding(path, pattern)
    return _ENCODINGS[path, pattern]


def cut(n: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document of n ids."""
    rest = n % CAPACITY
    return ([(0, rest)] if rest else []) + [(at, CAPACITY) for at in range(rest, n, CAPACITY)]


def pieces(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches):
        encode = encoding(path, pattern).encode
        for b in slices(batches, 200):
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = encode(text)
                out += [(doc, k, at, n, zlib.crc32(data[at : at + n])) for k, (at, n) in enumerate(cut(len(data)))]
            yield rows(schema, *zip(*out, strict=True))

    return texts(docs).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


# One island. A solution is a list of bins, a bin a list of places in `sizes`.


def best_fit(bins: list[list[int]], order: Iterable[int], sizes: list[int]) -> list[list[int]]:
    """Puts pieces into the bins with the least room that holds them, new bins where there is none."""
    room: dict[int, list[int]] = {}
    holds = 0  # bit r: some bin has room for r more
    for k, b in enumerate(bins):
        if left := CAPACITY - sum(sizes[i] for i in b):
            room.setdefault(left, []).append(k)
            holds |= 1 << left
    for i in order:
        size = sizes[i]
        fits = holds >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            of = room[left]
            k = of.pop()
            if not of:
                holds ^= 1 << left
            bins[k].append(i)
        else:
            left, k = CAPACITY, len(bins)
            bins.append([i])
        if left := left - size:
            if not holds >> left & 1:
                holds |= 1 << left
            room.setdefault(left, []).append(k)
    return bins


def fitness(bins: list[list[int]], sizes: list[int]) -> tuple[int, int]:
    """Fewer bins first, then fuller ones beside emptier ones."""
    return -len(bins), sum(sum(sizes[i] for i in b) ** 2 for b in bins)


def exchanged(bins: list[list[int]], displaced: list[int], sizes: list[int]) -> list[int]:
    """Exchanges one or two pieces of a bin with one or two displaced ones where the bin becomes fuller; returns what is displaced then, in smaller pieces.

    Pieces of one size are alike, so the work follows the number of sizes, of which there are fewer than
    tokens in a bin, and a bin filled as one that could not be made fuller is passed over.
    """
    held: dict[int, list[int]] = {}
    for i in displaced:
        held.setdefault(sizes[i], []).append(i)
    order, barren = sorted(held), set()
    for b in bins:
        own = sorted(sizes[i] for i in b)
        room = CAPACITY - sum(own)
        if not room or not order or tuple(own) in barren:
            continue
        pairs = [(x, y) for k, y in enumerate(own) for x in own[:k]] if len(own) <= PAIRED else []
        gain, best = 0, None
        for take in {sum(x): x for x in [*((x,) for x in own), *pairs]}.values():
            least = sum(take)
            fits = bisect.bisect_right(order, least + room)
            if fits and order[fits - 1] - least > gain:
                gain, best = order[fits - 1] - least, (take, (order[fits - 1],))
            low, high = 0, fits - 1
            while low <= high and gain < room:
                more = order[low] + order[high] - least
                if more > room or low == high and len(held[order[low]]) < 2:
                    high -= 1
                    continue
                if more > gain:
                    gain, best = more, (take, (order[low], order[high]))
                low += 1
            if gain == room:
                break
        if not best:
            barren.add(tuple(own))
            continue
        barren.clear()
        for size in best[0]:
            i = b.pop(next(k for k, i in enumerate(b) if sizes[i] == size))
            if size not in held:
                bisect.insort(order, size)
            held.setdefault(size, []).append(i)
        for size in best[1]:
            b.append(held[size].pop(0))
            if not held[size]:
                del held[size]
                order.remove(size)
    return [i for of in held.values() for i in of]


def crossed(mother: list[list[int]], father: list[list[int]], sizes: list[int], rng: random.Random) -> list[list[int]]:
    """The mother with some of the father's well-filled bins."""
    filled = lambda b: sum(sizes[i] for i in b)
    full = sorted(father, key=filled, reverse=True)[: max(1, len(father) // 2)]
    injected = rng.sample(full, rng.randint(1, max(1, len(full) // 2)))
    taken = {i for b in injected for i in b}
    child, displaced = [list(b) for b in injected], []
    for b in mother:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    # the emptiest bins are opened as well, so that their pieces can find room elsewhere
    for k in sorted(sorted(range(len(injected), len(child)), key=lambda k: filled(child[k]))[:OPENED], reverse=True):
        displaced += child.pop(k)
    displaced = exchanged(child, displaced, sizes)
    return best_fit(child, sorted(displaced, key=lambda i: -sizes[i]), sizes)


def least_bins(sizes: list[int]) -> int:
    """No packing has fewer bins: as many as the tokens fill, or one for each piece of over half a bin."""
    return max(-(-sum(sizes) // CAPACITY), sum(x > CAPACITY // 2 for x in sizes))


def evolved(sizes: list[int], migrants: list[list[list[int]]], seed: int, trace: dict | None = None) -> list[list[list[int]]]:
    """The population of an island after an epoch, best first; it starts from migrants and a few packings of its own.

    The pieces of all bins that best fit leaves unfilled evolve and, while these are fewer than `FREE`,
    those of full bins, the ones of most pieces first; other full bins stay as they are: the same ones on
    every island, in every epoch. `trace` counts crossovers and the bins that they saved.
    """
    decreasing = best_fit([], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes)
    full = sorted((b for b in decreasing if sum(sizes[i] for i in b) == CAPACITY), key=len)
    free = len(sizes) - sum(map(len, full))
    while full and free < FREE:
        free += len(full.pop())
    settled = {i for b in full for i in b}
    rest = lambda bins: [b for b in bins if b[0] not in settled]
    rng, least = random.Random(seed), least_bins([x for i, x in enumerate(sizes) if i not in settled])
    population = [*map(rest, migrants), rest(decreasing)]
    start = min(map(len, population))
    if start > least:
        loose = sorted(i for b in population[0] for i in b)
        while len(population) < POPULATION:
            population.append(best_fit([], sorted(loose, key=lambda i: -sizes[i] * rng.uniform(0.7, 1)), sizes))
    population = sorted(((fitness(b, sizes), b) for b in population), key=lambda x: x[0], reverse=True)
    idle = crossovers = 0
    while len(population) > 1 and len(population[0][1]) > least and idle < PATIENCE:
        mother, father = (b for _, b in rng.sample(population, 2))
        child = crossed(mother, father, sizes, rng)
        score = fitness(child, sizes)
        crossovers += 1
        idle = 0 if score > population[0][0] else idle + 1
        # one that is worse than all, or as good as one of them, brings nothing new
        if score > population[-1][0] and all(score != x for x, _ in population):
            population[-1] = score, child
            population.sort(key=lambda x: x[0], reverse=True)
    if trace is not None:
        trace.update(crossovers=trace.get("crossovers", 0) + crossovers, saved=trace.get("saved", 0) + start - len(population[0][1]))
    return [full + b for _, b in population]


def _flat(bins: list[list[int]]) -> list[int]:
    """Bin of each place."""
    out = [0] * sum(map(len, bins))
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _nested(of: Iterable[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(of):
        bins.setdefault(int(k), []).append(i)
    return list(bins.values())


_STATE = "shard long, island int, bins array<int>, n_bins long, filled double"


def _epoch(items: DataFrame, state: DataFrame | None, epoch: int) -> DataFrame:
    """One epoch of every island: items come with shard, item and length; state holds the migrants."""
    spread = items.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "item", "length")

    def run(key, own: pd.DataFrame, came: pd.DataFrame | None = None) -> pd.DataFrame:
        own = own.sort_values("item")
        sizes = [int(x) for x in own["length"]]
        migrants = [] if came is None else [_nested(x) for x in came.sort_values("n_bins")["bins"]]
        shard, island = int(key[0]), int(key[1])
        best = evolved(sizes, migrants, hash((shard, island, epoch)))[:ELITES]
        return pd.DataFrame([(shard, island, _flat(b), len(b), float(fitness(b, sizes)[1])) for b in best], columns=["shard", "island", "bins", "n_bins", "filled"])

    by = spread.groupBy("shard", "island")
    if state is None:
        return by.applyInPandas(lambda key, own: run(key, own), _STATE)
    return by.cogroup(state.groupBy("shard", "island")).applyInPandas(lambda key, own, came: run(key, own, came), _STATE)


def packed(items: DataFrame, n: int) -> DataFrame:
    """item, level, shard, bin and place in the bin, for items of item (unique long) and length below the capacity; n is their number."""
    out, level = None, 0
    while True:
        shards = max(1, -(-n // SHARD))
        dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        state = None
        for epoch in range(EPOCHS):
            state = _epoch(dealt, state, epoch)
            if epoch < EPOCHS - 1:  # elites go to the next island, copies stay
                moved = state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
                state = written(state.unionByName(moved))
        best = state.groupBy("shard").agg(F.max_by("bins", F.struct(-F.col("n_bins"), F.col("filled"), -F.col("island"))).alias("bins"))

        def unpack(key, own: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("item").reset_index(drop=True)
            own["bin"] = np.asarray(won["bins"].iloc[0], np.int64)
            own = own.sort_values(["bin", "item"], kind="stable")
            own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
            own["filled"] = own.groupby("bin")["length"].transform("sum")
            return own[["item", "length", "shard", "bin", "offset", "filled"]]

        placed = dealt.select("item", "length", "shard").groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(unpack, "item long, length long, shard long, bin long, offset long, filled long")
        placed = written(placed.withColumn("level", F.lit(level)))
        left = placed.filter(F.col("filled") < WELL_FILLED).select("item", "length")
        n = left.count()
        # pieces that fit nowhere better, such as very many just over half a sequence, end the levels
        last = shards == 1 or max(1, -(-n // SHARD)) > shards // 2
        keep = placed if last else placed.filter(F.col("filled") >= WELL_FILLED)
        out = keep if out is None else out.unionByName(keep)
        if last or not n:
            return out
        items, level = left, level + 1


def pack(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    all_pieces = written(pieces(docs, path, pattern).withColumn("item", F.monotonically_increasing_id()))
    short = all_pieces.filter(F.col("length") < CAPACITY).select("item", "length")
    n = short.count()
    whole = all_pieces.filter(F.col("length") >= CAPACITY).withColumns({"sequence": F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("shard"), F.col("item").alias("bin")), "offset": F.lit(0).cast("long")})
    placed = packed(short, n).select("item", F.struct("level", "shard", "bin").alias("sequence"), "offset")
    done = whole.unionByName(all_pieces.filter(F.col("length") < CAPACITY).join(placed, "item"))
    # levels, shards and bins are far below 2**8, 2**31 and 2**24; whole pieces, numbered by item, take the negative numbers
    number = F.when(F.col("sequence.level") < 0, -1 - F.col("sequence.bin")).otherwise(F.shiftleft(F.col("sequence.level").cast("long"), 55) + F.shiftleft(F.col("sequence.shard"), 24) + F.col("sequence.bin"))
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Where every piece of every document is packed."""
    return pack(table(spark, sf_dir, "documents"), *default_files())

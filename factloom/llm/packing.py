"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Every document becomes its ids and a closing id; only longer ones are cut into pieces of the
capacity. Full pieces are sequences of their own. The others are dealt by a hash into cells of
bounded size, and several islands evolve packings of each cell: crossover injects whole well-filled
bins of the other parent, bins with duplicates of their documents are dissolved, and the displaced
documents are best-fitted into the room that is left. After each epoch the elite packing of an
island migrates to its neighbour. Bins that stay poorly filled in the best packing of their cell go
on to a later round with those of other cells, until one cell holds the rest or a round gains little.
A piece that not even the shortest of the others fits beside is a sequence of its own at once, and cells
never grow, so no task gets more than a cell.

Defined cases: a null text is empty and gives one piece of the closing id; repeated rows and null
ids are packed as rows of their own; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import scratch
from . import memory, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Documents of a cell, islands that evolve each cell, epochs between migrations, individuals and
#: crossovers of an island in an epoch, the fill from which a bin counts as done, and the most rounds.
CELL, ISLANDS, EPOCHS, POPULATION, CROSSOVERS, DONE, ROUNDS = 4096, 2, 2, 6, 24, 0.999, 12
#: Share of the pieces that a round places at least; after a round that gains less, its packings stand.
GAIN = 0.1


def pieces(docs: DataFrame, tokenizer: str, capacity: int, closing: int = 0) -> DataFrame:
    """Token pieces of every document with the CRC-32 of their little-endian 32-bit ids."""

    def cut(batches):
        enc = tokens.encoder(tokenizer)
        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1)
            rows: list[tuple] = []
            for at, ids, ends in enc.encode(texts):
                begin = 0
                for k, end in enumerate(ends.tolist()):
                    own = np.append(ids[begin:end], closing).astype("<u4")
                    begin = end
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((ids_of[at + k], p, s, len(part), zlib.crc32(part.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )
                    rows = []

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(memory.by_task(cut), PIECES)


class Packing:
    """One individual: bins as lists of items, with the room left in each."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bit r: some bin has room r

    def _offer(self, b: int) -> None:
        r = self.room[b]
        if r:
            self.by_room.setdefault(r, []).append(b)
            self.rooms |= 1 << r

    def add_bin(self, items: list[int]) -> None:
        self.bins.append(items)
        self.room.append(self.capacity - sum(self.lengths[i] for i in items))
        self._offer(len(self.bins) - 1)

    def fit(self, items) -> Packing:
        """Each item, in the order given, to the bin that it fills best."""
        for i in items:
            n = self.lengths[i]
            fitting = self.rooms >> n
            if not fitting:
                self.bins.append([i])
                self.room.append(self.capacity - n)
                self._offer(len(self.bins) - 1)
                continue
            r = n + (fitting & -fitting).bit_length() - 1
            same = self.by_room[r]
            b = same.pop()
            if not same:
                self.rooms ^= 1 << r
            self.bins[b].append(i)
            self.room[b] = r - n
            self._offer(b)
        return self

    def score(self) -> tuple[int, float]:
        """Fewer bins are better, then unevenly filled ones, whose emptiest bins can be emptied."""
        return len(self.bins), -sum((self.capacity - r) ** 2 for r in self.room)


def crossover(a: Packing, b: Packing, rng: random.Random) -> Packing:
    """``a`` with whole well-filled bins of ``b``; what they displace is best-fitted again."""
    order = sorted(range(len(b.bins)), key=lambda k: b.room[k])
    chosen = [k for k in order[: max(1, len(order) // 2)] if rng.random() < 0.5]
    given = {i for k in chosen for i in b.bins[k]}
    child, displaced = Packing(a.lengths, a.capacity), []
    for k in chosen:
        child.add_bin(list(b.bins[k]))
    worst = set(sorted(range(len(a.bins)), key=lambda k: -a.room[k])[: 1 + len(a.bins) // 50])
    for k, items in enumerate(a.bins):
        if k in worst or any(i in given for i in items):
            displaced += [i for i in items if i not in given]
        else:
            child.add_bin(list(items))
    displaced.sort(key=lambda i: -a.lengths[i])
    return child.fit(displaced)


def evolve(lengths: list[int], capacity: int, seeds: list[list[list[int]]], rng: random.Random) -> Packing:
    """The best packing that an island finds from the packings that live on or migrate to it."""
    falling = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = []
    for bins in seeds:
        p = Packing(lengths, capacity)
        for items in bins:
            p.add_bin(items)
        people.append(p)
    least = -(-sum(lengths) // capacity)
    while len(people) < POPULATION and not any(len(p.bins) == least for p in people):
        if people:
            blur = {i: lengths[i] * rng.uniform(0.8, 1.25) for i in falling}
            order = sorted(falling, key=lambda i: -blur[i])
        else:
            order = falling
        people.append(Packing(lengths, capacity).fit(order))
    people.sort(key=Packing.score)
    for _ in range(CROSSOVERS):
        if len(people[0].bins) == least or len(people) < 2:
            break
        x, y = rng.sample(people, 2)
        child = crossover(x, y, rng)
        if child.score() < people[-1].score():
            people[-1] = child
            people.sort(key=Packing.score)
    return people[0]


_STATE = "item long, length long, cell long, island int, origin int, bin int, n_bins int, score double"


def _island(capacity: int, seed: int):
    def run(key, frame):
        cell, island = int(key[0]), int(key[1])
        frame = frame.sort_values(["item"], kind="stable")
        own = frame[frame["origin"] == frame["origin"].min()]
        items, lengths = own["item"].to_numpy(), own["length"].tolist()
        place = {i: k for k, i in enumerate(items.tolist())}
        seeds = []
        for _, part in frame[frame["bin"] >= 0].groupby("origin"):
            seeds.append([[place[i] for i in g["item"]] for _, g in part.groupby("bin")])
        best = evolve(lengths, capacity, seeds, random.Random(f"{seed}/{cell}/{island}"))
        out = np.zeros(len(items), np.int32)
        for b, bin_items in enumerate(best.bins):
            out[bin_items] = b
        n, score = best.score()
        return pd.DataFrame(
            {"item": items, "length": lengths, "cell": cell, "island": island, "origin": island, "bin": out, "n_bins": n, "score": float(score)}
        )

    return run


def evolve_cells(items: DataFrame, capacity: int, cells: int, turn: int = 0, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(item, length, cell, bin) in the best packing that the islands of each cell found."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    state = items.select(
        "item", "length", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(cells)).alias("cell"), copies.alias("island"),
        F.lit(0).alias("origin"), F.lit(-1).alias("bin"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("score"),
    )
    for epoch in range(epochs):
        if epoch:  # the elite of an island also goes to its neighbour
            guests = state.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
            state = state.unionByName(guests) if islands > 1 else state
        state = state.groupBy("cell", "island").applyInPandas(_island(capacity, epoch), _STATE)
        state = scratch.stored(state, f"pack-epoch{epoch}")
    best = state.groupBy("cell").agg(F.min(F.struct("n_bins", "score", "island"))["island"].alias("island"))
    return state.join(best, ["cell", "island"]).select("item", "length", "cell", "bin")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, cell: int = CELL) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    path = tokenizer or tokens.default_path()
    cut = pieces(docs, path, capacity).withColumn("item", F.monotonically_increasing_id())
    cut = scratch.stored(cut, "pack-pieces")
    spark = docs.sparkSession

    # round r numbers its sequences from r * 2^56, a cell's from cell * 2^20; a full piece has its item's number
    placed: list[DataFrame] = []
    rest = cut.where(F.col("length") < capacity).select("item", "length")
    for turn in range(1, ROUNDS + 1):
        left, shortest, longest = rest.agg(F.count(F.lit(1)), F.min("length"), F.max("length")).first()
        if not left:
            break
        if longest + shortest > capacity and left > 1:  # these can't share a sequence with any piece left
            alone = F.col("length") > capacity - shortest
            placed.append(rest.where(alone).select("item", (F.lit(turn) * F.lit(1 << 56) + F.lit(1 << 55) + F.col("item")).alias("sequence_id")))
            rest = rest.where(~alone)
            left = rest.count()
            if not left:
                break
        cells = -(-left // cell)
        out = evolve_cells(rest, capacity, cells, turn)
        out = out.withColumn("sequence_id", F.lit(turn) * F.lit(1 << 56) + F.col("cell") * F.lit(1 << 20) + F.col("bin"))
        if cells == 1 or turn == ROUNDS:
            placed.append(out.select("item", "sequence_id"))
            break
        fill = out.groupBy("sequence_id").agg((F.sum("length") >= int(DONE * capacity)).alias("done"))
        out = scratch.stored(out.join(fill, "sequence_id").select("item", "length", "sequence_id", "done"), f"pack-round{turn}")
        if out.where("done").count() < GAIN * left:
            placed.append(out.select("item", "sequence_id"))
            break
        placed.append(out.where("done").select("item", "sequence_id"))
        rest = out.where(~F.col("done")).select("item", "length")
    where = placed[0] if placed else spark.createDataFrame([], "item long, sequence_id long")
    for more in placed[1:]:
        where = where.unionByName(more)
    named = cut.where(F.col("length") == capacity).withColumn("sequence_id", F.col("item")).unionByName(
        cut.where(F.col("length") < capacity).join(where, "item")
    )
    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    return named.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
    )

"""N-gram Jaccard self-join by T-occurrence search.

A document is the set of its distinct shingles; equal sets are one class. Two classes link when
their Jaccard similarity reaches the threshold. With t the threshold, x can only link to sets that
hold T = ceil(t |x|) of its shingles. In any order of all shingles two linked sets share ``l`` of the
first |x| - T + l. The order is rarest first: shingles that are frequent in some slice of the corpus
are counted over all of it and stand last, by rising count; the others go by their hashes. So a passage
that many documents hold is in few prefixes. The search has three steps:

1. The prefixes are dealt by shingle. A shingle that only one class has is dropped; a class keeps
   only if enough of its prefix is shared. Most documents end here.
2. The inverted lists of the classes left give blocks: all classes of a list go to the block of the
   list's smallest class, so every pair that shares a prefix shingle meets in some block.
3. A block holds the whole sets. DivideSkip finds each query's partners: the longest lists are set
   aside, the short ones are merged by a heap that skips what can't reach T less the number of long
   lists, and the candidates are looked up in the long lists by binary search. The exact threshold
   follows. A block returns one link for each class joined to another, which keeps every component.

A block of more than ``BLOCK`` classes is split into cells of like size; a task gets two cells whose
sizes can match. Shingles are compared by 64-bit hashes, sets by two of them.

Defined cases: a text of fewer words than a shingle is one shingle; a null text or one without words
has an empty set, links with nothing and is its own component; copies and repeated rows are one
class; documents with a null id take part and carry links, but name a component only where no other
id does, which is null then; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .. import scratch
from ..operators import components
from . import memory, words

SHINGLE, PERCENT = 5, 80
#: Classes of a block that one task indexes at most.
BLOCK = 4096
#: A shingle counts as frequent if so many documents of a slice hold it and at least this share of them; the most frequent ones
#: that are told to all tasks. They only order the prefixes, so neither bound changes a result.
FREQUENT, SHARE, TOLD = 8, 0.005, 500_000


def sets_of(part: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, in one array; and each text's number."""
    w = words.Words(part, words.SPACE, True)
    h, row = words.windows(w, size)
    n = np.bincount(row, minlength=len(part))
    end = np.cumsum(n)
    for a, b in zip((end - n).tolist(), end.tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.bincount(row[fresh], minlength=len(part))


def class_keys(h: np.ndarray, n: np.ndarray, second: bool = False) -> np.ndarray:
    """64 bits of each set, whatever the order of its shingles, 0 for an empty set; or 64 others."""
    mixed = words.mix(words.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) if second else h + np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    end = np.cumsum(n)
    key = words.mix((total[end] - total[end - n]) ^ n.astype(np.uint64))
    return np.where(n == 0, np.uint64(0), np.maximum(key, np.uint64(1))).view(np.int64)


def needed(n, percent: int):
    """Shingles of a set of n that a linked set holds at least."""
    return -(-percent * n // 100)


def shared_least(n, percent: int):
    """l: prefix shingles that linked sets share at least, by the size of the smaller one."""
    return 1 + n // 10


_SIGNED = "doc_id long, digest binary, n_shingles long, class long, other long, frequent binary"


def row_key(text) -> object:
    """128 bits of a text; null for a null one."""
    return F.unhex(F.md5(text.cast("binary")))


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, digest of the text, n_shingles, class, other) of every document; ``class`` and ``other`` are 128 bits of the set.

    One row of each slice also has the slice's frequent shingles with their counts, packed.
    """

    def sign(batches):
        for b in batches:
            for at, part in words.slices(b.column(1)):
                h, n = sets_of(part, size)
                least = max(FREQUENT, SHARE * len(part))
                slot = (h & np.uint64(0xFFFFF)).astype(np.int64)
                shingle, count = np.unique(h[np.bincount(slot, minlength=1)[slot] >= least], return_counts=True)
                many = count >= least
                packed = np.stack([shingle[many], count[many].astype(np.uint64)], 1).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(part)), b.column(2).slice(at, len(part)), pa.array(n.astype(np.int64)), pa.array(class_keys(h, n)),
                        pa.array(class_keys(h, n, True)), pa.array([packed or None] + [None] * (len(part) - 1), pa.binary()),
                    ],
                    ["doc_id", "digest", "n_shingles", "class", "other", "frequent"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key(F.col("text")).alias("digest"))
    return rows.mapInArrow(memory.by_task(sign), _SIGNED)


def frequent(signed: DataFrame, told: int = TOLD) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and each one's level: the logarithm of its count over all slices that it is frequent in."""

    def unpack(batches):
        for b in batches:
            flat = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0].view(np.int64)), pa.array(flat[:, 1].astype(np.int64))], ["shingle", "n"])

    counts = signed.where("frequent is not null").select("frequent").mapInArrow(unpack, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "shingle").limit(told).toArrow()
    shingle, n = top["shingle"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(shingle)
    return shingle[order], np.minimum(np.log2(np.maximum(n[order], 1)).astype(np.int64) * 2, 126) + 1


def levels(h: np.ndarray, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
    """Level of each shingle, 0 for those that are not frequent; None if all are 0."""
    shingle, level = told
    if not len(shingle):
        return None
    at = np.minimum(np.searchsorted(shingle, h), len(shingle) - 1)
    own = np.where(shingle[at] == h, level[at], 0)
    return own if own.any() else None


_DEALT = "bucket int, kind int, class binary, key binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("class", pa.binary()), ("key", pa.binary())])


def _deal(bucket: np.ndarray, kind: int, cls: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """A row of packed numbers for each bucket."""
    order = np.argsort(bucket, kind="stable")
    own, at = np.unique(bucket[order], return_index=True)
    cut = [*at.tolist(), len(order)]
    cls, key = cls[order], key[order]
    pairs = list(zip(cut[:-1], cut[1:], strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(own.astype(np.int32)), pa.array(np.full(len(own), kind, np.int32)), pa.array([cls[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([key[a:b].tobytes() for a, b in pairs], pa.binary())],
        schema=_DEALT_ARROW,
    )


def _unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for c in column.chunks for x in c.to_pylist()), dtype)


def _lists(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverted lists without repeats: keys and classes sorted by both, and where lists begin."""
    order = np.lexsort((cls, key))
    key, cls = key[order], cls[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls = key[fresh], cls[fresh]
    return key, cls, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def memberships(docs: DataFrame, size: int, percent: int, buckets: int, told: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pivot, class): the blocks that each class takes part in, repeats included."""
    sent = docs.sparkSession.sparkContext.broadcast(told)

    def emit(batches):
        for b in batches:
            for _, part in words.slices(b.column(0)):
                h, n = sets_of(part, size)
                cls = class_keys(h, n)
                _, first = np.unique(cls, return_index=True)  # copies in one slice count once
                mine = np.zeros(len(n), bool)
                mine[first] = True
                mine &= n > 0
                end = np.cumsum(n)
                rank = np.arange(len(h)) - np.repeat(end - n, n)
                level = levels(h, sent.value)
                if level is not None:  # rarest first; in a level by hash, in which each set ascends already
                    h = h[np.argsort((np.repeat(np.arange(len(n)), n) << 7) | level, kind="stable")]
                spare = n - needed(n, percent)
                keep = np.repeat(mine, n) & (rank < np.repeat(spare + shared_least(n, percent), n))
                core = rank[keep] <= np.repeat(spare, n)[keep]
                hk = h[keep]
                yield _deal(
                    ((hk >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), 0, np.repeat(cls, n)[keep],
                    ((hk & np.uint64(0x7FFFFFFF)) << np.uint64(1) | core).astype(np.uint32),
                )
                yield _deal((buckets + cls[mine].view(np.uint64) % np.uint64(buckets)).astype(np.int32), 1, cls[mine], n[mine].astype(np.int64))

    def share(key, table):
        bucket = key[0].as_py()
        cls = _unpack(table["class"], np.int64)
        if bucket >= buckets:  # sizes, on their way to their class
            return pa.Table.from_batches([_deal(np.full(len(cls), bucket - buckets), 1, cls, _unpack(table["key"], np.int64))])
        found, cls, begin = _lists(_unpack(table["key"], np.uint32), cls)
        # the same shingle may be core to one set and not to another
        shingle = found >> np.uint32(1)
        edge = np.concatenate([[True], shingle[1:] != shingle[:-1]]) if len(found) else np.zeros(0, bool)
        group = np.cumsum(edge) - 1
        several = np.bincount(group, minlength=1)[group] > 1 if len(group) else edge
        out = np.int64(bucket) << 32 | found[several].astype(np.int64)
        cls = cls[several]
        return pa.Table.from_batches([_deal((cls.view(np.uint64) % np.uint64(buckets)).astype(np.int32), 0, cls, out)])

    def survive(key, table):
        kind = table["kind"].to_numpy()
        sized, posted = table.filter(pa.array(kind == 1)), table.filter(pa.array(kind == 0))
        cls, n = _unpack(sized["class"], np.int64), _unpack(sized["key"], np.int64)
        order = np.lexsort((n, cls))  # of sets that share a key the smallest decides, which keeps more
        cls, first = np.unique(cls[order], return_index=True)
        n = n[order][first]
        pc, pk = _unpack(posted["class"], np.int64), _unpack(posted["key"], np.int64)
        at = np.searchsorted(cls, pc)
        enough = np.bincount(at, minlength=len(cls)) >= shared_least(needed(n, percent), percent)
        keep = enough[at] & (pk & 1 == 1)
        pc, pk = pc[keep], pk[keep]
        return pa.Table.from_batches([_deal((pk >> 32).astype(np.int32), 0, pc, pk)])

    def block(key, table):
        found, cls, begin = _lists(_unpack(table["key"], np.int64), _unpack(table["class"], np.int64))
        length = np.diff(np.append(begin, len(found)))
        pivot = np.repeat(cls[begin], length)  # classes of a list ascend
        several = np.repeat(length > 1, length)
        pairs = np.unique(np.stack([pivot[several], cls[several]], 1), axis=0)
        return pa.table({"pivot": pairs[:, 0], "class": pairs[:, 1]})

    dealt = docs.select("text").mapInArrow(memory.by_task(emit), _DEALT)
    shared = dealt.groupBy("bucket").applyInArrow(memory.by_group(share), _DEALT)
    left = shared.groupBy("bucket").applyInArrow(memory.by_group(survive), _DEALT)
    return left.groupBy("bucket").applyInArrow(memory.by_group(block), "pivot long, class long")


class Forest:
    """Disjoint sets of places; the smallest place names its set."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Index:
    """Inverted lists over the sets of a block, for T-occurrence queries."""

    def __init__(self, sets: list[np.ndarray], percent: int = PERCENT):
        self.percent = percent
        self.n = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, number = np.unique(flat, return_inverse=True)
        number = number.ravel()
        owner = np.repeat(np.arange(len(sets)), self.n)
        self.posting = owner[np.argsort(number, kind="stable")]  # owners ascend in each list
        self.flat = array("q", self.posting.astype(np.int64).tobytes())
        self.length = np.bincount(number, minlength=1)
        self.begin = np.cumsum(self.length) - self.length
        self.numbers = np.split(number, np.cumsum(self.n)[:-1]) if len(sets) else []

    def _merge(self, lists: np.ndarray, least: int) -> tuple[list[int], list[int]]:
        """Owners on at least ``least`` of the lists, ascending, and on how many of them each is.

        A heap holds the front of every list. Owners that stand on too few fronts are skipped: so many of the smallest fronts are
        taken off that the next one is the smallest owner that can still be on enough, and their lists go on from there.
        """
        flat, n = self.flat, len(lists)
        at, stop = self.begin[lists].tolist(), (self.begin[lists] + self.length[lists]).tolist()
        heap = [flat[at[k]] * n + k for k in range(n)]
        heapify(heap)
        owners, counts = [], []
        while len(heap) >= least:
            front = heap[0] // n
            taken = []
            while heap and heap[0] // n == front:
                taken.append(heappop(heap) % n)
            if len(taken) >= least:
                owners.append(front)
                counts.append(len(taken))
                for k in taken:
                    at[k] += 1
                    if at[k] < stop[k]:
                        heappush(heap, flat[at[k]] * n + k)
                continue
            while len(taken) < least - 1 and heap:
                taken.append(heappop(heap) % n)
            if not heap:
                break
            target = heap[0] // n
            for k in taken:
                at[k] = bisect_left(flat, target, at[k], stop[k])
                if at[k] < stop[k]:
                    heappush(heap, flat[at[k]] * n + k)
        return owners, counts

    def query(self, q: int) -> np.ndarray:
        """Places of the other sets that link with set q."""
        n, p = int(self.n[q]), self.percent
        lists = self.numbers[q]
        lists = lists[self.length[lists] > 1]
        least = int(needed(n, p))
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(self.length[lists], kind="stable")]
        # DivideSkip: T / (0.01 log2 M + 1) of the longest lists stay out of the merge, M the longest
        longest = int(self.length[lists[-1]])
        aside = min(int(least / (0.01 * np.log2(longest) + 1)), least - 1)
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        owners, counts = self._merge(short, least - aside)
        seen, count = np.array(owners, np.int64), np.array(counts, np.int64)
        keep = seen != q
        seen, count = seen[keep], count[keep]
        m = self.n[seen]
        # exact: 100 * both >= percent * (n + m - both)
        wanted = -(-p * (n + m) // (100 + p))
        keep = np.minimum(n, m) >= wanted
        seen, count, wanted = seen[keep], count[keep].copy(), wanted[keep]
        for k, number in enumerate(long):
            if not len(seen):
                break
            own = self.posting[self.begin[number] : self.begin[number] + self.length[number]]
            place = np.searchsorted(own, seen)
            count += own[np.minimum(place, len(own) - 1)] == seen
            if k % 16 == 15:  # those that the lists left can't lift to the threshold
                keep = count + (len(long) - 1 - k) >= wanted
                seen, count, wanted = seen[keep], count[keep], wanted[keep]
        return seen[count >= wanted]

    def forest(self) -> Forest:
        """All links' components. Members of the densest set's component need no query of their own:
        two of them are joined already, and any other pair is found from its other end."""
        f = Forest(len(self.n))
        if not len(self.n):
            return f
        owner = np.repeat(np.arange(len(self.n)), self.n)
        length = self.length[np.concatenate(self.numbers)]
        able = np.bincount(owner, weights=length > 1, minlength=len(self.n)) >= needed(self.n, self.percent)
        density = np.where(able, np.bincount(owner, weights=length, minlength=len(self.n)), -1)
        dense = int(density.argmax())
        for q in [dense, *np.flatnonzero(able).tolist()]:
            if q == dense or f.find(q) != f.find(dense):
                for x in self.query(q).tolist():
                    f.join(q, x)
        return f


def block_links(texts: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) of nodes: a spanning forest of the links inside each block's tasks; ``texts`` has one text a node."""

    def search(key, table):
        nodes = table["node"].to_numpy()
        sets: dict[int, np.ndarray] = {}
        base = 0
        for chunk in table["text"].chunks:
            for at, part in words.slices(chunk):
                h, n = sets_of(part, size)
                end = np.cumsum(n)
                for r, node in enumerate(nodes[base + at : base + at + len(part)].tolist()):
                    if node not in sets:
                        sets[node] = h[end[r] - n[r] : end[r]].copy()
            base += len(chunk)
        names = sorted(sets)
        f = Index([sets[i] for i in names], percent).forest()
        roots = [f.find(k) for k in range(len(names))]
        pairs = [(names[k], names[r]) for k, r in enumerate(roots) if k != r]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return members.join(texts, "node").groupBy("task").applyInArrow(memory.by_group(search), "a long, b long")


def tasks(members: DataFrame, percent: int, block: int) -> DataFrame:
    """(task, node): a whole block, or for a large one each pair of cells that can match.

    Cells are bands of sizes by the factor 100 / percent, so only sizes in the same or the next band
    match; a band of many classes is cut by hash.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    banded = members.withColumn("band", band)
    # a large block's classes meet as counts of its bands only; their own rows never meet by block alone
    counts = banded.groupBy("pivot", "band").agg(F.count(F.lit(1)).alias("n"))
    per = counts.groupBy("pivot").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("n") / block).cast("int")))).alias("cells"))
    large = per.where(F.col("total") > block).select(F.col("pivot").alias("big"), "cells")
    found = scratch.hot_join(banded, large, F.col("pivot"), "big", F.col("node"), "jaccard-large", 16 + 8 * F.size("cells"))
    whole = found.where("big is null").select(F.xxhash64("pivot").alias("task"), "node")
    b, own = F.col("band"), F.pmod(F.xxhash64("node"), F.try_element_at("cells", F.col("band"))).cast("int")

    def cells(k):
        return F.sequence(F.lit(0), F.coalesce(F.try_element_at("cells", k), F.lit(1)) - 1)

    def named(low, i, j, side):
        return F.struct(low.alias("low"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    split = found.where("big is not null").withColumn("own", own)
    split = split.select(
        "pivot", "node",
        F.explode(
            F.concat(
                F.transform(cells(b), lambda j: named(b, F.least("own", j), F.greatest("own", j), 0)),
                F.transform(cells(b + 1), lambda j: named(b, F.col("own"), j, 1)),
                F.transform(cells(b - 1), lambda j: named(b - 1, j, F.col("own"), 1)),
            )
        ).alias("pair"),
    )
    split = split.select(F.xxhash64("pivot", "pair.low", "pair.i", "pair.j", "pair.side").alias("task"), "node")
    return whole.unionByName(split)


def _grouped(docs: DataFrame, size: int, percent: int, block: int, buckets: int | None) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and (class, other, group, component) of every class; groups are numbers, a component is an id or null."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = scratch.stored(signatures(docs, size), "jaccard-signatures")
    full = signed.where("n_shingles > 0")
    # copies of a hot text meet as partial minima only; the representative's text is found by its id and digest
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    reps = full.groupBy("class", "other").agg(first, F.max("n_shingles").alias("n_shingles"))
    reps = reps.select("class", "other", "n_shingles", F.col("first.doc_id").alias("id"), F.col("first.digest").alias("digest"), F.monotonically_increasing_id().alias("node"))
    reps = scratch.stored(reps, "jaccard-classes")
    pairs = memberships(docs, size, percent, buckets, frequent(signed)).distinct()
    members = scratch.stored(pairs.join(reps.select("class", "node", "n_shingles"), "class").select("pivot", "node", "n_shingles"), "jaccard-members")
    # one text a node: rows that share id and text are one before they meet
    wanted = members.select("node").distinct().join(reps, "node").select("node", F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "digest")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), row_key(F.col("text")).alias("digest"), "text")
    texts = rows.join(wanted, ["id", "digest"]).groupBy("node").agg(F.any_value("text").alias("text"))
    links = block_links(texts, tasks(members, percent, block), size, percent)
    labels = components.components(links)
    grouped = reps.join(labels.select(F.col("id").alias("node"), F.col("component").alias("label")), "node", "left").withColumn("group", F.coalesce("label", "node"))
    names = grouped.groupBy("group").agg(F.min("id").alias("component"))
    return signed, scratch.stored(grouped.join(names, "group").select("class", "other", "group", "component"), "jaccard-named")


def similar(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    signed, named = _grouped(docs, size, percent, block, buckets)
    none = F.col("n_shingles") == 0
    return signed.join(named, ["class", "other"], "left").select(
        "doc_id", "n_shingles", F.when(none, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")
    )


def one_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with its columns, and every row without words.

    A group's row is that of the smallest id (a null id is the last), then of the smallest text digest; of rows that share both, any
    one stays.
    """
    signed, named = _grouped(docs, SHINGLE, PERCENT, BLOCK, None)
    rows = signed.where("n_shingles > 0").join(named, ["class", "other"])
    kept = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    kept = scratch.stored(kept.select("first.doc_id", "first.digest"), "jaccard-kept")
    own, text, key = (scratch.column_like(c, docs.columns) for c in ("_own", "_digest", "_key"))
    least = F.lit(-(1 << 63))
    # rows that share id and text with another row, and are kept, are the few that must be thinned out
    repeated = signed.where("n_shingles > 0").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = repeated.join(kept, repeated["doc_id"].eqNullSafe(kept["doc_id"]) & (repeated["digest"] == kept["digest"]), "left_semi").select("doc_id", "digest", F.lit(True).alias("twice"))
    marked = kept.join(repeated, kept["doc_id"].eqNullSafe(repeated["doc_id"]) & (kept["digest"] == repeated["digest"]), "left").select(
        F.coalesce(kept["doc_id"], least).alias(own), kept["digest"].alias(key), F.coalesce("twice", F.lit(False)).alias("twice")
    )
    marked, small = scratch.measured(marked, "jaccard-marked", 40)
    keyed = docs.withColumn(text, row_key(F.col("text")))
    match = (F.coalesce(keyed["doc_id"].cast("long"), least) == F.col(own)) & (keyed[text] == F.col(key))
    side = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    once = keyed.join(side(marked.where("not twice").drop("twice")), match, "left_semi").drop(text)
    again = keyed.join(side(marked.where("twice").drop("twice")), match, "left_semi").dropDuplicates(["doc_id", text]).drop(text)
    wordless = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(again).unionByName(wordless)

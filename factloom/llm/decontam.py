"""Benchmark decontamination with a stored, distributed positional inverted index.

``build`` cuts the corpus into slices of some megabytes and writes, for each slice and range of term hashes (bucket), the sorted terms
with their positions, packed. The files are partitioned by bucket, and a bucket's slices are dealt over several tasks, so no term's
list is ever gathered in one place. The index is a table in a folder that later searches, with other benchmarks too, read again.

``search`` reads the buckets that hold a benchmark's terms. The terms' frequencies in the whole corpus say which term of a phrase is
its rarest. The benchmark's lists meet by slice, where each phrase's offset-adjusted lists are intersected from the rarest term on:
its positions give candidate starts, and each further list, the next rarer first, is probed by binary search. With ``slop`` every term
may stand that many words from its place (proximity); 0 is the exact phrase.

The benchmark is told to the tasks in blocks of at most ``BLOCK_BYTES`` of its text, one after another; a larger one takes several
passes over the index, whose matches are merged by document.

Defined cases: null texts have no words; a document or benchmark without words hits nothing; items with a null id are left out and
items of equal id count once; repeated rows and null ``doc_id`` give a row each; other columns are ignored; an empty table gives an
empty result. A text longer than a slice is a slice of its own. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import scratch
from . import memory, words
from .jaccard import row_key

WINDOW = 13
#: Words that a term may stand from its place for a proximity match of the query.
NEAR = 1
#: Text of a block of benchmark items that is told to every task at most.
BLOCK_BYTES = 32_000_000
#: Ranges of term hashes (a power of two); the slices of a range are dealt into parts, ``DEALT`` of all ranges for a shuffle partition.
BUCKETS, DEALT = 64, 4
_SHIFT, _POSITION = np.uint64(64 - 6), 40
#: Bucket of the rows that describe a slice's documents.
DOCUMENTS = -1


@dataclass
class Index:
    """A stored index: the folder, and the type of the documents' key."""

    spark: SparkSession
    path: str
    key: str

    @property
    def schema(self) -> str:
        return f"slice long, terms binary, counts binary, low binary, high binary, keys array<{self.key}>, ends binary, bucket int"

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _postings(w: words.Words) -> list[tuple]:
    """(bucket, terms, counts, low and high halves of the steps between positions) of a slice's words."""
    order = np.argsort(w.hash, kind="stable")
    term = w.hash[order]
    begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
    step = np.diff(order, prepend=0)
    step[begin] = order[begin]
    terms, counts = term[begin], np.diff(np.append(begin, len(term))).astype(np.uint32)
    low, high = (step & 0xFFFF).astype(np.uint16), (step >> 16).astype(np.uint32)
    first = np.searchsorted(terms >> _SHIFT, np.arange(BUCKETS + 1))
    word = np.append(begin, len(term))[first]
    return [
        (b, terms[first[b] : first[b + 1]].tobytes(), counts[first[b] : first[b + 1]].tobytes(), low[word[b] : word[b + 1]].tobytes(), high[word[b] : word[b + 1]].tobytes())
        for b in range(BUCKETS) if first[b] < first[b + 1]
    ]


def build(docs: DataFrame, path: str | None = None, key: str = "doc_id") -> Index:
    """Write the index of the ``text`` of ``docs``, whose rows are named by ``key``, and return it."""
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    index = Index(spark, path or scratch.folder(spark, "positions"), kind)

    def cut(batches):
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for b in batches:
            for at, part in words.slices(b.column(1)):
                w = words.Words(part, words.NOT_ALNUM, True)
                own = b.column(0).slice(at, len(part))
                rows = [(number, *p[1:], None, None, p[0]) for p in _postings(w)]
                rows.append((number, None, None, None, None, own.to_pylist(), w.row_end.astype(np.int64).tobytes(), DOCUMENTS))
                types = [pa.int64(), *[pa.binary()] * 4, pa.list_(own.type), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [*"slice terms counts low high keys ends bucket".split()])
                number += 1

    cut_rows = docs.select(key, "text").mapInArrow(memory.by_task(cut), index.schema)
    parts = -(-DEALT * int(spark.conf.get("spark.sql.shuffle.partitions")) // BUCKETS)
    dealt = cut_rows.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts)))
    dealt.repartition("bucket", "part").drop("part").write.partitionBy("bucket").parquet(index.path)
    return index


@dataclass
class Phrases:
    """Windows of benchmark items: rows of term numbers, -1 beyond a short window's end; ``rarity`` of each term."""

    vocabulary: np.ndarray
    terms: np.ndarray
    size: np.ndarray
    item: np.ndarray
    ids: list[str]
    rarity: np.ndarray


def compile_items(items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
    """Phrases of (id, text) items; those without words give none. All terms are equally rare as yet."""
    w = words.Words(pa.array([t for _, t in items], pa.large_string()), words.NOT_ALNUM, True)
    vocabulary, term = np.unique(w.hash, return_inverse=True)
    term = term.ravel()
    n = w.counts()
    first, count = w.row_end - n, np.where(n >= window, n - window + 1, np.minimum(n, 1))
    item = np.repeat(np.arange(len(items)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - first, count)
    size = np.minimum(n, window)[item]
    place = at[:, None] + np.arange(window)
    inside = np.arange(window) < size[:, None]
    terms = np.where(inside, term[np.minimum(place, max(0, len(term) - 1))] if len(term) else -1, -1)
    return Phrases(vocabulary, terms.reshape(-1, window), size, item, [i for i, _ in items], np.ones(len(vocabulary), np.int64))


class Lists:
    """The lists of a phrase set's terms in one slice; positions of different documents are ``gap`` words further apart."""

    def __init__(self, term: np.ndarray, position: np.ndarray, ends: np.ndarray, n_terms: int, gap: int = 0):
        self.ends, self.gap = ends, gap
        self.row_of = lambda p: np.searchsorted(ends, p, "right")
        if gap:
            position = position + gap * self.row_of(position)
        self.keys = (term.astype(np.int64) << _POSITION) | position
        self.keys.sort()
        self.count = np.bincount(term, minlength=n_terms)
        self.begin = np.cumsum(self.count) - self.count
        self.spread = ends + gap * np.arange(len(ends))  # where rows end among the positions

    def split(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and word of positions that stand in a row."""
        row = np.searchsorted(self.spread, position, "right")
        return row, position - self.gap * row

    def find(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position of each term from ``low`` to ``high``, or -1."""
        at = np.searchsorted(self.keys, (term << _POSITION) | np.maximum(low, 0))
        found = self.keys[np.minimum(at, len(self.keys) - 1)]
        near = (at < len(self.keys)) & (found <= ((term << _POSITION) | np.maximum(high, 0))) & (high >= 0) & (term >= 0)
        return np.where(near, found & ((1 << _POSITION) - 1), -1)


def occurrences(lists: Lists, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, positions of its words, -1 beyond its end) of every occurrence in a slice.

    With ``slop`` an occurrence has each term within that many words of its place after a common start; of several
    positions of a term the one nearest to its place counts, the earlier of two.
    """
    window = phrases.terms.shape[1]
    none = np.zeros(0, np.int64), np.zeros((0, window), np.int64)
    if not len(phrases.size) or not len(lists.keys):
        return none
    there = np.where(phrases.terms >= 0, lists.count[phrases.terms], 1) > 0
    live = np.flatnonzero(there.all(axis=1))
    if not len(live):
        return none
    terms = phrases.terms[live]
    order = np.argsort(np.where(terms >= 0, phrases.rarity[terms], np.iinfo(np.int64).max), axis=1, kind="stable")
    anchor = terms[np.arange(len(live)), order[:, 0]]
    n = lists.count[anchor]
    ends = np.cumsum(n)
    which = np.repeat(np.arange(len(live)), n)
    posting = np.arange(ends[-1]) + np.repeat(lists.begin[anchor] - ends + n, n)
    start = (lists.keys[posting] & ((1 << _POSITION) - 1)) - order[which, 0]
    if slop:  # the anchor too may stand off its place
        start = (start[:, None] + np.arange(-slop, slop + 1)).ravel()
        which = np.repeat(which, 2 * slop + 1)
        fresh = np.unique((which << _POSITION) | np.maximum(start, 0), return_index=True)[1]
        which, start = which[fresh], start[fresh]
    keep = start >= -slop
    which, start = which[keep], start[keep]
    for step in range(0 if slop else 1, window):
        offset = order[which, step]
        t, due = terms[which, offset], start + offset
        keep = (t < 0) | (lists.find(t, due - slop, due + slop) >= 0)
        which, start = which[keep], start[keep]
    found = live[which]
    places = np.full((len(found), window), -1, np.int64)
    for k in range(window):
        t, due = phrases.terms[found, k], start + k
        best = np.full(len(found), -1, np.int64)
        for off in sorted(range(-slop, slop + 1), key=lambda x: (abs(x), x)):
            at = lists.find(t, due + off, due + off) if slop else np.where(t >= 0, due, -1)
            best = np.where(best < 0, at, best)
        places[:, k] = best
    first, last = lists.split(places.max(axis=1))[0], lists.split(np.where(places < 0, np.iinfo(np.int64).max, places).min(axis=1))[0]
    inside = first == last  # in one document
    return found[inside], places[inside]


def _blocks(benchmark: DataFrame, limit: int):
    """Blocks of items, each of at most ``limit`` bytes or a single item, read one after another."""
    block, size = [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text")
    for item, text in rows.toLocalIterator():
        n = len(text.encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    yield block


def _unpacked(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions from the steps between them, of lists of the given lengths."""
    total = np.cumsum(steps)
    begin = np.cumsum(counts) - counts
    return total - np.repeat(total[begin] - steps[begin], counts) if len(counts) else total


def frequencies(index: Index, vocabulary: np.ndarray) -> np.ndarray:
    """How often each term of the ascending vocabulary stands in the whole corpus; only counts travel."""
    sent = index.spark.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = sent.value
        total = np.zeros(len(known), np.int64)
        for b in batches:
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint32)
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                own = known[at] == t
                total[at[own]] += c[own]
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["term", "n"])

    rows = index.rows().where(F.col("bucket").isin(_buckets(vocabulary))).select("terms", "counts")
    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for term, n in rows.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
            out[term] = n
    return out


def _buckets(vocabulary: np.ndarray) -> list[int]:
    return np.unique(vocabulary >> _SHIFT).astype(int).tolist()


def _lists(index: Index, vocabulary: np.ndarray) -> DataFrame:
    """(slice, terms, counts, low, high, keys, ends): the lists of a vocabulary, terms by number, and the rows of all slices' documents."""
    sent = index.spark.sparkContext.broadcast(vocabulary)

    def chosen(batches):
        known = sent.value
        for b in batches:
            for k in range(b.num_rows):
                row = b.slice(k, 1)
                if row.column(6)[0].is_valid:
                    yield row
                    continue
                terms, counts, low, high = (np.frombuffer(row.column(c)[0].as_buffer(), t) for c, t in ((1, np.uint64), (2, np.uint32), (3, np.uint16), (4, np.uint32)))
                at = np.minimum(np.searchsorted(known, terms), max(len(known) - 1, 0))
                own = known[at] == terms
                if own.any():
                    each = np.repeat(own, counts)
                    packed = [at[own].astype(np.uint32), counts[own], low[each], high[each]]
                    yield pa.RecordBatch.from_arrays([row.column(0), *[pa.array([x.tobytes()], pa.binary()) for x in packed], row.column(5), row.column(6)], schema=b.schema)

    rows = index.rows().where(F.col("bucket").isin([DOCUMENTS, *_buckets(vocabulary)])).drop("bucket")
    return rows.mapInArrow(memory.by_task(chosen), index.schema.removesuffix(", bucket int"))


def _slice(table: pa.Table, n_terms: int, gap: int) -> tuple[list, Lists]:
    """Keys of a slice's documents, and its lists."""
    keys, ends, term, position = [], np.zeros(0, np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for r in table.select(["terms", "counts", "low", "high", "keys", "ends"]).to_pylist():
        if r["ends"] is not None:
            keys, ends = r["keys"], np.frombuffer(r["ends"], np.int64)
            continue
        counts = np.frombuffer(r["counts"], np.uint32)
        steps = np.frombuffer(r["low"], np.uint16).astype(np.int64) | np.frombuffer(r["high"], np.uint32).astype(np.int64) << 16
        term.append(np.repeat(np.frombuffer(r["terms"], np.uint32), counts))
        position.append(_unpacked(steps, counts))
    return keys, Lists(np.concatenate(term), np.concatenate(position), ends, n_terms, gap)


def _ranked(index: Index, items: list[tuple[str, str]], window: int) -> Phrases:
    phrases = compile_items(items, window)
    phrases.rarity = frequencies(index, phrases.vocabulary)
    return phrases


def search(index: Index, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, slice, row, item_id, first, last, exact) of every match of a window of an item: the document, the item, the first and the
    last word of the match, and whether the words stand as in the item."""
    spark, out = index.spark, None
    schema = f"key {index.key}, slice long, row long, item_id string, first long, last long, exact boolean"
    for items in _blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(_ranked(index, items, window))

        def find(key, table, sent=sent):
            p = sent.value
            keys, lists = _slice(table, len(p.vocabulary), slop + 1)
            found, places = occurrences(lists, p, slop)
            last, first = places.max(axis=1, initial=-1), np.where(places < 0, np.iinfo(np.int64).max, places).min(axis=1, initial=np.iinfo(np.int64).max)
            exact = ((np.diff(places, axis=1) == 1) | (places[:, 1:] < 0)).all(axis=1)
            row, begin = lists.split(first)
            base = np.concatenate([[0], lists.ends])[row]
            columns = [
                pa.array([keys[r] for r in row.tolist()], table.schema.field("keys").type.value_type), pa.array(np.full(len(row), key[0].as_py(), np.int64)), pa.array(row),
                pa.array([p.ids[i] for i in p.item[found].tolist()], pa.string()), pa.array(begin - base), pa.array(lists.split(last)[1] - base), pa.array(exact),
            ]
            return pa.table(columns, ["key", "slice", "row", "item_id", "first", "last", "exact"])

        own = _lists(index, sent.value.vocabulary).groupBy("slice").applyInArrow(memory.by_group(find), schema)
        out = own if out is None else out.unionByName(own)
    return out


_HITS = "slice long, row long, n_words long, starts array<int>, stops array<int>, items array<string>, near array<string>"
_COUNTS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long"


def _finish(n_words: int, n_hit: int, items: set[str], near: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words, len(near)


def _by_row(lists: Lists, phrases: Phrases, found: np.ndarray, places: np.ndarray) -> dict[int, set[str]]:
    """Items that occur in each row."""
    out: dict[int, set[str]] = {}
    if len(found):
        pairs = np.unique(np.stack([lists.split(places.max(axis=1))[0], phrases.item[found]], 1), axis=0)
        for r, i in pairs.tolist():
            out.setdefault(r, set()).add(phrases.ids[i])
    return out


def _hits(lists: Lists, phrases: Phrases, slop: int, near: int) -> tuple[np.ndarray, dict, dict]:
    """Which words of the slice are hit, and the items that occur and that nearly occur in each row."""
    found, places = occurrences(lists, phrases, slop)
    hit = np.zeros(lists.ends[-1] if len(lists.ends) else 0, bool)
    hit[lists.split(places[places >= 0])[1]] = True
    items = _by_row(lists, phrases, found, places)
    return hit, items, items if near == slop else _by_row(lists, phrases, *occurrences(lists, phrases, near))


def judge(index: Index, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, near: int = NEAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, counts) of every document of the index: words, hit words, items that occur and that nearly occur, and the verdict."""
    spark, passes = index.spark, []
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        sent = spark.sparkContext.broadcast(_ranked(index, first, window))

        def counts(key, table):
            p = sent.value
            keys, lists = _slice(table, len(p.vocabulary), max(slop, near) + 1)
            hit, items, close = _hits(lists, p, slop, near)
            total = np.concatenate([[0], np.cumsum(hit)])
            n, n_hit = np.diff(lists.ends, prepend=0).tolist(), np.diff(total[lists.ends], prepend=0).tolist()
            rows = [_finish(n[r], n_hit[r], items.get(r, set()), close.get(r, set())) for r in range(len(keys))]
            types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64()]
            columns = [pa.array(keys, table.schema.field("keys").type.value_type), *[pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)]]
            return pa.table(columns, ["key", *(x.split()[0] for x in _COUNTS.split(", "))])

        return _lists(index, sent.value.vocabulary).groupBy("slice").applyInArrow(memory.by_group(counts), f"key {index.key}, {_COUNTS}")

    while first is not None:
        sent = spark.sparkContext.broadcast(_ranked(index, first, window))

        def spans(key, table, sent=sent):
            p = sent.value
            keys, lists = _slice(table, len(p.vocabulary), max(slop, near) + 1)
            hit, items, close = _hits(lists, p, slop, near)
            rows = []
            for r, (a, b) in enumerate(zip([0, *lists.ends[:-1].tolist()], lists.ends.tolist(), strict=False)):
                edge = np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]]))
                rows.append((keys[r], key[0].as_py(), r, b - a, np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), sorted(items.get(r, ())), sorted(close.get(r, ()))))
            types = [table.schema.field("keys").type.value_type, *[pa.int64()] * 3, *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.string())] * 2]
            return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, types, strict=True)], ["key", *(x.split()[0] for x in _HITS.split(", "))])

        found = _lists(index, sent.value.vocabulary).groupBy("slice").applyInArrow(memory.by_group(spans), f"key {index.key}, {_HITS}")
        passes.append(scratch.stored(found, "decontam-pass"))
        sent.destroy()
        first, second = second, next(blocks, None)
    merged = passes[0]
    for more in passes[1:]:
        merged = merged.unionByName(more)
    # a document has one row a pass, so what meets here is bounded by the passes
    merged = merged.groupBy("slice", "row", "key", "n_words").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "stops", "items", "near")])

    def finish(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                edge = np.zeros(r["n_words"] + 1, np.int64)
                np.add.at(edge, r["starts"], 1)
                np.add.at(edge, r["stops"], -1)
                rows.append(_finish(r["n_words"], int((np.cumsum(edge) > 0).sum()), set(r["items"]), set(r["near"])))
            types = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("key")), *columns], ["key", *(x.split()[0] for x in _COUNTS.split(", "))])

    return merged.mapInArrow(memory.by_task(finish), f"key {index.key}, {_COUNTS}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, near: int = NEAR, block_bytes: int = BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items) of every document, by an index of them at ``path``."""
    index = build(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)
    return judge(index, benchmark, window, slop, near, block_bytes).withColumnRenamed("key", "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated, with their columns.

    The verdict is that of a row's text, so it goes by the text's digest: rows that share an id, or have none, do not go with each
    other. A null text stays.
    """
    bad = scratch.column_like("_bad", docs.columns)
    index = build(docs.select(row_key(F.col("text")).alias("digest"), "text"), key="digest")
    found = judge(index, benchmark, near=0).where("contaminated").select(F.col("key").alias(bad)).distinct()
    return scratch.hot_join(docs, found, row_key(F.col("text")), bad, F.monotonically_increasing_id(), "contaminated", 24, "left_anti")

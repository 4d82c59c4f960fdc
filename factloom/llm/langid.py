"""Language identification by language-bitmask n-gram filters.

Two hashed tables of language bitmasks form a bit-sliced Bloom filter: one bit of a slot for each
language, so a single probe of both tables returns all languages that may contain an n-gram. A text's
score for a language is the number of its n-grams with that bit, corrected for the false positives
expected from how full that language's slices are. The best corrected count decides.

The filters are fitted on a bounded sample of labelled rows: about ``SAMPLE`` different texts (all of a
language that has fewer) and the ``GRAMS`` most widespread n-grams of each language. Prediction covers
every whole text. The driver holds the languages and the sample's n-grams, so they grow with the number
of languages, not with that of documents.

Defined cases: a null text or one without a letter is ``und`` with score 0; a text with letters but
no known n-gram gets the most frequent learned language with score 0; without labelled rows every
prediction is ``und``; ties go to the more frequent language, then by name; repeated rows and null
ids are kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import memory, words

#: Documents sampled and n-grams kept per language, bits of a table's slot number.
SAMPLE, GRAMS, BITS = 400, 6000, 17
#: Bytes of text handled at once; each takes about forty bytes of working arrays. A longer text goes in parts.
SLICE = 2_000_000
#: The pipeline keeps a text whose language's filter holds so many n-grams for each n-gram of letters and spaces, if it has that
#: many of those; digits and symbols are of no language.
KNOWN_SHARE, JUDGED_GRAMS = 0.35, 60
GRAM = 4
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PROSE = _LETTER.copy()
_PROSE[[32, *range(128, 256)]] = True


@dataclass
class Filters:
    languages: list[str]
    first: np.ndarray  # slots x bytes of the bitmask
    second: np.ndarray
    false_rate: np.ndarray


def _grams(data: np.ndarray) -> np.ndarray:
    """The four bytes from each place on as a number; the last three places are padded."""
    return np.ndarray((len(data),), "<u4", np.concatenate([data, np.zeros(4, np.uint8)]), strides=(1,))


def _slots(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint32(32 - bits)
    return (g * _A) >> shift, ((g ^ (g >> np.uint32(15))) * _B) >> shift


def _padded(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, a space around each, and their offsets."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), part, pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
    data = words.LOWER[np.frombuffer(spaced.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    return data, offsets - offsets[0]


def fit(labelled: DataFrame, sample: int = SAMPLE, grams: int = GRAMS, bits: int = BITS) -> Filters:
    """Filters from (text, lang) rows."""
    rows = labelled.where("text is not null and lang is not null")
    mark = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts")).collect()
    if not found:
        return Filters([], np.zeros((1 << bits, 0), np.uint8), np.zeros((1 << bits, 0), np.uint8), np.zeros(0))
    sizes = {r["lang"]: r["n"] for r in found}
    languages = sorted(sizes, key=lambda k: (-sizes[k], k))
    # a sample of texts, not of rows: copies of one text are drawn as one
    share = {r["lang"]: min(1.0, sample / r["texts"]) if r["texts"] > 2 * sample else 1.0 for r in found}
    drawn = F.create_map(*[F.lit(x) for k in languages for x in (k, share[k])])[F.col("lang")]
    some = rows.select("text", "lang").where(mark < drawn * 1_000_003).distinct()

    def count(batches):
        for b in batches:
            for at, part in words.slices(b.column(0), SLICE):
                data, offset = _padded(part)
                g, langs = _grams(data), b.column(1).slice(at, len(part)).to_pylist()
                seen: dict[str, list[np.ndarray]] = {}
                for r, lang in enumerate(langs):
                    seen.setdefault(lang, []).append(np.unique(g[offset[r] : max(offset[r], offset[r + 1] - GRAM + 1)]))
                for lang, found in seen.items():
                    u, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u)), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counted = some.select("text", "lang").mapInArrow(memory.by_task(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= grams).select("lang", "gram").collect()
    width = -(-len(languages) // 8)
    first, second = np.zeros((1 << bits, width), np.uint8), np.zeros((1 << bits, width), np.uint8)
    for k, lang in enumerate(languages):
        one, two = _slots(np.array([r["gram"] for r in top if r["lang"] == lang], np.uint32), bits)
        first[one, k // 8] |= np.uint8(1 << (k % 8))
        second[two, k // 8] |= np.uint8(1 << (k % 8))
    full = [((t[:, k // 8] >> (k % 8)) & 1).mean() for k in range(len(languages)) for t in (first, second)]
    return Filters(languages, first, second, np.array(full[0::2]) * np.array(full[1::2]))


def counts(f: Filters, data: np.ndarray, offset: np.ndarray, at_once: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """Corrected n-gram counts of each row and language, and each row's number of n-grams."""
    bits = len(f.first).bit_length() - 1
    n = np.maximum(np.diff(offset) - GRAM + 1, 0)
    out = np.zeros((len(n), len(f.languages)))
    for begin in range(0, len(data), at_once):
        stop = min(begin + at_once, len(data))
        one, two = _slots(_grams(data[begin : stop + GRAM - 1])[: stop - begin], bits)
        row = np.searchsorted(offset, np.arange(begin, stop), "right") - 1
        past = offset[row + 1] - np.arange(begin, stop) < GRAM
        low = int(row[0])
        row -= low
        rows = int(row[-1]) + 1
        for byte in range(f.first.shape[1]):
            mask = np.take(f.first[:, byte], one) & np.take(f.second[:, byte], two)
            mask[past] = 0
            kinds = np.bincount((row << 8) | mask, minlength=rows << 8).reshape(rows, 256)
            own = slice(8 * byte, min(8 * byte + 8, len(f.languages)))
            out[low : low + rows, own] += kinds @ ((np.arange(256)[:, None] >> np.arange(own.stop - own.start)) & 1)
    rate = f.false_rate
    return np.maximum((out - rate * n[:, None]) / np.maximum(1 - rate, 1e-9), 0), n


def _runs(inside: np.ndarray) -> np.ndarray:
    """Places where ``GRAM`` bytes in a row are inside."""
    padded = np.concatenate([inside, np.zeros(GRAM - 1, bool)])
    return np.logical_and.reduce([padded[k : k + len(inside)] for k in range(GRAM)])


def judged(f: Filters, texts: pa.Array):
    """Yields (first row, languages, scores, known shares) by slice: the winner, its share of all corrected
    counts, and its count for each n-gram of letters and spaces (1 for a text with few of those)."""
    names = np.array([*f.languages, "und"], object)
    for at, part in words.slices(texts, SLICE):
        data, offset = _padded(part)
        score, n = counts(f, data, offset)
        # a letter: ASCII ones by byte, others by character where no ASCII one is found
        total = np.concatenate([[0], np.cumsum(_LETTER[data], dtype=np.int32)])
        letters = np.diff(total[offset]) > 0
        for r in np.flatnonzero(~letters & (n > 0)):
            letters[r] = any(c.isalpha() for c in part[int(r)].as_py())
        if f.languages:
            best = np.where(letters, score.argmax(axis=1), len(f.languages))
            share = np.where(letters, score.max(axis=1) / np.maximum(score.sum(axis=1), 1e-9), 0.0)
            prose = np.concatenate([[0], np.cumsum(_runs(_PROSE[data]), dtype=np.int64)])
            stop = np.maximum(offset[1:] - GRAM + 1, offset[:-1])
            prose = prose[stop] - prose[offset[:-1]]
            held = np.where(prose < JUDGED_GRAMS, 1.0, score.max(axis=1) / np.maximum(prose, 1))
        else:
            best, share, held = np.zeros(len(part), int), np.zeros(len(part)), np.zeros(len(part))
        yield at, names[best], np.clip(share, 0, 1), held


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score): the score is the winner's share of all corrected counts."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def judge(batches):
        for b in batches:
            for at, best, share, _ in judged(sent.value, b.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(best)), pa.array(best, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(memory.by_task(judge), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id):
    """The fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the training folds of ``docs`` and predict every document."""
    filters = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    return predict(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, languages: list[str] | None = None, least: float = KNOWN_SHARE) -> DataFrame:
    """The rows of ``docs`` in one of ``languages`` (all learned ones unless said), with their columns.

    A row goes if its text is null or has no letter, if its language is another one, or if its language's filter holds
    less than ``least`` of its n-grams, so that it is in no learned language. Each row is judged by its own text, so rows
    that share an id, or have none, do not go with each other.
    """
    filters = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    sent = docs.sparkSession.sparkContext.broadcast(filters)
    wanted = set(filters.languages if languages is None else languages)
    at_text = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            for at, best, _, held in judged(sent.value, b.column(at_text)):
                right = np.array([x in wanted for x in best], bool) & (held >= least)
                yield b.slice(at, len(best)).filter(pa.array(right))

    return docs.mapInArrow(memory.by_task(keep), docs.schema)

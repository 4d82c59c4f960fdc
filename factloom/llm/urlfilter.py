"""URL filters over a sorted digest array.

Rules and block-list entries are strings. Their 64-bit xxhash keys are sorted into an array that each
worker memory-maps; a url's candidate strings are hashed and probed by one vectorised binary search, and
a hit counts only if the stored string is the same, so collisions do no harm. An entry ``host/path`` fits
the host with its subdomains where the path begins with the entry's; an entry without ``/`` fits a host
that has it as a word of one of its labels. A url has one candidate for each suffix of its host and each
path length that some entry has, and one for each word of the host, so the work does not grow with the
number of entries.

The block list comes from a list or a table of one string column. It is told to the tasks while its size
is within ``ARRAY_BYTES``; a larger one stays a table, which is joined to the distinct candidates.

Defined cases: a null url or one without ``://`` has empty host and path, which no entry fits, and is
allowed; an entry with path ``/`` does not fit a url without a path; null and empty entries fit nothing,
and of repeated ones one counts; ties in length go to the longer host, then the later string; repeated
rows, null ids and other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .. import scratch

#: Rules as (verdict, host and path).
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Block list of the method where none is given: words of host names that sell or track.
BLOCKED = tuple(
    "adult ads adserver bets betting bingo casino cheats cialis clickbait crack escort gambling hookup keygen lottery malware nude "
    "pharmacy phishing pills poker popunder porn roulette sex slots spam sportsbook spyware torrent tracker viagra warez xxx".split()
)
#: Bytes of the packed array of entries that is sent to every worker at most.
ARRAY_BYTES = 64_000_000
@dataclass
class DigestArray:
    """Sorted keys with the strings they stand for, in one packed block of bytes."""

    packed: bytes
    entries: int

    @classmethod
    def build(cls, strings: list[str]) -> DigestArray:
        raw = [s.encode() for s in sorted(set(strings))]
        keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
        order = np.argsort(keys, kind="stable")
        ends = np.cumsum([len(raw[k]) for k in order], dtype=np.uint64)
        return cls(keys[order].tobytes() + ends.tobytes() + b"".join(raw[k] for k in order), len(raw))

    def mapped(self) -> MappedArray:
        """The array memory-mapped from this worker's own file, written once."""
        name = hashlib.sha256(self.packed).hexdigest()[:32]
        if name not in _MAPPED:
            path = os.path.join(tempfile.gettempdir(), f"digests-{name}-{os.getpid()}")
            with open(path, "wb") as f:
                f.write(self.packed)
            _MAPPED[name] = MappedArray(np.memmap(path, np.uint8, "r") if self.packed else np.zeros(0, np.uint8), self.entries)
            os.unlink(path)  # the mapping keeps the pages
        return _MAPPED[name]


class MappedArray:
    def __init__(self, block: np.ndarray, entries: int):
        self.keys = block[: 8 * entries].view(np.uint64)
        self.ends = block[8 * entries : 16 * entries].view(np.uint64)
        self.strings = block[16 * entries :]

    def probe(self, strings: list[bytes]) -> np.ndarray:
        """Which strings are in the array."""
        out = np.zeros(len(strings), bool)
        if not len(self.keys) or not strings:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, h)
        for k in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h)).tolist():
            j = int(at[k])
            while j < len(self.keys) and self.keys[j] == h[k] and not out[k]:  # equal keys stand side by side
                begin = int(self.ends[j - 1]) if j else 0
                out[k] = self.strings[begin : int(self.ends[j])].tobytes() == strings[k]
                j += 1
        return out


_MAPPED: dict[str, MappedArray] = {}


def parts(url) -> tuple:
    """Host, A-Z lower-cased, and path of a url column; empty for a null url or one without ``://``."""
    text = F.coalesce(url, F.lit(""))
    rest = F.when(F.contains(text, F.lit("://")), F.regexp_extract(F.substring(text, F.locate("://", text) + 3, F.length(text)), r"^[^?#]*", 0)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.when(F.contains(rest, F.lit("/")), F.substring(rest, F.locate("/", rest), F.length(rest))).otherwise("")


def _suffixes(host: str) -> list[str]:
    """The host and the domains that it is a subdomain of."""
    labels = host.split(".")
    return [".".join(labels[k:]) for k in range(len(labels))] if host else []


def _words(host: str) -> list[str]:
    """Words of the host's labels."""
    return [w for w in host.replace("-", ".").replace("_", ".").split(".") if w]


def _lengths(strings) -> list[int]:
    """Path lengths that entries have; 0 stands for entries that are words."""
    return sorted({len(s) - s.find("/") if "/" in s else 0 for s in strings})


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Entries of the given path lengths that would fit."""
    out = [s + path[:n] for n in lengths if 0 < n <= len(path) for s in _suffixes(host)]
    return out + _words(host) if lengths[:1] == [0] else out


def _rank(rule: str) -> tuple[int, int, str]:
    return len(rule), rule.find("/"), rule


def _entries(spark, blocked, limit: int) -> tuple[list[str] | None, DataFrame | None]:
    """The block list as strings if its measured size allows, else as a table of ``entry``."""
    if not isinstance(blocked, DataFrame):
        return [b for b in blocked if b], None
    table = blocked.select(F.col(blocked.columns[0]).cast("string").alias("entry")).where("entry <> ''").distinct()
    table, small = scratch.measured(table, "url-entries", F.octet_length("entry") + 16, limit)
    return ([r[0] for r in table.toLocalIterator()], None) if small else (None, table)


def filter_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, array_bytes: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; a rule wins over the block list.

    ``blocked``: entries, or a table whose first column has them.
    """
    sc, verdict_of = pages.sparkSession.sparkContext, {s: v for v, s in rules}
    strings, table = _entries(pages.sparkSession, blocked, ARRAY_BYTES if array_bytes is None else array_bytes)
    rule_array, rule_lengths = sc.broadcast(DigestArray.build(list(verdict_of))), _lengths(verdict_of)
    list_array, list_lengths = sc.broadcast(DigestArray.build(strings or [])), _lengths(strings or [])

    def hits(array: DigestArray, urls: list[tuple[str, str]], lengths: list[int]) -> list[tuple[int, str]]:
        found = [candidates(h, p, lengths) for h, p in urls]
        names = [x for own in found for x in own]
        owner = np.repeat(np.arange(len(urls)), [len(own) for own in found])
        return [(int(owner[j]), names[j]) for j in np.flatnonzero(array.mapped().probe([x.encode() for x in names])).tolist()]

    def judge(batches):
        for b in batches:
            urls = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            rule: list[str | None] = [None] * len(urls)
            listed = [False] * len(urls)
            for k, name in hits(rule_array.value, urls, rule_lengths):
                if rule[k] is None or _rank(name) > _rank(rule[k]):
                    rule[k] = name
            for k, _ in hits(list_array.value, urls, list_lengths):
                listed[k] = True
            verdict = [verdict_of[r] if r else "block" if bad else "allow" for r, bad in zip(rule, listed, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    host, path = parts(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")
    return out if table is None else _by_join(out, table)


def _by_join(judged: DataFrame, table: DataFrame) -> DataFrame:
    """Verdicts by a list that stays a table: each distinct host and path is checked once, its candidates joined to the entries."""
    lengths = [r[0] for r in table.select(F.when(F.contains("entry", F.lit("/")), F.length("entry") - F.locate("/", F.col("entry")) + 1).otherwise(0).alias("n")).distinct().collect()]
    lengths.sort()

    @F.udf("array<string>")
    def made(host, path):
        return candidates(host, path, lengths)

    open_ = judged.where("rule is null").select("host", "path").distinct()
    bad = open_.withColumn("entry", F.explode(made("host", "path"))).join(table, "entry", "left_semi").select(F.col("host").alias("h"), F.col("path").alias("p")).distinct()
    bad = bad.select(F.struct("h", "p").alias("site"))
    met = scratch.hot_join(judged, bad, F.struct(F.col("host").alias("h"), F.col("path").alias("p")), "site", F.monotonically_increasing_id(), "url-blocked", 200)
    block = F.col("rule").isNull() & F.col("site").isNotNull()
    return met.select("page_id", "host", "path", "rule", F.when(block, "block").otherwise(F.col("verdict")).alias("verdict"))

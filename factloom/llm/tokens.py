"""Fast exact encoding with a public ``tokenizers`` file.

The file's own pipeline costs about a second of CPU for a megabyte of text. None of the steps of
the word tokenizer (NFC, white-space folding, lower case, pattern split, byte-level BPE with word
ends, special tokens without white space) looks across white space, so a text's ids are the
concatenation of its white-space separated chunks' ids. Chunks repeat, so each worker keeps the recent
ones in two bounded tables: when the young one is full it becomes the old one, and what is met there
moves on to the new young one. A chunk is found by a 64-bit hash and confirmed by its bytes. Other
tokenizer files go through the library as a whole text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

from . import words

#: The pipeline for which chunk-wise encoding is exact.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters whose class and lower case no Unicode version disputes: ASCII but for the
#: apostrophe, and the Latin-1 letters.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+\Z")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Bytes of text encoded at once; what encoding needs beside its tables grows with it.
SLICE_BYTES = 1_000_000
#: Entries of a table of chunks and of one of runs of characters; a worker has two of each, about 80 MB together.
CHUNKS, RUNS = 520_000, 60_000


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    table = {b: chr(b) for b in shown}
    return [table.get(b) or chr(next(hidden)) for b in range(256)]


def _grown(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """``a`` with room for ``more`` after the first ``used``."""
    if used + more <= len(a):
        return a
    out = np.zeros(max(2 * len(a), used + more), a.dtype)
    out[:used] = a[:used]
    return out


class Chunks:
    """A table of chunks: their bytes and their ids, laid out one after another."""

    def __init__(self, entries: int):
        self.table = words.Table(entries)
        self.used = self.n_ids = self.n_bytes = 0
        self.start, self.byte, self.size, self.length = (np.zeros(1024, np.int32) for _ in range(4))
        self.flat, self.bytes = np.zeros(4096, np.uint32), np.zeros(8192, np.uint8)

    def find(self, found: words.Words, eight: np.ndarray, which: np.ndarray | None = None) -> np.ndarray:
        """Place of each word (or of those in ``which``); -1 where no chunk has its bytes."""
        start, length = (found.start, found.length) if which is None else (found.start[which], found.length[which])
        place = self.table.find(found.hash if which is None else found.hash[which])
        live = np.flatnonzero(place >= 0)
        if not len(live):
            return place
        other = np.ndarray((len(self.bytes) - 7,), "<u8", self.bytes, strides=(1,))  # eight bytes stand behind the last chunk
        row = place[live]
        same = self.length[row] == length[live]
        place[live[~same]] = -1
        live, row = live[same], row[same]
        at, to, left = start[live], self.byte[row], length[live]
        while len(live):  # eight bytes of all that are still alike
            same = ((eight[at] ^ other[to]) & words.KEEP[np.minimum(left, 8)]) == 0
            place[live[~same]] = -1
            more = same & (left > 8)
            live, at, to, left = live[more], at[more] + 8, to[more] + 8, left[more] - 8
        return place

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks one after another, and how many each has."""
        size = self.size[places].astype(np.int64)
        return _gather(self.flat, self.start[places], size, np.concatenate([[0], np.cumsum(size)])), size

    def append(self, found: words.Words, which: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Lay out the words ``which`` with their ids, given as by ``ids``; their places."""
        n, length = len(which), found.length[which]
        total, wide = len(flat), int(length.sum())
        for name in ("start", "byte", "size", "length"):
            setattr(self, name, _grown(getattr(self, name), self.used, n))
        self.flat, self.bytes = _grown(self.flat, self.n_ids, total), _grown(self.bytes, self.n_bytes + 8, wide)
        own = slice(self.used, self.used + n)
        self.start[own], self.byte[own] = self.n_ids + np.cumsum(size) - size, self.n_bytes + np.cumsum(length) - length
        self.size[own], self.length[own] = size, length
        self.flat[self.n_ids : self.n_ids + total] = flat
        ends = np.concatenate([[0], np.cumsum(length)])
        self.bytes[self.n_bytes : self.n_bytes + wide] = _gather(found.data, found.start[which], length, ends)
        self.used, self.n_ids, self.n_bytes = self.used + n, self.n_ids + total, self.n_bytes + wide
        return np.arange(own.start, own.stop)

    def add(self, found: words.Words, which: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Put in words whose hashes are distinct; where another chunk has the hash, it stays."""
        free = self.table.find(found.hash[which]) < 0
        place = self.append(found, which[free], flat[np.repeat(free, size)], size[free])
        self.table.add(found.hash[which[free]], place)


class Encoder:
    """Ids of whole texts, without special tokens added, as the library gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = self._splits_at_space(spec)
        special = "|".join(re.escape(t["content"]) for t in spec.get("added_tokens", []))
        self._special = re.compile(special or r"(?!)")
        alphabet = _byte_alphabet()
        self._bytes = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(33, 256)}
        self._marks = {t["content"][0] for t in spec.get("added_tokens", [])}
        self._runs: dict[str, tuple[int, ...]] = {}
        self._old_runs: dict[str, tuple[int, ...]] = {}
        self._young, self._old = Chunks(CHUNKS), Chunks(1)

    @staticmethod
    def _splits_at_space(spec: dict) -> bool:
        norm = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = all(
            not any(c.isspace() for c in t["content"]) and not t["single_word"] and not t["normalized"]
            for t in spec.get("added_tokens", [])
        )
        return (
            norm == _NORMALIZERS
            and [p.get("type") for p in pre] == ["Split", "ByteLevel"]
            and pre[0]["pattern"] == {"Regex": _SPLIT}
            and spec["model"].get("type") == "BPE"
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and not pre[1].get("add_prefix_space")
            and plain
        )

    def _run(self, run: str) -> tuple[int, ...]:
        """Ids of a run that the young table lacks."""
        ids = self._old_runs.get(run)
        if ids is None:
            ids = tuple([t.id for t in self.tokenizer.model.tokenize(run.translate(self._bytes))])
        if len(self._runs) >= RUNS:
            self._runs, self._old_runs = {}, self._runs
        self._runs[run] = ids
        return ids

    def _encoded(self, found: words.Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words ``which`` one after another, and how many each has."""
        n = found.length[which] + 1  # a space behind each, which no word holds
        ends = np.concatenate([[0], np.cumsum(n)])
        blob = _gather(np.append(found.data, np.uint8(32)), found.start[which], n, ends)
        blob[ends[1:] - 1] = 32
        out, plain, cut, runs_of, marks = [], _PLAIN.match, _RUNS.findall, self._run, self._marks
        for chunk in blob.tobytes().decode().split(" ")[:-1]:
            if not plain(chunk) or (not marks.isdisjoint(chunk) and self._special.search(chunk)):
                out.append(tuple(self.tokenizer.encode(chunk, add_special_tokens=False).ids))
                continue
            low = chunk.lower()
            got = self._runs.get(low) if low.isalpha() else None
            if got is None:
                got = ()
                for run in cut(low):
                    got += self._runs.get(run) or runs_of(run)
            out.append(got)
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(size.sum())), size

    def _rows(self, found: words.Words) -> tuple[Chunks, np.ndarray]:
        """A table, and each word's place in it; unknown words are encoded once."""
        eight = words.eights(found.data)
        place = self._young.find(found, eight)
        missing = np.flatnonzero(place < 0)
        if not len(missing):
            return self._young, place
        new, first, back = np.unique(found.hash[missing], return_index=True, return_inverse=True)
        if self._young.used + len(new) > CHUNKS:
            self._young, self._old = Chunks(max(CHUNKS, len(new))), self._young
            if len(missing) < len(place):  # the new young table takes all that this slice has
                return self._rows(found)
        chosen = missing[first]
        known = self._old.find(found, eight, chosen)
        moved = known >= 0
        self._young.add(found, chosen[moved], *self._old.ids(known[moved]))
        self._young.add(found, chosen[~moved], *self._encoded(found, chosen[~moved]))
        place[missing] = self._young.find(found, eight, missing)
        for k in np.flatnonzero(place < 0).tolist():  # two chunks of one hash: the second is kept outside the table
            place[k] = self._young.append(found, np.array([k]), *self._encoded(found, np.array([k])))[0]
        return self._young, place

    def encode(self, texts: pa.Array):
        """Yields (first row, ids, ends): a slice's ids in one array and each row's end in it."""
        for at, part in words.slices(texts, SLICE_BYTES):
            if not self.chunked:
                found = [
                    np.asarray(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                    for t in part.to_pylist()
                ]
                yield at, np.concatenate(found), np.cumsum([len(f) for f in found], dtype=np.int64)
                continue
            cut = words.Words(part, words.SPACE, False)
            table, place = self._rows(cut)
            n = table.size[place].astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(n)])
            yield at, _gather(table.flat, table.start[place], n, ends), ends[cut.row_end]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; the ids themselves are not laid out."""
        out = [np.zeros(0, np.int64)]
        for _, part in words.slices(texts, SLICE_BYTES):
            if self.chunked:
                cut = words.Words(part, words.SPACE, False)
                table, place = self._rows(cut)
                total = np.concatenate([[0], np.cumsum(table.size[place], dtype=np.int64)])
                out.append(np.diff(total[cut.row_end], prepend=0))
            else:
                out.append(np.array([len(self.tokenizer.encode(t, add_special_tokens=False).ids) for t in part.to_pylist()], np.int64))
        return np.concatenate(out)


def _gather(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The ranges [starts, starts + n) of ``flat`` one after another."""
    where = np.repeat((starts - ends[:-1]).astype(np.int64), n)
    where += np.arange(ends[-1])
    return flat[where]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of a tokenizer file: the same name with other content is another tokenizer."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()

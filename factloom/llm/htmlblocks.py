"""Pages cut into leaf blocks with their tag paths, and the features of block sequences."""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa

from . import words

#: A tag, comment or declaration. Quotes delimit only right after ``=``; a ``<`` before anything else is text.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S
)
#: Elements whose content is no text. The content of the raw ones runs to the page's end where the end tag is
#: missing, as in browsers; the tag of the others alone is skipped then, and a self-closed one is empty.
_RAW = frozenset("script style".split())
_HIDDEN = frozenset("template noscript svg iframe title object math textarea".split())
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW | _HIDDEN}
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: Tags inside which text runs on; every other tag ends a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that an opening tag closes first, within the nearest of the tags that hold them.
_CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_HOLDERS = frozenset("ul ol dl table div section article main aside nav header footer body form blockquote td th".split())
_ENDS_P = frozenset("p div ul ol dl table section article main aside nav header footer form blockquote pre h1 h2 h3 h4 h5 h6 hr address figure".split())

PATH, LEAF, WORD, NUMBERS = 128, 32, 32, 8
FEATURES = PATH + LEAF + WORD + NUMBERS
#: Tag paths whose vectors a worker keeps.
PATHS = 50_000
_paths: dict[tuple[str, ...], np.ndarray] = {}


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path, text, characters inside links) of each non-empty block in page order."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = []  # tag, path element
    parts: list[str] = []
    linked, link = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tuple(e for t, e in stack if t not in INLINE), text, linked))
        parts.clear()
        linked = 0

    def close(tags: str) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags.split():
                flush()
                del stack[k:]
                return
            if stack[k][0] in _HOLDERS:
                return

    at, search, unclosed = 0, _TOKEN.search, set()
    while m := search(page, at):
        if m.start() > at:
            text = html.unescape(page[at : m.start()])
            parts.append(text)
            linked += len(text) if link else 0
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "head":  # its content decides: what is no title, style or script there is text
            continue
        if tag in _ENDS and not m[1]:
            if (tag in _RAW or not m[3].endswith("/")) and tag not in unclosed:
                end = _ENDS[tag].search(page, at)
                if end is None:
                    unclosed.add(tag)
                    at = len(page) if tag in _RAW else at
                else:
                    at = end.end()
            continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            names = [t for t, _ in stack]
            if tag in names:
                if tag not in INLINE:
                    flush()
                k = len(names) - 1 - names[::-1].index(tag)
                if tag not in INLINE:
                    link = 0
                    del stack[k:]
                elif not any(t not in INLINE for t in names[k:]):
                    del stack[k]
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            if tag in _ENDS_P:
                close("p")
            if tag in _CLOSES:
                close(_CLOSES[tag])
            flush()
        if tag == "a":
            link += 1
        if tag not in _VOID and not m[3].endswith("/"):
            own = " ".join(x for g in _NAMED.findall(m[3]) for x in _NAME.findall("".join(g).lower()))
            stack.append((tag, f"{tag} {own}" if own else tag))
    if at < len(page):
        text = html.unescape(page[at:])
        parts.append(text)
        linked += len(text) if link else 0
    flush()
    return out


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH + LEAF, np.float32)
        for element in path:
            tag, *names = element.split()
            for name in (tag, *("." + x for x in names)):
                found[zlib.crc32(name.encode()) % PATH] = 1
        if path:
            found[PATH + zlib.crc32(path[-1].split()[0].encode()) % LEAF] = 1
        if len(_paths) >= PATHS:
            _paths.clear()
        _paths[path] = found
    return found


def features(pages: list[list[tuple[tuple[str, ...], str, int]]], first: int = 0, whole: int = 0) -> np.ndarray:
    """A row for each block of the pages, one page after another; or of one page's part that begins at
    block ``first`` of ``whole``."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), FEATURES), np.float32)
    if not flat:
        return x
    x[:, : PATH + LEAF] = [_path_vector(p) for p, _, _ in flat]
    base = 0
    for _, part in words.slices(pa.array([t for _, t, _ in flat], pa.large_string())):
        w = words.Words(part, words.NOT_ALNUM, True)
        slot = w.rows() * WORD + (w.hash % np.uint64(WORD)).astype(np.int64)
        bag = np.bincount(slot, minlength=len(part) * WORD).reshape(len(part), WORD).astype(np.float32)
        x[base : base + len(part), PATH + LEAF : PATH + LEAF + WORD] = bag / np.maximum(np.linalg.norm(bag, axis=1, keepdims=True), 1)
        x[base : base + len(part), -NUMBERS] = np.log1p(w.counts()) / 6
        base += len(part)
    k = -NUMBERS + 1
    x[:, k] = [n / len(t) for _, t, n in flat]
    x[:, k + 1] = [t[-1] in ".!?…" for _, t, _ in flat]
    x[:, k + 2] = ["©" in t or "·" in t for _, t, _ in flat]
    x[:, k + 3] = np.log1p([len(t) for _, t, _ in flat]) / 8
    x[:, k + 4] = [len(p) / 10 for p, _, _ in flat]
    sizes = np.array([len(p) for p in pages])
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first
    x[:, k + 5] = place / np.maximum(np.repeat(sizes, sizes) if not whole else whole, 1)
    x[:, k + 6] = 1
    return x

"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks; tag-path and hashed-word vectors of the whole sequence go through a
bidirectional LSTM, so each block's label depends on the document around it. The kept blocks are
joined by a newline. The weights were trained by ``htmltrain`` and are shipped with the package.

Defined cases: null html is empty; a page without kept blocks gives the empty text; pages may be
truncated or badly nested, and very long; repeated rows and null ids are kept; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bilstm, htmlblocks

#: Blocks that go through the network together at most, padding included; a page of more goes in parts, states carried.
TOGETHER = 60_000
_weights: dict[str, np.ndarray] = {}


def weights() -> dict[str, np.ndarray]:
    """The trained weights, also from a zipped package."""
    if not _weights:
        with np.load(io.BytesIO(pkgutil.get_data(__package__, "block_labeller.npz"))) as z:
            _weights.update({k: z[k].astype(np.float32) for k in z.files})
    return _weights


def main_texts(pages: list[str], w: dict[str, np.ndarray] | None = None) -> list[str]:
    """Main text of each page."""
    w = w or weights()
    cut = [htmlblocks.blocks(p) for p in pages]
    order = sorted((k for k in range(len(pages)) if cut[k]), key=lambda k: len(cut[k]))
    out = [""] * len(pages)
    at = 0
    while at < len(order):
        k = order[at]
        if len(cut[k]) > TOGETHER:
            p = bilstm.forward_long(w, lambda a, b, own=cut[k]: htmlblocks.features([own[a:b]], a, len(own)), len(cut[k]), TOGETHER)
            out[k] = "\n".join(t for (_, t, _), q in zip(cut[k], p.tolist(), strict=True) if q > 0.5)
            at += 1
            continue
        stop = at + 1
        while stop < len(order) and len(cut[order[stop]]) * (stop + 1 - at) <= TOGETHER and stop - at < 512:
            stop += 1
        own = [cut[k] for k in order[at:stop]]
        x, mask = bilstm.pad(htmlblocks.features(own), [len(b) for b in own])
        p = bilstm.forward(w, x, mask)
        for j, k in enumerate(order[at:stop]):
            out[k] = "\n".join(t for (_, t, _), q in zip(cut[k], p[:, j].tolist(), strict=False) if q > 0.5)
        at = stop
    return out


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                texts = main_texts([h or "" for h in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

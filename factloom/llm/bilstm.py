"""A bidirectional LSTM with a logistic output for each step, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def new(features: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Fresh weights; gates stand as input, forget, output, candidate."""
    w: dict[str, np.ndarray] = {}
    for side in "fb":
        w[f"x{side}"] = rng.normal(0, 0.15, (features, 4 * hidden)).astype(np.float32)
        w[f"h{side}"] = rng.normal(0, 0.2, (hidden, 4 * hidden)).astype(np.float32)
        w[f"c{side}"] = np.zeros(4 * hidden, np.float32)
        w[f"c{side}"][hidden : 2 * hidden] = 1
    w["out"] = rng.normal(0, 0.2, (2 * hidden + features, 1)).astype(np.float32)
    w["bias"] = np.zeros(1, np.float32)
    return w


def _run(w: dict, side: str, x: np.ndarray, mask: np.ndarray, keep: list | None, state: list | None = None) -> np.ndarray:
    """Hidden states of one direction; x is steps x pages x features. ``state`` goes in and out where given."""
    steps, pages, _ = x.shape
    hidden = w[f"h{side}"].shape[0]
    given = x @ w[f"x{side}"] + w[f"c{side}"]
    h, c = state or (np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32))
    out = np.zeros((steps, pages, hidden), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        z = given[t] + h @ w[f"h{side}"]
        gate = _sigmoid(z[:, : 3 * hidden])
        i, f, o = np.split(gate, 3, axis=1)
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, m))
        h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
        out[t] = h
    if state is not None:
        state[:] = h, c
    return out


def forward_long(w: dict, part, steps: int, at_once: int) -> np.ndarray:
    """Probability of each step of one long page, whose features ``part(a, b)`` gives for steps a to b.

    Only ``at_once`` steps are held at a time; between parts the states of each direction are carried, so the result is that of
    the whole page.
    """
    cuts = [(a, min(a + at_once, steps)) for a in range(0, steps, at_once)]
    hidden, ahead, out = w["hf"].shape[0], [], np.zeros(steps, np.float32)
    back = np.zeros((steps, hidden), np.float32)
    state: list = []
    for a, b in reversed(cuts):
        back[a:b] = _run(w, "b", part(a, b)[:, None], np.ones((b - a, 1), np.float32), None, state)[:, 0]
    state = ahead
    for a, b in cuts:
        x = part(a, b)
        own = _run(w, "f", x[:, None], np.ones((b - a, 1), np.float32), None, state)[:, 0]
        out[a:b] = _sigmoid(np.concatenate([own, back[a:b], x], axis=1) @ w["out"] + w["bias"])[:, 0]
    return out


def forward(w: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Probability of each step of each page."""
    kept = {"f": [], "b": []}
    both = np.concatenate([_run(w, s, x, mask, kept[s] if keep is not None else None) for s in "fb"] + [x], axis=2)
    if keep is not None:
        keep |= kept | {"both": both}
    return _sigmoid(both @ w["out"] + w["bias"])[:, :, 0]


def gradients(w: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean log loss over the steps and its gradients."""
    keep: dict = {}
    p = forward(w, x, mask, keep)
    n = max(1.0, float(mask.sum()))
    loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum()) / n
    d = ((p - y) * mask / n)[:, :, None]
    grad = {k: np.zeros_like(v) for k, v in w.items()}
    grad["out"] = np.einsum("tpk,tpo->ko", keep["both"], d)
    grad["bias"] = d.sum(axis=(0, 1))
    hidden = w["hf"].shape[0]
    back = d @ w["out"].T
    for side, own in (("f", back[:, :, :hidden]), ("b", back[:, :, hidden : 2 * hidden])):
        dh, dc = np.zeros_like(own[0]), np.zeros_like(own[0])
        for t, h, c, i, f, o, g, tc, m in reversed(keep[side]):
            dh = dh + own[t]
            do, dcn = m * dh * tc, m * (dh * o * (1 - tc**2) + dc)
            dz = np.concatenate([dcn * g * i * (1 - i), dcn * c * f * (1 - f), do * o * (1 - o), dcn * i * (1 - g**2)], axis=1)
            grad[f"x{side}"] += x[t].T @ dz
            grad[f"h{side}"] += h.T @ dz
            grad[f"c{side}"] += dz.sum(axis=0)
            dh, dc = (1 - m) * dh + dz @ w[f"h{side}"].T, (1 - m) * dc + dcn * f
    return loss, grad


def pad(rows: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pages of consecutive rows as steps x pages x features, and where steps exist."""
    steps = max(sizes)
    x = np.zeros((steps, len(sizes), rows.shape[1]), np.float32)
    mask = np.zeros((steps, len(sizes)), np.float32)
    at = 0
    for k, n in enumerate(sizes):
        x[:n, k], mask[:n, k] = rows[at : at + n], 1
        at += n
    return x, mask

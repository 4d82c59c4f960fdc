"""Trains the block labeller on pages written by a grammar of site layouts.

``python -m factloom.llm.htmltrain`` writes the weights beside this file. Layouts vary containers,
class names, the parts around the article and how the article is marked up.
"""

from __future__ import annotations

import os
import random

import numpy as np

from . import bilstm, htmlblocks

HIDDEN, STEPS, BATCH = 12, 420, 48
MARK = "\x01"  # begins the text of a block that belongs to the article

_SYLLABLES = "th er in on an re ed ou en ti es or st ar te al ch le ung ver eau ción as do qu ä é".split()
_BOILER = "home about contact login search share reply menu subscribe privacy terms cookies rights reserved follow".split()


def _words(r: random.Random, low: int, high: int) -> str:
    out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    return " ".join(out).capitalize()


def _sentence(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.15:
        return _words(r, 1, 3) + "."
    text = ". ".join(_words(r, 3, 25) for _ in range(r.randint(1, 6))) + "."
    return text if kind < 0.9 else " ".join(w + r.choice(["***", "###", "!!", " |", "&amp;"]) for w in text.split())


def _named(r: random.Random, tag: str, names: list[str]) -> str:
    kind = r.random()
    name = r.choice(names)
    return f"<{tag}>" if kind < 0.1 else f'<{tag} class="{name}">' if kind < 0.6 else f'<{tag} id="{name}">' if kind < 0.8 else f'<{tag} class="{name} {r.choice(["clearfix", "box", "col", "wrap"])}">'


def _links(r: random.Random, n: int) -> str:
    names = [r.choice(_BOILER).capitalize() if r.random() < 0.3 else _words(r, 1, 2) for _ in range(n)]
    return "<ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(names)) + "</ul>"


def _menu(r):
    return r.choice(["<nav>", '<nav class="main-nav">', '<div class="menu">', '<div id="navigation">', '<div class="navbar">', '<div class="breadcrumbs">']) , _links(r, r.randint(2, 8))


def _around(r: random.Random) -> str:
    """One part that is not the article."""
    kind = r.choice(["menu", "ad", "ad", "side", "notice", "form", "header", "related", "social"])
    if kind == "menu":
        opening, body = _menu(r)
    elif kind == "ad":
        opening = _named(r, "div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad"])
        opening = '<div class="ad">' if opening == "<div>" else opening
        body = _sentence(r) if r.random() < 0.7 else f"<p>{_sentence(r)}</p>"
    elif kind == "side":
        opening = r.choice(["<aside>", '<aside class="sidebar">', '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">'])
        body = f"<h3>{_words(r, 1, 4)}</h3>" + (_links(r, r.randint(2, 6)) if r.random() < 0.5 else f"<p>{_sentence(r)}</p>")
    elif kind == "notice":
        opening = r.choice(['<div class="cookie-notice">', '<div class="notice">', '<div id="cookie-banner">', '<div class="alert">', '<div class="consent" role="dialog">', '<div class="newsletter">'])
        body = f"<p>{_sentence(r)}</p><button>OK</button>"
    elif kind == "form":
        opening = r.choice(["<form>", '<form action="/s" class="search">', '<form id="login">'])
        body = f'<label>{_words(r, 1, 3)}</label><input name="q"><p>{_words(r, 2, 8)}</p><select><option>{_words(r, 1, 2)}<option>{_words(r, 1, 2)}</select><button>{_words(r, 1, 2)}</button>'
    elif kind == "header":
        opening = r.choice(["<header>", '<header class="site-header">', '<div class="header">', '<div id="masthead">'])
        body = r.choice([f"<h1>{_words(r, 1, 3)}</h1><p>{_words(r, 3, 8)}</p>", f"<div>{_words(r, 1, 4)}</div>", f"<h2>{_words(r, 1, 4)}</h2>"])
    elif kind == "related":
        opening = r.choice(['<div class="related">', '<section class="related-posts">', '<div class="recommended">'])
        body = f"<h3>{_words(r, 1, 3)}</h3>" + _links(r, r.randint(2, 5))
    else:
        opening, body = r.choice(['<div class="share">', '<div class="social">', '<div class="tags">']), _links(r, r.randint(2, 4))
    return opening + body + f"</{opening[1:].split()[0].rstrip('>')}>"


def _comments(r: random.Random) -> str:
    n = r.randint(1, 5)
    style = r.random()
    if style < 0.4:
        return f'<section class="{r.choice(["comments", "comment-list", "discussion"])}"><h3>{_words(r, 1, 3)}</h3>' + "".join(f'<div class="comment"><b>{_words(r, 1, 2)}</b><p>{_sentence(r)}</p></div>' for _ in range(n)) + "</section>"
    if style < 0.7:
        return f'<div id="comments"><h2>{n} comments</h2><ol>' + "".join(f'<li class="comment"><p>{_sentence(r)}</p><a href="#">Reply</a></li>' for _ in range(n)) + "</ol></div>"
    return '<div class="comments">' + "".join(f'<article class="comment"><header>{_words(r, 1, 2)}</header><p>{_sentence(r)}</p></article>' for _ in range(n)) + "</div>"


def _footer(r: random.Random) -> str:
    opening = r.choice(["<footer>", "<footer>", '<footer class="site-footer">', '<div class="footer">', '<div id="footer">'])
    body = r.choice([f"&copy; {_words(r, 1, 2)} &middot; {_sentence(r)}", f"<p>&copy; 2020 {_words(r, 1, 4)}</p>" + _links(r, 3), _links(r, r.randint(2, 6)) + f"<p>{_sentence(r)}</p>"])
    return opening + body + f"</{opening[1:].split()[0].rstrip('>')}>"


def _paragraph(r: random.Random) -> str:
    text = MARK + _sentence(r)
    if r.random() < 0.15:
        w = text.split(" ")
        w[len(w) // 2] = f'<a href="/x">{w[len(w) // 2] if len(w) > 1 else "x"}</a>'
        text = " ".join(w) if len(w) > 1 else text
    if r.random() < 0.1:
        text = text.replace(MARK, MARK + "<em>", 1) + "</em>"
    kind = r.random()
    if kind < 0.06:
        return "<ul>" + "".join(f"<li>{MARK}{_words(r, 1, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
    if kind < 0.1:
        return f"<blockquote><p>{text}</p></blockquote>"
    if kind < 0.14:
        return f"<h2>{MARK}{_words(r, 1, 7)}</h2>"
    if kind < 0.16:
        return f"<pre>{text}</pre>"
    if kind < 0.18:
        return f"<figure><img src=x><figcaption>{MARK}{_words(r, 2, 9)}</figcaption></figure>"
    if kind < 0.2:
        return "<table>" + "".join(f"<tr><td>{MARK}{_words(r, 1, 3)}</td><td>{MARK}{_words(r, 1, 3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
    if kind < 0.24:
        return f"<div>{text}</div>"
    return f"<p>{text}" + ("</p>" if r.random() < 0.85 else "")


def page(r: random.Random) -> str:
    """One page; the article's blocks begin with MARK."""
    opening = r.choice(["<article>"] * 6 + ["<main>", "<main><article>", '<div class="content">', '<div id="content">', '<div class="post">', '<article class="post">', '<section class="entry-content">', '<div class="article-body">', '<div role="main">'])
    tags = [t.split()[0].rstrip(">") for t in opening.split("<")[1:]]
    body = [f"<h1>{MARK}{_words(r, 1, 10)}</h1>"] if r.random() < 0.85 else []
    if r.random() < 0.5:
        body.append(f"<p><b>{MARK}{_sentence(r)}<br>")
    for _ in range(int(r.expovariate(0.14)) + (r.random() < 0.9)):
        body.append(_paragraph(r))
        if r.random() < 0.05:
            body.append(_around(r))
    article = opening + "".join(body) + "".join(f"</{t}>" for t in reversed(tags))
    before = [_around(r) for _ in range(r.randint(0, 3))]
    after = [_around(r) for _ in range(r.choice([0, 0, 1, 2]))] + ([_comments(r)] if r.random() < 0.3 else [])
    parts = before + [article] + after + ([_footer(r)] if r.random() < 0.85 else [])
    if r.random() < 0.3:
        parts.insert(0, "<nav>" + _links(r, r.randint(3, 8)) + "</nav>")
    middle = "".join(parts)
    if r.random() < 0.25:
        middle = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(r, 1, 6)}</title><style>p{{}}</style></head><body>{middle}</body></html>"


def batch(r: random.Random, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = []
    while len(found) < n:
        b = htmlblocks.blocks(page(r))
        if b:
            found.append(b)
    labels = [[MARK in t for _, t, _ in b] for b in found]
    plain = [[(p, t.replace(MARK, "") or "x", k) for p, t, k in b] for b in found]
    x, mask = bilstm.pad(htmlblocks.features(plain), [len(b) for b in plain])
    y = np.zeros(mask.shape, np.float32)
    for k, own in enumerate(labels):
        y[: len(own), k] = own
    return x, mask, y


def train(seed: int = 7, steps: int = STEPS) -> dict[str, np.ndarray]:
    r, w = random.Random(seed), bilstm.new(htmlblocks.FEATURES, HIDDEN, np.random.default_rng(seed))
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        x, mask, y = batch(r, BATCH)
        loss, grad = bilstm.gradients(w, x, mask, y)
        rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        if step % 60 == 0:
            print(step, round(loss, 4), flush=True)
    return w


if __name__ == "__main__":
    trained = train()
    np.savez_compressed(os.path.join(os.path.dirname(__file__), "block_labeller.npz"), **{k: x.astype(np.float16) for k, x in trained.items()})
    x, mask, y = batch(random.Random(99), 300)
    p = bilstm.forward(trained, x, mask) > 0.5
    print("held-out block accuracy", float(((p == (y > 0.5)) * mask).sum() / mask.sum()), "pages right", float(((p == (y > 0.5)) | (mask == 0)).all(axis=0).mean()))

"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import json
import math
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.rows import early_by_hash

#: Pages from whose own marks the field is fitted, at most, and pages that are set anew from their texts.
LABELLED_PAGES = 300
LAYOUTS = 300
#: Of such a page, at most so many blocks in a row, characters of a text, features of a block and characters of a
#: feature: labels are learned from bounded rows. Other pages, and all that is extracted, are taken whole.
RUN_BLOCKS, RUN_CHARS, RUN_FEATURES, FEATURE_CHARS = 128, 1100, 64, 40
EPOCHS = 120

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of which nothing is text of the page.
SILENT = "script|style|noscript|template|svg|iframe|object|textarea|select|title|math|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SILENT})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^<>]*>|([^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SMALL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    features: tuple[str, ...]


def _marks(tag: str, attributes: str) -> tuple[str, ...]:
    """Features that an element gives to all blocks below it."""
    found = [f"in={tag}"]
    if attributes:
        for values in _NAMES.findall(attributes):
            for part in _PART.findall(_SMALL.sub(" ", "".join(values)).lower()):
                found.append(f"name={part.rstrip('s')}")
    return tuple(found)


def _text_features(text: str, linked: int, tag: str) -> list[str]:
    n = len(text)
    share = min(int(4 * linked / n), 3)
    end = "stop" if text[-1] in ".!?…。！？" else "mark" if not text[-1].isalnum() else "word"
    return [f"tag={tag}", f"length={min(int(math.log2(n)), 10)}", f"links={share}", f"end={end}", f"commas={min(text.count(','), 3)}"] + (["sign=©"] if "©" in text else [])


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order: text between the ends of block elements, character references decoded, white space
    turned into single spaces, blank ones left out. Elements that are never closed end with what holds them."""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked, in_link
        text = "".join(parts)
        parts.clear()
        if text and not text.isspace():
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                marks = dict.fromkeys(m for _, own in stack for m in own)
                found.append(Block(text, (*_text_features(text, min(linked, len(text)), stack[-1][0] if stack else "body"), *marks)))
        linked, in_link = 0, False

    for token in _TOKEN.finditer(page or ""):
        text = token.group(5)
        if text is not None:
            parts.append(text)
            if in_link:
                linked += len(text)
            continue
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not token.group(2)
            elif tag in ("br", "img", "wbr"):
                parts.append(" ")
            continue
        flush()
        if token.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag == "li" or re.fullmatch("h[1-6]", stack[-1][0])):
                stack.pop()
            if tag not in ("html", "body"):
                stack.append((tag, _marks(tag, token.group(4))))
    flush()
    return found


class Field(NamedTuple):
    """Log-linear weights: `state` by feature for text of the article against the rest, and of neighbouring pairs."""

    state: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    start: float


def decode(field: Field, page: list[Block]) -> list[bool]:
    """The most probable labels of all blocks together (Viterbi); of equal paths the one with fewer blocks."""
    if not page:
        return []
    weight = field.state.get
    (t00, t01), (t10, t11) = field.step
    back = []
    a, b = 0.0, field.start + sum(weight(f, 0.0) for f in page[0].features)
    for block in page[1:]:
        own = sum(weight(f, 0.0) for f in block.features)
        from0, from1 = b + t10 > a + t00, b + t11 > a + t01
        a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + own
        back.append((from0, from1))
    label = b > a
    labels = [label]
    for from0, from1 in reversed(back):
        label = from1 if label else from0
        labels.append(label)
    return labels[::-1]


def fit(pages: list[list[Block]], labels: list[list[bool]], epochs: int = EPOCHS, decay: float = 1e-3, drop: float = 0.3, seed: int = 5) -> Field:
    """Maximum likelihood by Adam: marginals of all pages at once by the forward and backward recursions. In each epoch
    every feature of the elements around is hidden from a page with probability `drop`, so that no single mark, such
    as an `article` element, is all that counts."""
    pairs = [(p, y) for p, y in zip(pages, labels) if p]
    if not pairs:
        return Field({}, ((0.0, 0.0), (0.0, 0.0)), 0.0)
    names = {f: k for k, f in enumerate(sorted({f for p, _ in pairs for b in p for f in b.features}))}
    around = np.array([f.startswith(("in=", "name=")) for f in names])
    n, longest = len(pairs), max(len(p) for p, _ in pairs)
    alive = np.zeros((longest, n), bool)
    gold = np.zeros((longest, n))
    where, which = [], []
    for j, (p, y) in enumerate(pairs):
        for i, b in enumerate(p):
            alive[i, j], gold[i, j] = True, y[i]
            which += [names[f] for f in b.features]
            where += [i * n + j] * len(b.features)
    where, which = np.array(where), np.array(which)
    page_of = where % n
    rng = np.random.default_rng(seed)
    w, t, s = np.zeros(len(names)), np.zeros((2, 2)), np.zeros(1)
    moment = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, t, s)]
    both = alive[1:]
    seen = np.stack([np.stack([((gold[:-1] == a) & (gold[1:] == b) & both).sum() for b in (0, 1)]) for a in (0, 1)])
    for step in range(1, epochs + 1):
        shown = ~(around[which] & (rng.random((n, len(names))) < drop)[page_of, which])
        e = np.zeros((longest, n, 2))
        e[..., 1] = np.bincount(where[shown], w[which[shown]], longest * n).reshape(longest, n)
        e[0, :, 1] += s
        forward, backward = e.copy(), np.zeros_like(e)
        for i in range(1, longest):
            forward[i] = np.where(both[i - 1][:, None], e[i] + np.logaddexp(forward[i - 1][:, :1] + t[0], forward[i - 1][:, 1:] + t[1]), forward[i - 1])
        for i in range(longest - 2, -1, -1):
            ahead = e[i + 1] + backward[i + 1]
            backward[i] = np.where(both[i][:, None], np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1]), 0)
        total = np.logaddexp(forward[-1][:, 0], forward[-1][:, 1])
        p1 = np.where(alive, np.exp(forward[..., 1] + backward[..., 1] - total), 0)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                expected[a, b] = np.where(both, np.exp(forward[:-1, :, a] + t[a, b] + e[1:, :, b] + backward[1:, :, b] - total), 0).sum()
        off = (p1 - gold).ravel()
        grads = (np.bincount(which[shown], off[where[shown]], len(names)) / n + decay * w, (expected - seen) / n + decay * t, np.array([(p1[0] - gold[0]).sum() / n]))
        for x, g, (m, v) in zip((w, t, s), grads, moment):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: float(w[k]) for f, k in names.items()}, ((float(t[0, 0]), float(t[0, 1])), (float(t[1, 0]), float(t[1, 1]))), float(s[0]))


_OUTSIDE = {f"in={t}" for t in ("nav", "header", "footer", "aside", "form")} | {f"name={n}" for n in ("comment", "ad", "share", "related")}


def own_labels(page: list[Block]) -> list[bool] | None:
    """Labels of a page whose author marked the article by an element of that name (or `main`); None without one."""
    labels = [bool({"in=article", "in=main"} & set(b.features)) and not _OUTSIDE & set(b.features) for b in page]
    return labels if any(labels) else None


# Names that sites give to the parts of a page. The first of each pair are elements.
_PARTS = {
    "header": (["header", "div"], ["header", "masthead", "top", "site-header", "branding", "topbar"]),
    "nav": (["nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumbs", "main-menu", "toc"]),
    "notice": (["div", "section", "aside"], ["cookie", "cookie-notice", "consent", "notice", "alert", "popup", "modal", "newsletter", "banner", "gdpr", "paywall"]),
    "ad": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "ad-banner"]),
    "side": (["aside", "div"], ["sidebar", "related", "widget", "recommended", "trending", "side", "more", "popular", "links"]),
    "share": (["div", "ul"], ["share", "social", "share-buttons", "tags", "follow"]),
    "comments": (["div", "section", "ol"], ["comments", "comment-list", "replies", "discussion", "responses", "reader-comments", "disqus"]),
    "footer": (["footer", "div"], ["footer", "site-footer", "bottom", "copyright", "colophon", "legal"]),
    "main": (["article", "main", "div", "section"], ["content", "post", "entry", "story", "article", "body", "text", "page", "post-content", "entry-content", "article-body", "main"]),
}


def layout(rng: random.Random, texts: list[str]) -> tuple[list[Block], list[bool]]:
    """A page set anew from given texts, with the labels of its blocks."""
    texts = rng.sample(texts, min(len(texts), 40))
    long = [t for t in texts if len(t) > 80] or texts
    own: set[str] = set()

    def part(kind: str, inner: str) -> str:
        tags, names = _PARTS[kind]
        tag = rng.choice(tags)
        plain = tag not in ("div", "ul", "ol", "section")
        mark = "" if plain and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}"'
        return f"<{tag}{mark}>{inner}</{tag}>"

    def short(most: int = 6) -> str:
        words = rng.choice(texts).split()
        at = rng.randrange(max(len(words) - most, 1))
        return html.escape(" ".join(words[at : at + rng.randint(1, most)]))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{short(4)}</a></li>' for _ in range(n)) + "</ul>"

    def said(most: int = 25) -> str:
        return f"<p>{short(most)}.</p>" if rng.random() < 0.6 else short(most)

    def mine(tag: str, text: str) -> str:
        own.add(" ".join(text.split()))
        return f"<{tag}>{html.escape(text)}</{tag}>"

    body = [mine("h1", short(9))] if rng.random() < 0.8 else []
    for text in rng.sample(long, min(len(long), rng.randint(1, 8))):
        body.append(mine(rng.choice(["p", "p", "p", "p", "blockquote", "div", "pre"]), text))
        if rng.random() < 0.2:
            body.append(mine("h2", short(7)))
        if rng.random() < 0.15:
            body.append("<ul>" + "".join(mine("li", short(15)) for _ in range(3)) + "</ul>")
        if rng.random() < 0.15:
            body.append(part("ad", said()))
    used = "".join(body)
    rest = [t for t in long if html.escape(t) not in used]
    replies = part("comments", "".join(f'<div class="comment"><p>{html.escape(t)}</p></div>' for t in rest[: rng.randint(1, 4)])) if rest else ""
    tail = [part("share", links(3))] if rng.random() < 0.4 else []
    inside = rng.random() < 0.3
    page = [
        part("header", short(5) + (links(3) if rng.random() < 0.4 else "")) if rng.random() < 0.7 else "",
        part("nav", links(rng.randint(2, 8))) if rng.random() < 0.9 else "",
        part("notice", said() + "<button>OK</button>") if rng.random() < 0.5 else "",
        part("ad", said()) if rng.random() < 0.6 else "",
        part("side", links(3)) if rng.random() < 0.2 else "",
        part("main", "".join(body + tail) + (replies if inside else "")),
        part("side", links(4) + said()) if rng.random() < 0.5 else "",
        f"<form><label>{short(4)}</label><p>{short(12)}</p><input><button>{short(2)}</button></form>" if rng.random() < 0.5 else "",
        "" if inside else replies,
        part("footer", "&copy; " + short(6) + ("" if rng.random() < 0.5 else links(3))) if rng.random() < 0.9 else "",
    ]
    found = blocks("<html><body>" + "".join(page) + "</body></html>")
    outside = {f"name={n.rstrip('s')}" for kind in ("ad", "share", "comments") for name in _PARTS[kind][1] for n in _PART.findall(name)}
    return found, [b.text in own and not outside & set(b.features) for b in found]


def labelled_run(page: str) -> tuple[list[Block], list[bool] | None]:
    """Of a page, the run of blocks that is learned from, and its labels if the page has some: all blocks of a page of
    common length, else those around the article's beginning."""
    found = blocks(page)
    labels = own_labels(found)
    first = max((labels.index(True) if labels else 0) - RUN_BLOCKS // 2, 0)
    first = max(min(first, len(found) - RUN_BLOCKS), 0)
    run = [Block(b.text[:RUN_CHARS], tuple(f for f in b.features if len(f) <= FEATURE_CHARS)[:RUN_FEATURES]) for b in found[first : first + RUN_BLOCKS]]
    return run, labels and labels[first : first + RUN_BLOCKS]


def train(pages: DataFrame, html_col: str = "html", labelled: int = LABELLED_PAGES, layouts: int = LAYOUTS, seed: int = 5) -> Field:
    """Fits the field on at most `labelled` pages, those that come first by a hash: their authors' own marks are
    the labels. As many texts of these pages are set into `layouts` further pages whose labels are known, with the
    names that sites use for their parts. A table without pages gives a field that takes nothing.

    Pages are read in tasks, which hand on a bounded run of blocks each, so what comes to the driver is at most
    `labelled` times some 400 KB, however long the pages are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = pa.array([json.dumps(labelled_run(page)) for page in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("h"), runs], ["h", "run"])

    rows = pages.where(F.length(html_col) > 0).select(F.col(html_col).alias("html"))
    early = early_by_hash(rows, labelled, "html").select(F.xxhash64("html").alias("h"), "html")
    some = [json.loads(r.run) for r in early.mapInArrow(run, "h long, run string").orderBy("h", "run").limit(labelled).collect()]
    parsed = [([Block(text, tuple(features)) for text, features in found], labels) for found, labels in some]
    marked = [(p, y) for p, y in parsed if y]
    texts = sorted({b.text for p, _ in parsed for b in p})
    rng = random.Random(seed)
    made = [layout(rng, texts) for _ in range(layouts if texts else 0)]
    return fit([p for p, _ in marked + made], [y for _, y in marked + made], seed=seed)


def main_text(pages: DataFrame, field: Field, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`(page_id, url, text, n_chars)` of every row: the blocks that the field takes for the article, in page order, joined
    by two line breaks. Null and empty pages have an empty text; repeated rows stay; other columns are not read."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page in batch.column("html").to_pylist():
                found = blocks(page)
                texts.append("\n\n".join(b.text for b, kept in zip(found, decode(field, found)) if kept))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), n], ["page_id", "url", "text", "n_chars"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

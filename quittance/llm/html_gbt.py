"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element and every text block of a page is a node with features of its
subtree (text, link and tag density), its attribute tokens and those above it, its
depth, its siblings and its place.  Boosted trees give the log-odds that the node
holds main text.  A dynamic program over the tree then picks the likeliest labelling
in which nothing below a rejected node is kept, so ancestors and descendants agree.

The trees are trained on TRAINING_PAGES pages that a seeded generator lays out with
known labels in many styles; no page of the corpus is needed for that, and the bound
does not depend on the corpus.  ``python -m quittance.llm.html_gbt`` trains them and
writes page_trees.json beside this file, which extract() reads.

Cases: null or empty html gives an empty text; pages without main text give an empty
text; a page without markup is one text block; repeated rows are extracted alike;
url may be null; extra columns are not read; nothing is dropped for length: time grows
with a page's length, however broken its markup; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm import boosting
from quittance.llm.html_tree import TEXT, Node, attribute_words, parse

TRAINING_PAGES = 800
TREES = Path(__file__).with_name("page_trees.json")

TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "ul", "h1", "h2", "h3", "table", "td", "blockquote", "figure", "button", "label", "select", "dialog", "body", TEXT)
#: Attribute tokens by what they tell.
TOKENS = {
    "content": r"content|article|post|entry|body|story|main|text",
    "menu": r"nav|menu|breadcrumb|tabs|toc|pagination|pager",
    "advert": r"\bad\b|\bads\b|advert|sponsor|promo|banner|teaser|\bad[-_]",
    "footer": r"foot|copyright|legal|bottom",
    "header": r"header|masthead|logo|topbar|site-title",
    "aside": r"side|related|recommend|widget|popular|trending|more",
    "comment": r"comment|discuss|disqus|repl(?:y|ies)|respond",
    "notice": r"cookie|notice|consent|popup|modal|gdpr|alert|overlay|banner",
    "form": r"form|login|signup|subscribe|newsletter|search",
    "share": r"share|social|follow|tweet|like",
    "meta": r"byline|author|meta|date|tags|category",
}
_TOKEN = {k: re.compile(v) for k, v in TOKENS.items()}
NAMES = (
    *(f"tag_{t}" for t in TAGS), *(f"parent_{t}" for t in TAGS), *(f"own_{k}" for k in TOKENS), *(f"above_{k}" for k in TOKENS),
    "above_nav", "above_header", "above_footer", "above_aside", "above_form", "above_article", "above_main",
    "depth", "chars", "link_density", "tags_per_char", "marks_per_char", "words_per_block", "longest_block",
    "siblings", "sibling_nth", "sibling_share", "page_share", "place", "place_from_end", "parent_chars", "same_tag_siblings",
)
ABOVE_TAGS = ("nav", "header", "footer", "aside", "form", "article", "main")


def _flags(attributes: str) -> tuple[int, ...]:
    return _short_flags(attributes) if len(attributes) < 1000 else _flags_of(attributes)


def _flags_of(attributes: str) -> tuple[int, ...]:
    words = attribute_words(attributes)
    return tuple(int(bool(words and r.search(words))) for r in _TOKEN.values())


_short_flags = lru_cache(maxsize=1 << 14)(_flags_of)


_TAG_AT = {t: k for k, t in enumerate(TAGS)}
_ABOVE_AT = {t: k for k, t in enumerate(ABOVE_TAGS)}


class Forest:
    """The nodes of some pages on one line, with parents, ends, depths and levels as arrays."""

    def __init__(self, pages: list[list[Node]]) -> None:
        self.nodes = [x for page in pages for x in page]
        size = np.array([len(p) for p in pages])
        self.first = np.concatenate([[0], np.cumsum(size)])
        base = np.repeat(self.first[:-1], size)
        n = len(self.nodes)
        self.root = base
        self.parent = np.fromiter((x.parent for x in self.nodes), np.int64, n) + base
        self.end = np.fromiter((x.end for x in self.nodes), np.int64, n) + base
        self.chars = np.fromiter((len(x.text) for x in self.nodes), float, n)
        depth = [0] * n
        for i, p in enumerate(self.parent.tolist()):
            if p != i:
                depth[i] = depth[p] + 1
        self.depth = np.array(depth, np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(self.depth))[:-1]) if n else []

    def subtree(self, v: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(v)])
        return total[self.end] - total[:-1]


def node_features(f: Forest) -> np.ndarray:
    """Features of all nodes of a forest, in order."""
    nodes, parent, chars, n = f.nodes, f.parent, f.chars, len(f.nodes)
    links = np.fromiter((x.links for x in nodes), float, n)
    marks = np.fromiter((sum(map(x.text.count, ".,;:!?")) if x.text else 0 for x in nodes), float, n)
    words = np.fromiter((x.text.count(" ") + 1 if x.text else 0 for x in nodes), float, n)
    none = (0,) * len(TOKENS)
    own = np.array([_flags(x.attributes) if x.attributes else none for x in nodes], np.int8).reshape(n, len(TOKENS))
    tag = np.fromiter((_TAG_AT.get(x.tag, -1) for x in nodes), np.int64, n)
    above_tag = np.fromiter((_ABOVE_AT.get(x.tag, -1) for x in nodes), np.int64, n)
    state = np.zeros((n, len(TOKENS) + len(ABOVE_TAGS)), np.int8)
    state[:, : len(TOKENS)] = own
    known = np.flatnonzero(above_tag >= 0)
    state[known, len(TOKENS) + above_tag[known]] = 1
    longest = chars.copy()
    for at in f.levels[1:]:
        state[at] |= state[parent[at]]
    for at in f.levels[:0:-1]:
        np.maximum.at(longest, parent[at], longest[at])
    above = state[parent]
    above[:, len(TOKENS) :] = state[:, len(TOKENS) :]
    text, link, mark, word, blocks = map(f.subtree, (chars, links, marks, words, (chars > 0).astype(float)))
    size = np.maximum(text, 1)
    child = np.flatnonzero(parent != np.arange(n))
    kids = np.bincount(parent[child], minlength=n)
    nth = np.zeros(n)
    order = child[np.argsort(parent[child], kind="stable")]
    if len(order):
        p = parent[order]
        new = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
        nth[order] = np.arange(len(p)) - np.repeat(new, np.diff(np.append(new, len(p))))
    _, back, alike = np.unique(parent * 64 + tag + 1, return_inverse=True, return_counts=True)
    onehot = np.zeros((n, len(TAGS)))
    hit = np.flatnonzero(tag >= 0)
    onehot[hit, tag[hit]] = 1
    passed = np.concatenate([[0.0], np.cumsum(chars)])
    passed = passed[:-1] - passed[f.root]
    whole = np.maximum(text[f.root], 1)
    return np.column_stack([
        onehot, onehot[parent], own, above, f.depth, np.log1p(text), link / size, (f.end - np.arange(n)) / (size + 20), mark / size, word / np.maximum(blocks, 1),
        np.log1p(longest), np.log1p(kids[parent]), np.log1p(nth), text / np.maximum(text[parent], 1), text / whole, passed / whole,
        1 - (passed + text) / whole, np.log1p(text[parent]), np.log1p(alike[back]),
    ])


def decode(f: Forest, odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labels in which a kept node's parent is kept and a kept element has a kept child.

    A block's leaf and the elements around it weigh alike, so each corrects the other.
    """
    n, parent = len(f.nodes), f.parent
    leaf = f.chars > 0
    whole = np.fromiter((x.tag in ("#root", "html", "body") for x in f.nodes), bool, n)
    odds = np.where(whole, 0.0, np.clip(odds, -8, 8))  # that a page has a body tells nothing
    take, leave = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    take[~leaf & (f.end == np.arange(n) + 1)] = -1e9  # an element without text holds nothing
    best = np.full(n, -np.inf)  # of the children, what keeping one gains
    for at in f.levels[::-1]:
        own = at[~leaf[at] & np.isfinite(best[at])]
        take[own] += np.minimum(best[own], 0)  # if no child gains, the least bad is kept
        up = at[parent[at] != at]
        gain = take[up] - leave[up]
        np.add.at(take, parent[up], np.maximum(take[up], leave[up]))
        np.add.at(leave, parent[up], leave[up])
        np.maximum.at(best, parent[up], gain)
    keep = np.zeros(n, bool)
    if n:
        roots = f.levels[0]
        keep[roots] = take[roots] > leave[roots]
    for at in f.levels[1:]:
        gain = take[at] - leave[at]
        keep[at] = keep[parent[at]] & ((gain > 0) | ((best[parent[at]] <= 0) & (gain == best[parent[at]])))
    return keep


def texts_of(sources: list[str], model: boosting.Boosted) -> list[str]:
    """Main text of each page."""
    f = Forest([parse(s) for s in sources])
    keep = decode(f, model.score(node_features(f)))
    return ["\n".join(f.nodes[i].text for i in range(a, z) if keep[i] and f.nodes[i].text) for a, z in zip(f.first[:-1].tolist(), f.first[1:].tolist(), strict=True)]


# --- training pages -----------------------------------------------------------------


def _words(r: random.Random, n: int, marks: bool = True) -> str:
    syllables = ("ta", "re", "mi", "on", "es", "lo", "qu", "en", "ar", "is", "um", "be", "de", "ing", "ou", "th")
    said = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n)]
    if marks:
        for k in range(r.randint(4, 14), n, r.randint(7, 16)):
            said[k] += r.choice([".", ",", ".", ";", "?"])
        said[-1] += "."
    return " ".join(said).capitalize()


def _class(r: random.Random, *names: str) -> str:
    return f' {r.choice(["class", "class", "id"])}="{r.choice(names)}"' if r.random() < 0.85 else ""


def training_page(seed: int) -> str:
    """A page whose main text stands between the private characters U+E000 and U+E001, block by block."""
    r = random.Random(seed)
    good = lambda s: f"\ue000{s}\ue001"
    short = lambda a=1, b=4: _words(r, r.randint(a, b), False)

    def menu() -> str:
        items = "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(r.randint(3, 12)))
        tag = r.choice(["nav", "nav", "div", "header"])
        return f"<{tag}{_class(r, 'nav', 'menu', 'navbar', 'main-menu', 'breadcrumb')}><ul>{items}</ul></{tag}>"

    def advert() -> str:
        return f"<{(t := r.choice(['div', 'aside', 'section']))}{_class(r, 'ad', 'advert', 'ads', 'sponsored', 'promo', 'ad-box')}>{r.choice(['', '<p>'])}{_words(r, r.randint(2, 30))}</{t}>"

    def notice() -> str:
        return f"<div{_class(r, 'cookie-notice', 'consent', 'notice', 'gdpr', 'popup')}><p>{_words(r, r.randint(5, 30))}</p><button>{short()}</button></div>"

    def side() -> str:
        links = "".join(f'<li><a href="#">{short(2, 8)}</a></li>' for _ in range(r.randint(2, 8)))
        return f"<{(t := r.choice(['aside', 'div', 'section']))}{_class(r, 'sidebar', 'related', 'widget', 'popular')}><h3>{short()}</h3><ul>{links}</ul>{f'<p>{_words(r, r.randint(5, 40))}</p>' if r.random() < 0.5 else ''}</{t}>"

    def form() -> str:
        return f"<form{_class(r, 'search', 'newsletter', 'login-form')}><label>{short()}</label><input type=text><p>{_words(r, r.randint(3, 15))}</p><button>{short()}</button></form>"

    def comments() -> str:
        each = "".join(f"<{(t := r.choice(['div', 'li', 'article']))}{_class(r, 'comment', 'reply', 'comment-body')}><b>{short()}</b><p>{_words(r, r.randint(4, 60))}</p></{t}>" for _ in range(r.randint(1, 6)))
        return f"<{(t := r.choice(['section', 'div']))}{_class(r, 'comments', 'discussion', 'comment-list')}><h3>{short()}</h3>{each}</{t}>"

    def foot() -> str:
        return f"<{(t := r.choice(['footer', 'footer', 'div']))}{_class(r, 'footer', 'site-footer', 'copyright', 'bottom')}>{r.choice(['', '<p>'])}&copy; {_words(r, r.randint(3, 25))} {''.join(f'<a href=#>{short()}</a> ' for _ in range(r.randint(0, 5)))}</{t}>"

    def share() -> str:
        return f"<div{_class(r, 'share', 'social')}>{''.join(f'<a href=#>{short(1, 2)}</a>' for _ in range(3))}</div>"

    def paragraph() -> str:
        body = _words(r, r.choice([r.randint(1, 6), r.randint(5, 40), r.randint(30, 160)]))
        kind = r.random()
        if kind < 0.12:
            return f"<p><b>{good(body)}<br>"
        if kind < 0.2:
            return f"<h{r.randint(2, 4)}>{good(short(1, 9))}</h2>"
        if kind < 0.27:
            return "<ul>" + "".join(f"<li>{good(_words(r, r.randint(3, 20)))}" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.31:
            return f"<blockquote><p>{good(body)}</p></blockquote>"
        if kind < 0.36:
            a, b = body.rsplit(" ", 1) if " " in body else (body, "")
            return f"<p>{good(f'{a} <a href=#>{b}</a>')}</p>"
        if kind < 0.4:
            return f"<div>{good(body)}</div>"
        return f"<p>{good(body)}</p>"

    parts = [paragraph() for _ in range(r.choice([0, 1, 2, r.randint(1, 8), r.randint(4, 25)]))]
    for extra, chance in ((advert, 0.3), (share, 0.2), (side, 0.1), (notice, 0.1), (form, 0.1)):
        if r.random() < chance and parts:
            parts.insert(r.randint(0, len(parts)), extra())
    if r.random() < 0.2:
        parts.append(comments())
    tag = r.choice(["article", "article", "article", "main", "div", "section"])
    name = _class(r, "content", "article-body", "post", "entry-content", "story") if tag in ("div", "section") else r.choice(["", _class(r, "post", "content")])
    title = good(short(2, 10)) if r.random() < 0.95 else ""
    body = f"<{tag}{name}>{f'<h1>{title}</h1>' if title else ''}{''.join(parts)}</{tag}>"
    if r.random() < 0.3:
        body = f"<div{_class(r, 'wrapper', 'container', 'page', 'layout')}>{body}{side() if r.random() < 0.5 else ''}</div>"
    if r.random() < 0.08:
        body = ""  # nothing but what surrounds a text
    before = [menu() if r.random() < 0.85 else ""]
    before += [f() for f, c in ((advert, 0.5), (notice, 0.2), (form, 0.2), (menu, 0.2), (side, 0.1)) if r.random() < c]
    if r.random() < 0.3:
        before.insert(0, f"<header{_class(r, 'header', 'masthead')}><h1>{short()}</h1><p>{short(2, 9)}</p></header>")
    after = [f() for f, c in ((comments, 0.25), (side, 0.3), (advert, 0.2), (share, 0.15), (form, 0.15)) if r.random() < c]
    after.append(foot() if r.random() < 0.9 else "")
    return f"<!DOCTYPE html><html><head><title>{short()}</title><style>p{{}}</style></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


def labelled_nodes(page: str) -> tuple[list[Node], np.ndarray]:
    """Nodes of a training page without the marks, and which hold main text."""
    nodes = parse(page)
    y = np.array([x.text.startswith("\ue000") for x in nodes], float)
    for x in nodes:
        x.text = x.text.replace("\ue000", "").replace("\ue001", "").strip()
        x.links = min(x.links, len(x.text))
    for i in range(len(nodes) - 1, 0, -1):
        y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
    return nodes, y


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES) -> boosting.Boosted:
    """Trees fitted on that many generated pages."""
    made = [labelled_nodes(training_page(k)) for k in range(pages)]
    return boosting.fit(node_features(Forest([n for n, _ in made])), np.concatenate([y for _, y in made]))


def bounded(b: pa.RecordBatch, column: str, rows: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of at most rows rows and about most bytes of a string column, a longer value by itself."""
    size = np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float))
    first, held = 0, 0.0
    for k, n in enumerate(size.tolist()):
        if k > first and (held + n > most or k - first >= rows):
            yield b.slice(first, k - first)
            first, held = k, 0.0
        held += n
    if first < b.num_rows:
        yield b.slice(first)


@lru_cache(maxsize=1)
def shipped() -> boosting.Boosted:
    """The trees of trained(), as the file holds them."""
    return boosting.Boosted.loaded(TREES.read_text())


def extract(pages: DataFrame, model: boosting.Boosted | None = None, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or shipped())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for piece in bounded(b, "html", 64):
                texts = texts_of([x or "" for x in piece.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")


if __name__ == "__main__":
    TREES.write_text(trained().dumped())

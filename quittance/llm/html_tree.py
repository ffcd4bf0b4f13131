"""HTML to node tables: a tolerant tokenizer and tree builder for feature extraction.

Nodes stand in document order, so a subtree is a range.  Text blocks are leaves: the
text between two block boundaries, character references decoded, white space folded.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Fixed values of HTML: elements without content, with raw text, and those that part blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html head li main menu nav ol option p pre search section select summary table "
    "tbody td tfoot th thead tr ul button label legend".split()
)
#: Opening the key closes an open element of the values, up to the nearest of the stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCK - {"button", "label", "option", "legend"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
EDGE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in RAW}
TEXT = "#text"


def tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag name or None, whether it is an end tag, attributes) of the markup of a page, in order.

    Time grows with the page's length, however broken the markup is: every character is looked
    at a bounded number of times.  A tag ends at the first > outside quotes; once no such > is
    left, quotes mean nothing, and once no > is left at all, the rest is text.  An open comment
    reaches to the end.  After yielding, the caller may send a position to go on from.
    """
    at, n, quoted = 0, len(source), True
    while (at := source.find("<", at)) >= 0:
        start = at
        if source.startswith("<!--", at):
            e = source.find("-->", at + 4)
            found = (start, e + 3 if e >= 0 else n, None, False, "")
        elif source[at + 1 : at + 2] in ("!", "?"):
            e = source.find(">", at)
            if e < 0:
                return
            found = (start, e + 1, None, False, "")
        else:
            closing = source.startswith("/", at + 1)
            m = NAME.match(source, at + 1 + closing)
            if not m:
                at += 1
                continue
            e = m.end()
            if quoted:
                e = _end_of_tag(source, e)
                quoted = e >= 0
            if not quoted:
                e = source.find(">", m.end())
                if e < 0:
                    return
            found = (start, e + 1, m[0], closing, source[m.end() : e])
        at = found[1]
        moved = yield found
        at = at if moved is None else moved


def _end_of_tag(source: str, at: int) -> int:
    """Where the first > outside quotes stands, -1 if nowhere."""
    while m := EDGE.search(source, at):
        if m[0] == ">":
            return m.start()
        at = source.find(m[0], m.end()) + 1
        if not at:
            break
    return -1


class Node:
    __slots__ = ("tag", "attributes", "parent", "end", "text", "links")

    def __init__(self, tag: str, attributes: str, parent: int) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.end, self.text, self.links = 0, "", 0


def parse(source: str) -> list[Node]:
    """The nodes of a page in document order; nodes[0] is the root.  end is one past the subtree's last node.

    Only block elements and text blocks are nodes; inline elements shape the text.
    links is how many characters of a text block stand in links.
    """
    nodes = [Node("#root", "", 0)]
    stack: list[tuple[str, int]] = [("#root", 0)]  # block elements; inline ones have node -1
    holder = [0]  # the open block elements' nodes
    blocks = [0]  # and their depths
    depths: dict[str, list[int]] = {}  # of all open elements, by name
    pending: list[str] = []
    linked = 0
    in_link = 0

    def flush() -> None:
        nonlocal linked
        if pending:
            text = "".join(pending)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                leaf = Node(TEXT, "", holder[-1])
                leaf.text, leaf.links = text, min(linked, len(text))
                nodes.append(leaf)
                leaf.end = len(nodes)
            pending.clear()
            linked = 0

    def pop_to(depth: int) -> None:
        nonlocal in_link
        while len(stack) > depth:
            tag, i = stack.pop()
            if stack:
                depths[tag].pop()
            if i >= 0:
                nodes[i].end = len(nodes)
                holder.pop()
                blocks.pop()
            elif tag == "a":
                in_link -= 1

    def nearest(tags: set[str] | frozenset[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

    def close(tags: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        d = nearest(tags)
        if d > nearest(stops):
            flush()
            pop_to(d)

    at, n, moved = 0, len(source), None
    scan = tokens(source)
    while True:
        try:
            start, end, name, closing, attributes = scan.send(moved)
        except StopIteration:
            break
        moved = None
        if start > at:
            pending.append(source[at:start])
            if in_link:
                linked += start - at
        at = end
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if there := depths.get(tag):
                if tag in BLOCK:
                    flush()
                if tag in BLOCK or there[-1] > blocks[-1]:
                    pop_to(there[-1])
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                pending.append(" ")
                if tag == "hr":
                    flush()
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                e = RAW_END[tag].search(source, at)
                at = moved = e.end() if e else n
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"td", "th", "button", "table", "body", "div", "article", "section"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            nodes.append(Node(tag, attributes, holder[-1]))
            depths.setdefault(tag, []).append(len(stack))
            blocks.append(len(stack))
            stack.append((tag, len(nodes) - 1))
            holder.append(len(nodes) - 1)
        else:
            depths.setdefault(tag, []).append(len(stack))
            stack.append((tag, -1))
            in_link += tag == "a"
    if at < n:
        pending.append(source[at:])
        linked += in_link > 0 and n - at
    flush()
    pop_to(0)
    for x in nodes:
        x.end = x.end or len(nodes)
    return nodes


def attribute_words(attributes: str) -> str:
    """Values of class, id, role, itemprop and aria-label, lower case, camel case parted."""
    found = [a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id", "role", "itemprop", "aria-label", "data-role")]
    return " ".join(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower() for x in found)

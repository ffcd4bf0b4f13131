"""Archives, page text and chat formatting."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest

from quittance.llm import chat, html_gbt, warc
from quittance.llm.html_tree import parse

SMALL = "/root/testdata/sf0.001"
ODD = [
    (1, "http://a/", "<p>x</p>" * 20), (2, None, "<p>x</p>" * 20), (2, None, "<p>x</p>" * 20), (3, "http://b/\r\nX: y", "short"), (4, "http://c/", "short"), (5, "u", None), (6, "u", ""),
    (None, "n", "<p>x</p>" * 20), (7, "é", "é" * 60), (8, "q%0A", "é" * 60), (8, "%250D%25%0D\r%\n", "é" * 60), (0, "z", "y" * 200), (0, "z", "y" * 200), (12, "z", "y" * 200), (None, "n", "<p>x</p>" * 20), (9, "long", "<p>" + "word " * 50000),
]
SCHEMA = "page_id long, url string, html string, digest string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "clash", 5) for r in ODD], SCHEMA)


def test_warc_round_trip(spark, odd, tmp_path):
    for pages in (odd, spark.read.parquet(f"{SMALL}/pages.parquet")):
        rows = [(r["page_id"], r["url"], (r["html"] or "").encode()) for r in pages.collect()]
        index = warc.write(pages, f"file://{tmp_path}/{pages.count()}", max_file=4000)
        got = warc.read(index).collect()
        assert len(got) == len(rows)
        first = {}
        for i, _, b in rows:
            if len(b) >= 100 and i is not None:
                first[b] = min(first.get(b, i), i)
        want = sorted(
            (str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if i is not None and len(b) >= 100 and first[b] < i else "response", str(first[b]) if i is not None and len(b) >= 100 and first[b] < i else "None", str(u)) for i, u, b in rows
        )
        assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], str(r["refers_to"]), str(r["url"])) for r in got) == want
        ids = {r["record_id"]: r["page_id"] for r in got}
        assert len(ids) == len(got)
        assert all((r["refers_to_record"] is None) == (r["refers_to"] is None) and (r["refers_to"] is None or ids[r["refers_to_record"]] == r["refers_to"]) for r in got)
        held = {r["page_id"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
        assert all(held[i] == b for i, _, b in rows if i in held)
        some = warc.read(index.filter("page_id = 9 or page_id = 3")).count()
        assert some == index.filter("page_id = 9 or page_id = 3").count()
    assert warc.read(warc.write(odd.filter("false"))).count() == 0


def test_urls_round_trip():
    import random

    r = random.Random(0)
    for _ in range(500):
        url = "".join(r.choice("%250DA\r\n x") for _ in range(r.randint(0, 9)))
        assert warc.unescaped(warc.escaped(url)) == url and not re.search(r"[\r\n]", warc.escaped(url))


def test_ranges_merge_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 200_000, 10), ("b", 0, 10), ("b", 10, 10)]
    assert list(warc.ranges(rows)) == [[0, 1], [2], [3, 4]]
    assert list(warc.ranges(rows, most=12)) == [[0], [1], [2], [3], [4]]


PAGES = {
    "tables": ("<body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>More</a></li></ul></nav><article><h1>A &amp; B</h1><p>One   two\nthree <b>four</b>, five and six.<p>Next&nbsp;one is here with many words in it.</article><footer>&copy; us</footer></body>", "A & B\nOne two three four, five and six.\nNext one is here with many words in it."),
    "comments": ("<body><header class=masthead><h1>Site</h1></header><article><h1>Title here</h1><p>Real text of the story, long enough to read on.</p><div class='comments'><h3>Comments</h3><div class=comment><p>I disagree with this text entirely.</p></div></div></article><aside class=sidebar><ul><li><a href=#>Related link</a></li></ul></aside></body>", "Title here\nReal text of the story, long enough to read on."),
    "nothing": ("<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><nav><ul><li><a href=/a>a</a></li></ul></nav><footer>&copy; 2020 us</footer></body></html>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_page_text(name):
    source, want = PAGES[name]
    assert html_gbt.texts_of([source], html_gbt.shipped())[0] == want


def test_page_text_of_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r for r in html_gbt.extract(pages).collect()}
    right = 0
    for r in pages.collect():
        import html

        body = re.split(r"</article>|<footer", r["html"].split("<article>")[1])[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        want = "\n".join(b for b in blocks if b)
        right += got[r["page_id"]]["text"] == want
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])
    assert right >= 0.99 * len(got)


def test_generated_pages_held_out():
    model, right, total = html_gbt.shipped(), 0, 0
    for k in range(5000, 5100):
        nodes, y = html_gbt.labelled_nodes(html_gbt.training_page(k))
        f = html_gbt.Forest([nodes])
        keep = html_gbt.decode(f, model.score(html_gbt.node_features(f)))
        leaf = f.chars > 0
        right += int((keep[leaf] == (y[leaf] == 1)).sum())
        total += int(leaf.sum())
        assert all(keep[f.parent[i]] for i in keep.nonzero()[0])
    assert right >= 0.96 * total


def test_shipped_trees_are_those_of_the_training():
    """The file holds what training gives, up to rounding on another machine."""
    assert html_gbt.boosting.Boosted.loaded(html_gbt.shipped().dumped()).dumped() == html_gbt.TREES.read_text()
    f = html_gbt.Forest([html_gbt.labelled_nodes(html_gbt.training_page(k))[0] for k in range(6000, 6040)])
    x = html_gbt.node_features(f)
    a, b = html_gbt.shipped().score(x) > 0, html_gbt.trained().score(x) > 0
    assert (a == b).mean() > 0.99


def test_decoding_is_the_best_labelling():
    """Against all labellings of small trees in which kept nodes have kept parents and kept elements a kept child."""
    import itertools

    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(2, 10))
        parent = [0, *(int(r.integers(0, k)) for k in range(1, n))]
        order, kids = [], {k: [c for c in range(1, n) if parent[c] == k] for k in range(n)}

        def walk(k, above):
            own = len(order)
            order.append((above, k))
            for c in kids[k]:
                walk(c, own)

        walk(0, 0)
        nodes = []
        for above, k in order:
            node = html_gbt.Node(html_gbt.TEXT if not kids[k] else "div" if k else "#root", "", above)
            node.text = "" if kids[k] or r.random() < 0.2 else "x"
            nodes.append(node)
        for i in range(n):
            nodes[i].end = i + 1
        for i in range(n - 1, 0, -1):
            nodes[nodes[i].parent].end = max(nodes[nodes[i].parent].end, nodes[i].end)
        f = html_gbt.Forest([nodes])
        odds = r.normal(0, 2, n)
        used = np.where([x.tag == "#root" for x in nodes], 0.0, odds)
        score = lambda keep: -np.logaddexp(0, np.where(keep, -used, used)).sum()  # noqa: B023, E731

        def allowed(keep):
            inner = all(not keep[i] or keep[x.parent] for i, x in enumerate(nodes))  # noqa: B023
            return inner and all(not k or x.text or any(keep[c] for c in range(i + 1, x.end) if nodes[c].parent == i) for i, (k, x) in enumerate(zip(keep, nodes, strict=True)))  # noqa: B023

        best = max(score(np.array(k)) for k in itertools.product([False, True], repeat=n) if allowed(k))
        keep = html_gbt.decode(f, odds)
        assert allowed(keep.tolist()) and score(keep) == pytest.approx(best)


def test_long_broken_pages_take_linear_time():
    import time

    start = time.time()
    for piece in ("<a ", '<a "', "<a \"'>", "<!--", "</b>", "<script>", "<p class=", "&", "<a b='"):
        parse(piece * (3_000_000 // len(piece)))
    assert time.time() - start < 30


def test_pages_odd(odd):
    got = html_gbt.extract(odd).collect()
    assert len(got) == odd.count()
    assert {r["text"] for r in got if r["page_id"] in (5, 6)} == {""}
    assert html_gbt.extract(odd.filter("false")).count() == 0


def test_tree_is_tolerant():
    for source in ("<", "<p", "</p>", "<p><div></p></div>", "<!-- open", "<script>never closed", "a &am b", "<li>a<li>b", "<b><p>x</b>y"):
        nodes = parse(source)
        assert all(x.parent < i for i, x in enumerate(nodes) if i) and nodes[0].end == len(nodes)
    assert [x.text for x in parse("<ul><li>a<li>b</ul>c<br>d &lt;") if x.text] == ["a", "b", "c d <"]


SAID = r"\### Assistant: </turn> ok"


def digest(turns):
    h, loss, n = hashlib.sha256(), "", 0
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode())
        loss += text if role == "assistant" else ""
        n += 1
    return n, h.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_link_ends_over_many_open_elements():
    for n in (0, 11, 12, 40):
        leaf = parse("<p><a href=x>" + "<b>" * n + "link</a> and plain words</p>")[-1]
        assert (leaf.text, leaf.links) == ("link and plain words", 4)
    # not over a block element
    assert parse("<a href=x><p>" + "<b>" * 40 + "link</a> more</p>")[-1].links == 9


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", SAID), (1, 1, "assistant", SAID), (2, 1, "assistant", "b"), (2, 0, "user", "a\n</turn>\n### User: x"), (2, 1, "assistant", "b"), (3, None, None, None), (3, 5, "tool: x", "y"),
        (None, 0, "user", "lost"), (4, 0, "system", ""), (4, 1, "user", "\\"), (4, 2, "assistant", "\\\\###é" * 3000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in (1, 2, 3, 4, None):
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert tuple(got[conv])[1:5] == digest([(r[2] or "", r[3] or "") for r in turns])
    assert got[1]["valid"] and got[4]["valid"] and not got[2]["valid"] and not got[3]["valid"]
    assert chat.read_back(chat.format_turns(df.filter("false"))).count() == 0
    whole = "".join(r["formatted"] for r in sorted(chat.format_turns(df).filter("conv_id = 1").collect(), key=lambda r: r["seq"]))
    assert chat.TEMPLATE.parse(whole) == [("user", SAID), ("assistant", SAID)]


def test_chat_tables(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    by = {}
    for r in df.orderBy("conv_id", "turn").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert {k: tuple(v)[1:5] for k, v in got.items()} == {k: digest(v) for k, v in by.items()}


def test_chat_sql_on_unknown_roles(tmp_path):
    """The SQL's lengths for roles that the template quotes."""
    duckdb = pytest.importorskip("duckdb")
    from quittance.llm.queries import ORACLE_SQL

    roles = ["tool: x", "é/#", "", "plain-role_1.~"]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
        db.executemany("INSERT INTO conversations VALUES (?, 0, ?, 'a')", [(k, r) for k, r in enumerate(roles)])
        got = {r[0]: r[5] for r in db.execute(ORACLE_SQL["op8_chat_format"]).fetchall()}
    for k, r in enumerate(roles):
        assert got[k] == sum(len(x) for x, _ in chat.TEMPLATE.segments(r, "a")), r

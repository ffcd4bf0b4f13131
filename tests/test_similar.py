"""Similar names and references: lanes against one pair at a time, searches against all pairs."""

from __future__ import annotations

import random

import pytest

from quittance.functions import similar
from quittance.functions.text import similarity
from quittance.operators import resolve


def texts(r, letters, n, most):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, most))) for _ in range(n)]


def changed(r, text, letters):
    out = list(text)
    for _ in range(r.randint(0, 3)):
        at = r.randrange(len(out) + 1)
        out[at : at + r.randint(0, 1)] = r.choice(letters) * r.randint(0, 1)
    return r.choice(["", "XY"]) + "".join(out) + r.choice(["", "QQ"])


@pytest.mark.parametrize("letters", ["AB", "ABCD", "ABCDEFGHIJ0123", "ÉABŐ中"])
def test_lanes_equal_one_by_one(letters):
    r = random.Random(1)
    a = [*texts(r, letters, 200, 20), "A" * 70, "AB" * 40, "", "AAAAA"]
    b = [*[changed(r, x, letters) if k % 2 else y for k, (x, y) in enumerate(zip(a, texts(r, letters, 200, 30), strict=False))], "A" * 65, "BA" * 50, "A", ""]
    want = [similarity(x, y) for x, y in zip(a, b, strict=True)]
    assert similar.scores(a, b).tolist() == want
    for least in (60, 89, 100):
        assert all(g == w if w >= least else g < least for g, w in zip(similar.scores(a, b, least).tolist(), want, strict=True))
    needles, hays = [x for x in a if x][:40], [y for y in b if len(y) >= 5][:60]
    pairs = [(i, j, similarity(y, x)) for i, x in enumerate(needles) for j, y in enumerate(hays) if len(x) <= len(y)]
    assert sorted(similar.similar_in_block(needles, hays, 80)) == [p for p in pairs if p[2] >= 80]


def test_small_steps_change_nothing(monkeypatch):
    r = random.Random(6)
    a, b = texts(r, "ABC", 60, 12), texts(r, "ABC", 60, 25)
    want = similar.scores(a, b).tolist()
    monkeypatch.setattr(similar, "CELLS", 64)
    assert similar.scores(a, b).tolist() == want


def test_signature_is_kept_by_every_similar_window():
    """At least one of any take grams stands in the text, at most shift places off, wherever the similarity is least."""
    r = random.Random(8)
    for least in (70, 81, 89, 94, 98):
        for _ in range(400):
            needle = "".join(r.choice("ABC") for _ in range(r.randint(1, 16)))
            hay = changed(r, needle, "ABC")
            if len(hay) < max(len(needle), 5) or similarity(hay, needle) < least:
                continue
            if len(hay) == len(needle) and int(similar._one_way([needle], [hay], 0)[0]) < least:
                continue  # the other direction's
            q, take, shift = resolve.signature(len(needle), least)
            n, m = len(needle), len(hay)
            stands = [any(needle[i : i + q] == hay[p : p + q] for p in range(max(0, i - shift), min(m - q, i + m - n + shift) + 1)) for i in range(n - q + 1)]
            assert len(stands) - sum(stands) < take <= len(stands), (needle, hay, least)


@pytest.fixture(scope="module")
def alike():
    """Names with a common beginning, some of them almost equal, and payers who write them with slips."""
    r = random.Random(4)
    begin = "NORTHWINDTRADING"
    names = sorted({begin + "".join(r.choice("ABCDEFGH") for _ in range(r.randint(3, 8))) for _ in range(90)} | {"".join(r.choice("ABCD") for _ in range(r.randint(4, 14))) for _ in range(40)})
    asked = sorted({changed(r, n, "ABX") for n in names[::2]} | {"A", "NORTH", begin, begin * 5})
    return asked, names


@pytest.mark.parametrize(("percent", "heavy", "block"), [(88, 512, 512), (88, 3, 4), (93, 10, 1000), (75, 5, 7), (97, 0, 3), (40, 20, 16)])
def test_names_with_a_common_beginning_equal_all_pairs(spark, alike, percent, heavy, block):
    asked, names = alike
    left = spark.createDataFrame([(a,) for a in asked], "key string")
    right = spark.createDataFrame([(n, f"c{n}") for n in names], "name_key string, customer_id string")
    score = {(a, n): similarity(n, a) for a in asked for n in names if len(n) >= 5}
    want = {(a, n, f"c{n}", s) for (a, n), s in score.items() if s > percent}
    got = [tuple(x) for x in resolve.similar_pairs(left, right, percent, heavy=heavy, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    few = {tuple(x) for x in resolve.similar_pairs(left, right, percent, every=False, heavy=heavy, block=block).collect()}
    best = {a: min((-s, n) for b, n, _, s in want if b == a) for a in {x[0] for x in want}}
    assert few <= want and {(a, n) for a, (_, n) in best.items()} <= {x[:2] for x in few}


def test_no_names_and_no_payers(spark, alike):
    left = spark.createDataFrame([(a,) for a in alike[0]], "key string")
    right = spark.createDataFrame([(n, None) for n in alike[1]], "name_key string, customer_id string")
    assert resolve.similar_pairs(left, right, 88).count() == 0
    assert resolve.similar_pairs(left.filter("false"), right, 88).count() == 0
    assert resolve.similar_pairs(left, right, 100).count() == 0

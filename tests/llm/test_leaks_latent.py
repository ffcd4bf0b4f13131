"""Leaks in other words come through the latent space: what it brings, what it does not, and nothing without it."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from quittance.llm import decontam

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def case(spark):
    """Items inside whole documents: verbatim, reworded with a share of their words kept, sentences turned, words shuffled."""
    r = random.Random(1)
    docs = [x["text"] for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if x["lang"] == "en" and 1500 < len(x["text"]) < 6000][:120]
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    docs = [t for t in docs if not any(i in t for _, i in items)]
    usual = [w for t in docs for w in t.split()]

    def reworded(text, kept):
        w = text.split()
        for k in r.sample(range(len(w)), round(len(w) * (1 - kept))):
            w[k] = r.choice(usual)
        return " ".join(w)

    def turned(text):
        said = decontam.sentences(text)
        return reworded(" ".join(said[1:] + said[:1]), 0.85)

    planted = []
    for i, t in items:
        forms = [("verbatim", t), *[(f"kept {s}", reworded(t, s)) for s in (0.4, 0.5, 0.6)], ("turned", turned(t)), ("shuffled", " ".join(r.sample(t.split(), len(t.split()))))]
        for kind, said in forms:
            base = r.choice(docs).split()
            at = r.randrange(len(base))
            planted.append((kind, i, len(t.split()), " ".join([*base[:at], said, *base[at:]])))
    rows = [(n, t) for n, (_, _, _, t) in enumerate(planted)] + [(10_000 + n, t) for n, t in enumerate(docs)]
    return planted, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


def test_reworded_items_are_found_and_shuffled_ones_are_not(case):
    planted, docs, bench = case
    out = decontam.find_leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in out}
    hit = lambda kind, least=0: [(n, i) in found for n, (k, i, size, _) in enumerate(planted) if k == kind and size >= least]
    assert all(hit("verbatim"))
    reworded = hit("kept 0.4", 25) + hit("kept 0.5", 25) + hit("kept 0.6", 25)
    assert sum(reworded) >= 0.9 * len(reworded)
    assert sum(hit("kept 0.6")) >= 0.9 * len(hit("kept 0.6")) and sum(hit("turned")) >= 0.9 * len(hit("turned"))
    assert not any(hit("shuffled"))
    assert len([1 for n, _ in found if n >= 10_000]) <= 1
    assert all(r["cosine"] >= decontam.Limits().cosine - 1e-6 for r in out if r["lcs_ratio"] < decontam.Limits().verbatim)


def test_without_the_space_only_verbatim_copies_are_found(case, monkeypatch):
    planted, docs, bench = case
    monkeypatch.setattr(decontam, "latent_space", lambda posted, block, idf, share: np.zeros((len(idf), 4), np.float32))
    found = {r["doc_id"]: r["lcs_ratio"] for r in decontam.find_leaks(docs, bench).collect()}
    kinds = [planted[n][0] for n in found if n < len(planted)]
    assert kinds.count("verbatim") == sum(k == "verbatim" for k, *_ in planted)
    assert not any(k.startswith("kept 0.4") or k.startswith("kept 0.5") or k.startswith("kept 0.6") for k in kinds)
    assert all(x >= decontam.Limits().verbatim for x in found.values())


def lists(rows):
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([x[0] for x in rows]), *[pa.array([x[k].tolist() for x in rows], pa.list_(pa.int32())) for k in (2, 1)]], ["doc_id", "n", "terms", "places"])


def test_nearest_passages_against_all_passages(monkeypatch):
    """Every passage of a batch against every item's: each at the floor is one of those given, or within four of a nearer one."""
    r = np.random.default_rng(3)
    basis = r.standard_normal((40, 6)).astype(np.float32)
    items = [r.integers(0, 40, n).astype(np.int32) for n in (6, 15, 30, 70)]
    rows = [(n, np.sort(r.permutation(n)[: n // 2 + 1])) for n in (1, 4, 30, 90, 400, 24, 48)]
    rows = [(n, at, r.integers(0, 40, len(at)).astype(np.int32)) for n, at in rows]
    asked = np.array([decontam._unit(basis, w) for w in items])
    sizes, of, floor = np.array([len(w) for w in items]), np.arange(len(items)), 0.55
    for chunk in (5, 1 << 13):
        monkeypatch.setattr(decontam, "CHUNK", chunk)
        given = list(decontam._nearest(lists(rows), sizes, basis, asked, of, floor))
        want = {}
        for row, (n, at, held) in enumerate(rows):
            for width in decontam.WIDTHS:
                for place in range(0, max(1, -(-(n - width) // (width // 3)) + 1) * (width // 3), width // 3):
                    x = basis[held[(at >= place) & (at < place + width)]].sum(0)
                    for k, c in enumerate((asked @ (x / max(np.linalg.norm(x), 1e-9))).tolist()):
                        if c >= floor:
                            want[row, k, width, place] = c
        assert want and len(given) < len(want)
        for row, k, place, c, around in given:
            width = next(w for w in decontam.WIDTHS if abs(want.get((row, k, w, place), 9) - c) < 1e-4)
            n, at, held = rows[row]
            reach = int(decontam._reach(sizes[k], width))
            assert around.tolist() == held[(at >= place + width // 2 - reach) & (at < place + width // 2 + reach)].tolist()
        have = {(row, k, place): c for row, k, place, c, _ in given}
        for (row, k, width, place), c in want.items():
            assert any((row, k, place + s * (width // 3)) in have for s in range(-4, 5)), (row, k, place)


def test_paraphrases_against_brute_force(spark):
    """The same leaks as from every passage checked by itself, with the space that the search had."""
    r = np.random.default_rng(5)
    usual = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(usual, 30).tolist()) + ". " + " ".join(r.choice(usual, 8).tolist()) + ".") for k in range(12)]
    texts = []
    for n in range(60):
        w = items[n % 12][1].split()
        for k in r.permutation(len(w))[: int(len(w) * (0.2 + 0.1 * (n % 7)))]:
            w[k] = str(r.choice(usual))
        texts.append((n, " ".join([*r.choice(usual, int(r.integers(0, 120))).tolist(), *w, *r.choice(usual, int(r.integers(0, 120))).tolist()])))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen, real = {}, decontam.latent_space

    def watched(posted, block, idf, share):
        seen.update(block=block, idf=idf, space=real(posted, block, idf, share))
        return seen["space"]

    decontam.latent_space = watched
    try:
        found = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(docs, bench).collect()}
    finally:
        decontam.latent_space = real
    block, limits = seen["block"], decontam.Limits()
    rows = seen["space"] * seen["idf"][:, None].astype(np.float32)
    want = set()
    for n, text in texts:
        held = block.vocabulary.find(decontam._of_text(text))
        for k, (i, w) in enumerate(zip(block.ids, block.words, strict=True)):
            q = decontam._unit(rows, np.unique(w))
            for width in decontam.WIDTHS:
                for place in range(0, max(1, len(held) - width + width // 3), width // 3):
                    x = held[place : place + width]
                    x = rows[x[x >= 0]].sum(0)
                    m, reach = place + width // 2, int(decontam._reach(np.array(len(w)), width))
                    near = held[max(m - reach, 0) : m + reach]
                    near = near[near >= 0].tolist()
                    order = decontam.common_subsequence(*decontam._masks(w), near)
                    answer = decontam.common_subsequence(*decontam._masks(block.answers[k]), near) / len(block.answers[k])
                    both = sum(min(near.count(t), w.tolist().count(t)) for t in set(w.tolist()))
                    if order >= limits.verbatim * len(w) or (q @ x / max(np.linalg.norm(x), 1e-9) >= limits.cosine and answer >= limits.answer and limits.reworded(len(w), both, order)):
                        want.add((n, i))
    assert len(want) > 30 and found <= want and len(found) >= 0.97 * len(want)


def test_row_sums():
    r = np.random.default_rng(2)
    for _ in range(50):
        n = int(r.integers(1, 200))
        head, at = np.unique(np.append(0, r.integers(0, n, int(r.integers(0, 40))))), r.integers(0, 40, n)
        rows, weight = r.standard_normal((40, 5)).astype(np.float32), r.random(n).astype(np.float32)
        assert np.allclose(decontam._row_sums(rows, at, head, weight), np.add.reduceat(rows[at] * weight[:, None], head, axis=0), atol=1e-4)
        assert np.allclose(decontam._row_sums(rows, at, head), np.add.reduceat(rows[at], head, axis=0), atol=1e-4)
    assert decontam._row_sums(rows, np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 5)

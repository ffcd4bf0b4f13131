"""The operators on documents against brute force, on odd rows and on the small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quittance.llm import decontam, line_rules, mixing, near_dup, quality_qda, suffix_dedup, token_counts
from quittance.llm.induced_sort import Store, sort_suffixes, text_of
from tests.llm.odd import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def empty(df):
    return df.filter("false")


# --- line rules ------------------------------------------------------------------------------


def measures(text):
    t = text or ""
    w = WORD.findall(t)
    runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    again = {k + j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), failed


def test_line_rules_measures(odd, small):
    for df in (odd, small):
        out = line_rules.clean_lines(df).select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        assert len(out) == df.count()
        for r in out:
            assert tuple(r[2:]) == measures(r["text"]), r["doc_id"]


def test_line_rules_verdicts(odd):
    kept = {r["doc_id"]: r["kept"] for r in line_rules.clean_lines(odd).filter("doc_id is not null").collect()}
    assert kept[0] and kept[1] and kept[8] and kept[15] and kept[18]
    assert not any(kept[i] for i in (3, 4, 5, 6, 13, 14, 16))
    text = {r["doc_id"]: r["text"] for r in line_rules.quality_rules_stage(None, odd, "").collect()}
    assert text[15] == rows()[16][1].split("\n")[0]
    assert line_rules.quality_rules_stage(None, odd, "").columns == odd.columns
    assert line_rules.clean_lines(empty(odd)).count() == 0


@pytest.mark.parametrize(
    ("line", "fails"),
    [
        ("Home | About | Contact | Terms", True), ("Start › Shop › Schuhe › Damen", True), ("« Oui », dit le roi, et il partit.", False), ("[one](http://a) [two](http://b)", True),
        ("See https://a.example/x for all that was said about it then.", False), ("The story of a long and ...", True), ("He said it was over ... and then, after a while, that it had been so for years and years.", False),
        (" ".join(["word"] * 40), True), (" ".join(["word"] * 40) + ".", False), (" ".join(["word"] * 12), False), ("Alle Rechte vorbehalten.", True), ("Tous droits réservés.", True), ("Todos los derechos reservados.", True),
        ("CONDITIONS D'UTILISATION", True), ("No! Never! Not! At! All!", True), ("Why not?", False), ("## ## ##", True), ("A plain line, as good as any other.", False),
    ],
)
def test_line_rules_by_line(spark, line, fails):
    body = prose(90, 60)
    out = line_rules.clean_lines(spark.createDataFrame([(1, body + "\n" + line)], "doc_id long, text string")).first()
    assert out["clean_text"] == (body if fails else body + "\n" + line)


def test_line_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    j = line_rules.clean_lines(docs).join(labels, "doc_id").filter("n_words >= 20")
    good, bad = (j.filter(f"quality = {q}") for q in (1, 0))
    assert good.filter("kept").count() >= 0.99 * good.count()
    assert bad.filter("not kept").count() >= 0.9 * bad.count()


# --- quality ------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_qda.classify(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)
    good = np.array([r["score"] for r in out if r["quality"] == 1])
    bad = np.array([r["score"] for r in out if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_quality_scores_are_plain_densities(spark):
    """Every score against densities by determinants and inverses, from the collected statistics of the training rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    x = {r["doc_id"]: np.array(r["x"]) for r in quality_qda.features(docs).collect()}
    out = {r["doc_id"]: r for r in quality_qda.classify(docs, labels).collect()}
    taught = [(x[r["doc_id"]], r["quality"]) for r in labels.collect() if r["quality"] is not None and not out[r["doc_id"]]["held_out"]]
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    both = np.array([v for v, _ in taught])
    scale = both.std(0)
    density = []
    for k in (0, 1):
        v = np.array([v for v, y in taught if y == k]) / np.maximum(scale, 3e-5)
        cov = np.cov(v.T, bias=True)
        cov = 0.9 * cov + 0.1 * max(np.trace(cov) / len(cov), 0.02) * np.eye(len(cov)) + 0.02 * np.eye(len(cov))
        inverse, log_det, mean = np.linalg.inv(cov), np.linalg.slogdet(cov)[1], v.mean(0)
        density.append(lambda z, m=mean, i=inverse, d=log_det: -0.5 * ((z / np.maximum(scale, 3e-5) - m) @ i @ (z / np.maximum(scale, 3e-5) - m) + d))
    prior = np.log(sum(y for _, y in taught) / sum(1 - y for _, y in taught))
    gap = np.array([density[1](x[i]) - density[0](x[i]) + prior for i in out])
    logit = np.array([np.log(r["score"] / (1 - r["score"])) for r in out.values()])
    inside = np.abs(logit) < 30
    fit = np.polyfit(gap[inside], logit[inside], 1)
    assert fit[0] > 0 and np.abs(np.polyval(fit, gap[inside]) - logit[inside]).max() < 1e-6 * max(1, np.abs(gap).max())
    # the slope and shift are those of the likeliest logistic over the training rows, up to the bins
    y = np.array([y for _, y in taught])
    g = np.array([density[1](v) - density[0](v) + prior for v, _ in taught])
    loss = lambda a, b: np.logaddexp(0, np.where(y == 1, -1, 1) * (a * g + b)).mean()
    assert loss(*fit) <= min(loss(fit[0] * k, fit[1] + s) for k in (0.7, 1, 1.4) for s in (-0.5, 0, 0.5)) + 2e-3


def test_quality_odd(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (13, 0, 0), (13, 0, 0), (None, 1, 0), (14, None, 0), (16, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_qda.classify(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
    assert {r["score"] for r in quality_qda.classify(odd, labels.filter("false")).collect()} == {0.5}
    assert quality_qda.classify(empty(odd), labels).count() == 0


# --- mixing -------------------------------------------------------------------------------------------


def fill(sizes, budget):
    left = {s: (x, w) for s, (x, w) in sizes.items()}
    target = {}
    while left:
        level = (budget - sum(target.values())) / sum(w for _, w in left.values())
        over = [s for s, (x, w) in left.items() if level * w > 2 * x]
        if not over:
            return target | {s: level * w for s, (_, w) in left.items()}
        for s in over:
            target[s] = 2.0 * left.pop(s)[0]
    return target


@pytest.mark.parametrize("which", ["odd", "small"])
def test_mixing(which, request):
    docs = request.getfixturevalue(which)
    out = mixing.mix(docs, carry=["doc_id", "source", "text"]).collect()
    assert len(out) == docs.count()
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert 0 <= r["copies"] <= 2
        by[r["source"]].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = {s: (sum(r["size"] for r in by[s]), (3, 1, 2)[k % 3]) for k, s in enumerate(order)}
    want = fill(sizes, 1.5 * sum(x for x, _ in sizes.values()))
    for s in order:
        assert all(r["source_size"] == sizes[s][0] and r["target"] == pytest.approx(want[s]) for r in by[s])
        taken = sum(r["copies"] * r["size"] for r in by[s])
        assert abs(taken - want[s]) <= 2 * max(r["size"] for r in by[s]) + 1
    again = mixing.mix(docs.repartition(3), carry=["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_mixing_emits_copies(odd):
    mixed = mixing.mix(odd)
    assert mixing.emit(mixed).count() == sum(r["copies"] for r in mixed.collect())
    assert mixing.mix(empty(odd)).count() == 0
    assert mixing.mixing_stage(None, odd, "").columns == [*odd.columns, "copy_no"]
    assert mixing.mixing_stage(None, empty(odd), "").count() == 0


def test_mixing_stage_emits_the_copies_of_mix(spark, odd, small):
    """The stage's rows by source, doc_id and text, repeated and differing ones included, are mix()'s copies."""
    again = spark.createDataFrame([(k % 3 if k % 7 else None, "one two three", f"s{k % 2}" if k % 5 else None, k % 4) for k in range(60)], "doc_id long, text string, source string, copy_no int")
    for df in (odd, small, again):
        want = Counter()
        for r in mixing.mix(df, carry=["doc_id", "source", "text"]).collect():
            want[r["doc_id"], r["source"], r["text"]] += r["copies"]
        out = mixing.mixing_stage(spark, df, "").collect()
        assert Counter((r["doc_id"], r["source"], r["text"]) for r in out) == +want
        whole = Counter(tuple(r) for r in df.collect())
        assert set(tuple(r)[:-1] for r in out) <= set(whole)
        assert all(n <= 2 * whole[k] for k, n in Counter(tuple(r)[:-1] for r in out).items())


# --- near duplicates ------------------------------------------------------------------------------------


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[k : k + 5]) for k in range(len(w) - 4)))


def classes(pairs_of, percent):
    parent = {i: i for i, _ in pairs_of}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(pairs_of, 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in pairs_of}


def many_copies(spark):
    """A base with scattered one-word edits, so that links chain and many pairs lie near the threshold."""
    words = prose(40, 90).split()
    texts = [" ".join(words)]
    for k in range(60):
        w = list(words)
        for j in range(k % 5):
            w[(7 * k + 13 * j) % 90] = f"new{(k + j) % 9}"
        texts.append(" ".join(w))
    return spark.createDataFrame([(100 + 3 * k, t) for k, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, odd, small, percent):
    for df in (odd.filter("doc_id is not null"), small, many_copies(spark)):
        got = {r["doc_id"]: r for r in near_dup.near_duplicates(df, percent=percent).collect()}
        texts = [(r["doc_id"], shingles(r["text"])) for r in df.select("doc_id", "text").distinct().collect()]
        want = classes(texts, percent)
        for i, s in texts:
            assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), want[i], want[i] == i)


def test_near_duplicates_odd(odd):
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == odd.count()
    assert [(r["component_id"], r["kept"]) for r in out if r["doc_id"] is None] == [(None, True)]
    assert near_dup.near_duplicates(empty(odd)).count() == 0
    kept = near_dup.near_dedup_stage(None, odd, "")
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in [*range(19), None] if i not in (1, 2, 7)}


def test_one_outsider_in_a_large_bucket_is_sent_with_few_copies(spark):
    """Rows dealt for comparison: a member of the large side once per block of the small side."""
    members = [(1, k, 7) for k in range(9000)] + [(1, 9000, 9000), (2, 1, 1), (2, 2, 2), (2, 3, 3)] + [(3, k, 5) for k in range(50)]
    labelled = spark.createDataFrame(members, "key long, rep long, label long")
    open_ = near_dup._open_buckets(labelled)
    assert {r["key"]: (r["heavy_n"], r["light_n"]) for r in open_.collect()} == {1: (9000, 1), 2: (1, 2)}
    blocks = lambda c: near_dup.F.ceil(near_dup.F.col(c) / near_dup.BLOCK).cast("int")
    light = near_dup.F.col("label") != near_dup.F.col("heavy")
    own = near_dup.F.pmod(near_dup.F.xxhash64("rep"), near_dup.F.when(light, blocks("light_n")).otherwise(blocks("heavy_n"))).cast("int")
    dealt = labelled.join(open_, "key").select("key", "rep", "label", near_dup.F.explode(near_dup._cells(light, blocks("light_n"), blocks("heavy_n"), own)).alias("c"))
    rows_ = dealt.select("key", "rep", "label", "c.*").collect()
    assert sum(r["key"] == 1 for r in rows_) == 9000 + 9 + 1
    # every pair of different labels meets in exactly one cell
    met = Counter()
    by = defaultdict(list)
    for r in rows_:
        by[r["key"], r["kind"], r["i"], r["j"]].append(r)
    for cell in by.values():
        for a, b in combinations(cell, 2):
            if a["label"] != b["label"] and (a["side"] != b["side"] or (a["kind"] == 0 and a["i"] == a["j"])):
                met[a["key"], min(a["rep"], b["rep"]), max(a["rep"], b["rep"])] += 1
    assert set(met.values()) == {1} and len(met) == 9000 + 3


def test_near_dedup_stage_keeps_one_of_equal_rows(spark):
    a, b = prose(3, 40), prose(4, 40)
    docs = spark.createDataFrame([(1, a), (1, a), (2, a), (3, b), (3, prose(5, 40)), (None, a), (None, a), (4, None), (4, None)], "doc_id long, text string")
    out = sorted((str(r["doc_id"]), r["text"] or "") for r in near_dup.near_dedup_stage(spark, docs, "").collect())
    assert out == sorted([("1", a), ("3", b), ("3", prose(5, 40)), ("None", a), ("None", a), ("4", "")])


def test_bayes_limits_rise_and_spare_the_threshold():
    limits = near_dup.fewest_matches(0.85, 1e-6)
    assert limits == sorted(limits) and limits[-1] < 0.85 * near_dup.HASHES


# --- repeats ---------------------------------------------------------------------------------------------------


def repeats(docs):
    first, out = {}, {}
    for i, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        key = 2**63 if i is None else i
        b = (t or "").encode()
        gone = bytearray(len(b))
        strings = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, s in enumerate(strings):
            if first.get(s, key) < key:
                gone[k : k + 50] = b"\1" * 50
        for s in strings:
            first.setdefault(s, key)
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(left).hexdigest())
    return out


def test_repeats(spark, odd, small):
    overlapping = spark.createDataFrame([(k, prose(50, 40)[k * 7 : k * 7 + 160] + prose(60 + k, 6)) for k in range(12)], "doc_id long, text string")
    for df in (odd, small, overlapping, many_copies(spark)):
        want = repeats([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
        got = suffix_dedup.remove_repeats(df, shard=2000).collect()
        assert len(got) == df.count()
        for r in got:
            assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert suffix_dedup.remove_repeats(empty(odd)).count() == 0
    assert suffix_dedup.suffix_dedup_stage(None, odd, "").columns == odd.columns
    assert suffix_dedup.suffix_dedup_stage(None, odd, "").count() == odd.count()


def test_repeats_far_beyond_memory(spark):
    """Shards a hundred times what the sort may hold, whole buckets split by stretch, entries reduced at once: the result stays."""
    words = [prose(k, 1) for k in range(40)]
    r = np.random.default_rng(2)
    base = " ".join(r.choice(words, 3000).tolist())
    texts = [base[a : a + 400] + prose(300 + k, 3) + base[z : z + 300] for k, (a, z) in enumerate(r.integers(0, len(base) - 500, (150, 2)).tolist())]
    # one gram in most texts, with contexts of its own in each
    texts = [t + f" the one line that most texts share, number {k % 50} of them, and then {prose(k % 30, 9)}" for k, t in enumerate(texts)]
    rows_ = [(k if k % 40 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows_ + [(7, None), (8, "")], "doc_id long, text string").repartition(4)
    want = sorted(map(str, [*repeats_of_rows(rows_), (0, 0, 0, hashlib.sha256(b"").hexdigest()), (0, 0, 0, hashlib.sha256(b"").hexdigest())]))
    for options in ({"shard": 100_000, "memory": 1000}, {"shard": 100_000, "memory": 1000, "hot_bytes": 0, "held": 100}):
        got = suffix_dedup.remove_repeats(df, **options).collect()
        assert sorted(str((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])) for r in got) == want, options


def repeats_of_rows(rows_):
    """repeats() of rows whose null ids are all larger than the others and equal to one another."""
    first, out = {}, []
    key = lambda i: 2**63 if i is None else i
    for i, t in sorted(rows_, key=lambda x: key(x[0])):
        for k in range(len(t.encode()) - 49):
            first.setdefault(t.encode()[k : k + 50], key(i))
    for i, t in rows_:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < key(i):
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return out


def in_order(t, store, depth, sigma=None):
    sigma = sigma or int(t.max()) + 1
    places, prefixes = [], []
    text, counts = text_of(iter([t]), sigma, np.uint8 if sigma <= 256 else np.int32, store)
    sort_suffixes(text, counts, store, lambda p, x: (places.extend(p.tolist()), prefixes.extend(x.tolist())), depth)
    return places, prefixes


def test_suffix_order(tmp_path):
    """Places and common prefixes against sorting, with queues that hold a handful of tuples and with large ones."""
    r = np.random.default_rng(0)
    for n in (1, 2, 5, 40, 300):
        for sigma in (1, 2, 4, 600):
            t = np.append(r.integers(1, 1 + sigma, n), 0)
            if n > 20:
                t[n // 2 : n // 2 + 8] = t[:8]
            s = t.tolist()
            want = sorted(range(len(s)), key=lambda i: s[i:])[:0:-1]
            for memory, depth in ((8, 5), (8, 50), (40, 50), (1 << 16, 50)):
                places, prefixes = in_order(t, Store(str(tmp_path), memory), depth)
                assert places == want
                for a, b, k in zip(want[:-1], want[1:], prefixes[1:], strict=True):
                    m = 0
                    while max(a, b) + m < len(s) and s[a + m] == s[b + m]:
                        m += 1
                    assert min(k, depth) == min(m, depth)
    assert not list(tmp_path.iterdir())


def test_suffix_order_goes_through_disk(tmp_path):
    """A text two hundred times the memory: tuples are written as runs, and the order is that of one held in memory."""
    r = np.random.default_rng(1)
    t = np.append(r.integers(1, 5, 100_000), 0)
    t[50_000:60_000] = t[:10_000]
    small, large = Store(str(tmp_path), 500), Store(str(tmp_path), 1 << 20)
    places, prefixes = in_order(t, small, 50)
    assert (places, [min(x, 50) for x in prefixes]) == (lambda p, x: (p, [min(y, 50) for y in x]))(*in_order(t, large, 50))
    assert small.written > 20 * len(t) > large.written


# --- leaks ------------------------------------------------------------------------------------------------------------


def test_leaks(spark, small):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(small, bench).collect()}
    exact = {(r["doc_id"], i) for r in small.collect() for i, t in items.items() if t in r["text"]}
    assert exact and exact <= found
    # paraphrases: every seventh word replaced; clean prose stays
    changed = [(1000 + i, prose(i, 60) + " " + " ".join(w if k % 7 else "other" for k, w in enumerate(t.split())) + " " + prose(i + 1, 60)) for i, t in items.items() if len(t.split()) > 25]
    clean = [(5000 + k, prose(900 + k, 200)) for k in range(40)]
    more = small.select("doc_id", "text").unionByName(spark.createDataFrame(changed + clean, "doc_id long, text string"))
    found = {r["doc_id"] for r in decontam.find_leaks(more, bench).collect()}
    assert sum(i in found for i, _ in changed) >= 0.9 * len(changed)
    assert not any(i in found for i, _ in clean)


def test_leaks_odd(spark, odd):
    bench = spark.createDataFrame([(1, prose(3, 40)), (2, None), (3, ""), (3, ""), (None, prose(4, 30)), (5, "two words")], "item_id long, text string")
    out = decontam.find_leaks(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(8, 1), (9, None)}
    assert decontam.find_leaks(odd, bench.filter("false")).count() == 0
    assert decontam.find_leaks(empty(odd), bench).count() == 0
    blocks = decontam.find_leaks(odd, bench, terms=30).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == {(8, 1), (9, None)}


def test_leaks_of_few_words(spark, odd):
    """Items below min_words are found where all their words follow one another, whatever else the benchmark holds."""
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "two plus two is"), (3, "Hamlet"), (4, prose(3, 40)), (5, "no, never"), (6, "Who wrote Hamlet?")], "item_id long, text string")
    texts = [(1, "He asked: who wrote HAMLET? Nobody knew."), (2, "two plus two is four"), (3, "two and plus two is not it"), (4, "Hamlet wrote who"), (5, "is two plus two"), (6, None), (7, "no. Never!"), (8, "")]
    out = decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(1, 1), (1, 6), (1, 3), (2, 2), (4, 3), (7, 5)} and len(out) == 6
    assert decontam.find_leaks(odd, bench.filter("item_id < 3")).count() == 0


def planted_paraphrases(seed, items):
    """Of each item: a seventh of its words replaced; its halves in the other order; both."""
    r = np.random.default_rng(seed)
    swap = lambda w: [x if r.random() > 1 / 7 else f"other{r.integers(1000)}" for x in w]
    for k, t in items:
        said = decontam.sentences(t)
        turned = " ".join(said[len(said) // 2 :] + said[: len(said) // 2]).split()
        yield from ((k, kind, " ".join(w)) for kind, w in (("replaced", swap(t.split())), ("turned", turned), ("both", swap(turned))))


def test_leaks_recall_and_clean_texts_of_the_same_words(spark):
    """At least nine in ten paraphrases of 10,000 items are found, in one pass; shuffled words of the items are clean."""
    r = np.random.default_rng(11)
    usual = np.array([f"w{k}" for k in range(20000)])
    sentence = lambda: " ".join(r.choice(usual, int(r.integers(5, 14))).tolist()) + "."
    items = [(k, " ".join(sentence() for _ in range(int(r.integers(2, 6))))) for k in range(10000)]
    around = lambda: " ".join(r.choice(usual, 70).tolist())
    planted = [(n, k, kind, f"{around()} {t} {around()}") for n, (k, kind, t) in enumerate(planted_paraphrases(5, items[::50]))]
    clean = [(100000 + k, " ".join(r.permutation(" ".join(t for _, t in items[k : k + 4]).split()).tolist())) for k in range(200)]
    docs = spark.createDataFrame([(n, t) for n, _, _, t in planted] + clean, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontam.blocks_of(bench, 5))) == 1
    found = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect()}
    for kind in ("replaced", "turned", "both"):
        own = [(n, k) for n, k, x, _ in planted if x == kind]
        assert sum(x in found for x in own) >= 0.9 * len(own), kind
    assert not any(n >= 100000 for n, _ in found)


def test_decontamination_stage(spark, tmp_path):
    """Rows go by themselves: null and repeated ids, repeated rows, clashing columns, an empty table."""
    item = prose(7001, 36)
    spark.createDataFrame([(1, item), (2, None), (3, "Who wrote Hamlet?")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = prose(1, 60000) + " " + item + " " + prose(2, 60000)
    rows_ = [(1, item), (None, "before " + item), (None, prose(5, 40)), (2, prose(6, 40)), (2, item), (3, item), (3, item), (4, None), (5, ""), (6, long), (None, "who wrote Hamlet"), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, k) for k, (i, t) in enumerate(rows_)], "doc_id long, text string, leak_id int, text_hash int")
    out = decontam.decontamination_stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r["text_hash"] for r in out.collect()) == [2, 3, 7, 8, 11]
    assert decontam.decontamination_stage(spark, empty(docs), str(tmp_path)).count() == 0


def test_leaks_in_a_third_of_the_rows(spark):
    """Copies of a short document that holds an item make all of the item's words frequent."""
    item = prose(7001, 36)
    copies = [(k, prose(7002, 20) + " " + item + " " + prose(7003, 20)) for k in range(400)]
    other = [(1000 + k, prose(7100 + k, 90)) for k in range(800)]
    lone = [(9000, prose(8001, 60) + " " + item + " " + prose(8002, 60))]
    docs = spark.createDataFrame(copies + other + lone, "doc_id long, text string")
    found = {r["doc_id"] for r in decontam.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {k for k, _ in copies + lone}


def test_leaks_among_unknown_words(spark):
    """A short item of frequent words, copied once between words that the benchmark lacks."""
    words = [f"often{k}" for k in range(10)]
    apart = [(k, " ".join(f"{w} " + " ".join(f"x{k}y{j}z{i}" for i in range(6)) for j, w in enumerate(reversed(words)))) for k in range(600)]
    around = [" ".join(f"{side}{k}" for k in range(60)) for side in ("left", "right")]
    docs = spark.createDataFrame([*apart, (9000, f"{around[0]} {' '.join(words)} {around[1]}")], "doc_id long, text string")
    out = decontam.find_leaks(docs, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["lcs_ratio"]) for r in out] == [(9000, 1.0)]


def test_leaks_of_many_items(spark):
    """More items than the latent space has directions: every stretch that shares enough words is found, by brute force."""
    items = [(k, prose(20000 + k, 30) if k % 100 == 1 else " ".join(f"w{k}x{j}" for j in range(8 + k % 10))) for k in range(2000)]
    # around the copies stand words of other items, which are frequent and take the directions
    usual = np.array([w for _, t in items[1::100] for w in t.split()])
    r = np.random.default_rng(0)
    around = lambda: " ".join(r.choice(usual, 50).tolist())
    planted = [(k, f"{around()} {t} {around()}") for k, t in items[::2]]
    docs = spark.createDataFrame(planted, "doc_id long, text string")
    out = decontam.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(k, k) for k, _ in planted} <= {(r["doc_id"], r["item_id"]) for r in out}
    # all pairs of 40 documents and all items whose verbatim share any stretch reaches
    block = decontam.Block.of(items, decontam.Limits().min_words)
    masks, verbatim = [decontam._masks(w) for w in block.words], decontam.Limits().verbatim
    want = set()
    for d, text in planted[:40]:
        held = block.vocabulary.find(decontam._of_text(text))
        for k, w in enumerate(block.words):
            if decontam.common_subsequence(*masks[k], held.tolist()) < verbatim * len(w):
                continue
            for width in decontam.WIDTHS:
                reach = max(len(w), width) // 2 + len(w) // 4 + 4
                middles = range(width // 2, len(held) + width, width // 3)
                if any(decontam.common_subsequence(*masks[k], held[max(m - reach, 0) : m + reach].tolist()) >= verbatim * len(w) for m in middles if m - width // 2 < len(held) - width + width // 3):
                    want.add((d, k))
    assert want == {(r["doc_id"], r["item_id"]) for r in out if r["lcs_ratio"] >= verbatim and r["doc_id"] in dict(planted[:40])}


def test_leak_windows_against_brute_force():
    """The windows passed on are all those whose common subsequence reaches the least share."""
    r = np.random.default_rng(3)
    terms = np.arange(30, dtype=np.int32)
    items = [r.integers(0, 30, n).astype(np.int32) for n in (1, 3, 5, 9, 16, 33, 60, 130)]
    block = decontam.Block(list(range(len(items))), items, items, decontam.Vocabulary(terms.astype(np.uint64)), [[w] for w in items])
    rows = [(n, np.sort(r.permutation(n)[: n // 2 + 1])) for n in (1, 4, 30, 90, 400)]
    rows = [(n, at, r.integers(0, 30, len(at)).astype(np.int32)) for n, at in rows]
    for n, at, held in rows:
        for w in items:  # copies with words lost
            if n > 2 * len(w) and len(at) > len(w):
                held[: len(w)] = np.where(r.random(len(w)) < 0.8, w, held[: len(w)])
    lists = [pa.array([x[k].tolist() for x in rows], pa.list_(pa.int32())) for k in (2, 1)]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array([x[0] for x in rows]), *lists], ["doc_id", "n", "terms", "places"])
    sizes, masks = np.array([len(w) for w in items]), [decontam._masks(w) for w in items]
    share = decontam.Limits().paraphrase
    enough = lambda k, words: decontam.common_subsequence(*masks[k], words) >= share * sizes[k]
    for df in (np.arange(30), np.zeros(30, np.int64)):
        rare = decontam.Rare.of(block, df, share)
        found = [(row, k, len(x), place) for row, k, place, x, around in decontam._windows(b, sizes, decontam.Often.of(block), rare) if enough(k, around.tolist())]
        want = []
        for row, (n, at, held) in enumerate(rows):
            for width in decontam.WIDTHS:
                for place in range(0, max(1, -(-(n - width) // (width // 3)) + 1) * (width // 3), width // 3):
                    for k, size in enumerate(sizes.tolist()):
                        reach = max(size, width) // 2 + size // 4 + 4
                        near = held[(at >= place + width // 2 - reach) & (at < place + width // 2 + reach)]
                        if enough(k, near.tolist()):
                            want.append((row, k, int(((at >= place) & (at < place + width)).sum()), place))
        assert want and sorted(found) == sorted(want)


def test_common_subsequence():
    r = np.random.default_rng(1)
    for _ in range(300):
        a, b = (r.integers(0, 5, r.integers(1, 12)) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
        assert decontam.common_subsequence(*decontam._masks(a), b.tolist()) == row[-1]


# --- tokens --------------------------------------------------------------------------------------------------------------


def test_tokens(odd, small):
    pieces = token_counts.pieces_of(token_counts.VOCABULARY)
    known = set(pieces)

    def greedy(word):
        s, n, i = token_counts.WORD_START + word, 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + 40), i, -1) if s[i:j] in known), 0)
            n, i = (n + 1, j) if j else (n + len(s[i].encode()), i + 1)
        return n

    for df in (odd, small):
        texts = Counter((r["doc_id"], r["text"]) for r in df.collect())
        want = Counter()
        for (i, t), k in texts.items():
            w = WORD.findall(t or "")
            want[i, len(w), sum(map(greedy, w))] += k
        assert Counter(tuple(r) for r in token_counts.count_tokens(df, pieces).collect()) == want
    assert token_counts.count_tokens(empty(odd), pieces).count() == 0
    with pytest.raises(ValueError, match="over the bound"):
        token_counts.count_tokens(odd, pieces, most_pieces=100)


def test_automaton_random():
    import random

    r = random.Random(1)
    for _ in range(200):
        v = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))}
        a = token_counts.Automaton(v, mark="")
        for _ in range(20):
            s, n, i = "".join(r.choice("abcd") for _ in range(r.randint(0, 14))), 0, 0
            while i < len(s):
                j = next((j for j in range(len(s), i, -1) if s[i:j] in v), i + 1)
                n, i = n + 1, j
            assert a.count(s) == n

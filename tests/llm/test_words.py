"""Spelling variants, merge-type pieces and importance resampling against brute force and the library's own pieces."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from quittance.llm import importance, piece_bpe, queries, spelling
from tests.llm.odd import SCHEMA, prose, rows

SMALL = "/root/testdata/sf0.001"
MODEL = path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


# --- spelling ---------------------------------------------------------------------------------------


def lower(s):
    return s.translate({k: k + 32 for k in range(65, 91)})


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(docs, every, least_length=7):
    n = Counter()
    for i, text in docs:
        for w in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least_length
    n = {w: k for w, k in n.items() if k >= 2}
    near = {w: [v for v in n if v != w and one_edit(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w, k in n.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, k, len(near[w]), n.get(form[w])))
    return sorted(out)


def texts_with_variants():
    r = random.Random(5)
    base = ["".join(r.choice("abdeglmnorstuäé") for _ in range(r.randint(7, 9))) for _ in range(25)]
    out = []
    for k in range(60):
        said = [r.choice(base[: 1 + k % 25]) for _ in range(400)]
        for at in range(0, 400, 40):
            w, j = said[at], r.randrange(7)
            said[at] = r.choice([w[:j] + w[j + 1 :], w[:j] + r.choice("abxé") + w[j:], w[:j] + r.choice("abxé") + w[j + 1 :]])
        out.append((k, " ".join(w.upper() if r.random() < 0.1 else w for w in said)))
    # a chain of forms (each ten times as frequent as the one before), two forms of equal count, edits in runs of one letter
    chain = ["bananaaa", "bananaa", "banana1"]
    out += [(100, " ".join(["kettlexx"] * 2 + ["kettlex"] * 40 + ["kettles"] * 400 + ["meadowsa"] * 30 + ["meadowsb"] * 30 + ["meadowsc"] * 3 + ["zzzzzzzz"] * 40 + ["zzzzzzz"] * 4)), (101, " ".join(chain * 3)), (None, "kettlexx kettlexx"), (102, None), (103, ""), (103, "")]
    return out


@pytest.mark.parametrize("every", [None, 31, 3])
def test_variants_equal_brute_force(spark, every):
    docs = texts_with_variants()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    out = sorted(map(tuple, spelling.variants(df, every=every, shard_bytes=700, round_bytes=2000).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert out == variants(docs, every)
    assert any(form and root != form for _, form, root, *_ in out), "a chain of forms"


def test_one_round_or_many(spark):
    df = spark.createDataFrame(texts_with_variants(), "doc_id long, text string")
    words = spelling.vocabulary(df, least_length=5)
    whole, parts = (sorted(map(tuple, spelling.neighbours(words, *size).collect())) for size in ((1 << 20, 4 << 20), (1, 1)))
    assert whole == parts and len(whole) > 20
    assert spelling.shards(words, 1).count() == words.count()


def test_variants_on_odd_rows(spark, odd):
    out = sorted(map(tuple, spelling.variants(odd, every=31).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert out == variants([(r[0], r[1]) for r in rows()], 31)
    assert spelling.variants(odd.filter("false")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "a bb ccc")], "doc_id long, text string")).count() == 0


def test_trie_walk_equals_all_pairs():
    r = random.Random(3)
    for _ in range(100):
        words = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 60))})
        counted = [(w, r.randint(1, 9)) for w in words]
        trie = spelling.Trie(spelling.unpack(spelling.pack(words, [n for _, n in counted])))
        for w in [*words, *("".join(r.choice("abé") for _ in range(r.randint(1, 8))) for _ in range(20))]:
            assert sorted(trie.near(w)) == [(v, n) for v, n in counted if v != w and one_edit(v, w)]


def test_very_long_words_are_walked_once():
    long = "ab" * 300_000
    trie = spelling.Trie([(long, 3), (long + "a", 2), (long + "b", 5)])
    assert sorted(trie.near(long)) == [(long + "a", 2), (long + "b", 5)]
    trie = spelling.Trie([("x" * k, k) for k in range(1, 2000)])
    assert trie.near("x" * 1000) == [("x" * 999, 999), ("x" * 1001, 1001)]


# --- pieces -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return piece_bpe.read_model(MODEL)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def hard_texts(model):
    r = random.Random(1)
    signs = "ab cdéÀ▁ \n\t.,1290中文字🙂́\u0000<s></s><0x0A>ﬁthe   "
    normal = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k == piece_bpe.NORMAL]
    out = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(2000)]
    out += ["".join(r.choice(normal) for _ in range(r.randint(1, 8))) for _ in range(2000)]
    return [*out, "", " ", "  ", "▁", "\n", " a", "a ", "x" * 5000, "ab" * 3000, "the" * 3000, " " * 5000, prose(3, 500)]


def test_pieces_equal_the_library(model, library):
    encoder, decoder, texts = piece_bpe.Encoder(model), piece_bpe.Decoder(model), hard_texts(model)
    want = library.encode(texts, num_threads=1)
    got = [np.frombuffer(encoder.encode(t), np.int32).tolist() for t in texts]
    assert got == want
    assert decoder.decode(pa.array(want, pa.list_(pa.int32()))) == [library.decode(x) for x in want]


def test_any_ids_decode_as_the_library_does(model, library):
    r, decoder = random.Random(2), piece_bpe.Decoder(model)
    ids = [[r.randrange(32000) if r.random() < 0.4 else r.randrange(300) for _ in range(r.randint(0, 12))] for _ in range(3000)]
    ids += [[1, 278], [259, 1], [2], [0], [35], [3 + 0xE2, 3 + 0x82], [3 + 0xE2, 3 + 0x82, 3 + 0xAC, 278]]
    assert decoder.decode(pa.array(ids, pa.list_(pa.int32()))) == [library.decode(x) for x in ids]
    some = pa.array([None, *ids[:5], None], pa.list_(pa.int32()))
    assert decoder.decode(some.slice(1)) == [*(library.decode(x) for x in ids[:5]), None]


def test_backtracking_equals_plain_merging(model):
    encoder, r = piece_bpe.Encoder(model), random.Random(4)
    for n in (3, 8, 20, 60):
        for _ in range(150):
            text = "".join(r.choice("thequickn▁aeiou中\n") for _ in range(n))
            assert encoder.pieces(text) == encoder.merged(text)


def test_small_caches_change_nothing(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CACHE", 3)
    encoder, texts = piece_bpe.Encoder(model), [prose(k, 40) for k in range(20)]
    assert [np.frombuffer(encoder.encode(t), np.int32).tolist() for t in texts] == library.encode(texts)
    assert len(encoder.known) <= 3 and len(encoder.fit) <= 3


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    m.trainer_spec.byte_fallback = False
    m.pieces[300].type = piece_bpe.USER
    (tmp_path / "other.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="without byte fallback and with user-defined"):
        piece_bpe.read_model(str(tmp_path / "other.model"))


def test_piece_query_equals_the_library(spark, library, tmp_path, odd, monkeypatch):
    monkeypatch.setattr(piece_bpe, "BATCH_IDS", 200)
    odd.unionByName(spark.createDataFrame([(50, "no end " * 200_000, None, None, 0, 0, True, "", 0)], SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), SMALL):
        docs = [(r[0], r[1] or "") for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = [(i, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))) for (i, _), ids in zip(docs, library.encode([t for _, t in docs]), strict=True)]
        out = [tuple(r) for r in queries.op12_piece_bpe(spark, folder).collect()]
        assert sorted(out, key=str) == sorted(want, key=str)
    assert piece_bpe.encode(odd.filter("false"), piece_bpe.read_model(MODEL)).count() == 0


# --- importance -------------------------------------------------------------------------------------


def resampled(docs, target, orders, buckets, percent=10, least=20, seed="2024"):
    def grams(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in orders for k in range(len(w) - n + 1)]

    have, want = Counter(b for _, t in docs for b in grams(t)[1]), Counter(b for t in target for b in grams(t)[1])
    s_all, t_all = sum(have.values()), sum(want.values())
    out = []
    for i, text in docs:
        n, g = grams(text)
        weight = sum(math.floor(1000 * math.log((want[b] + 1.0) * (s_all + float(buckets)) / ((have[b] + 1.0) * (t_all + float(buckets))))) for b in g)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for k, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("orders", "buckets"), [((1,), 10_000), ((1, 2), 500), ((2, 3), 97)])
def test_resampling_equals_brute_force(spark, odd, orders, buckets):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    target_texts = [r[0] for r in target.select("text").collect()]
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    for df in (odd, small):
        docs = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
        out = [tuple(r) for r in importance.resample(df, target, orders=orders, buckets=buckets, percent=30).collect()]
        assert sorted(out, key=str) == resampled(docs, target_texts, orders, buckets, percent=30)


def test_short_blocks_and_shuffled_gains_change_nothing(spark, odd, monkeypatch):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = sorted(map(str, importance.resample(odd, target, orders=(1, 2, 3)).collect()))
    parts = importance.features(odd, (1, 2, 3), block=3).groupBy("doc", "tie", "bucket").agg(*[F.sum(c) for c in ("times", "words", "rows")])
    whole = importance.features(odd, (1, 2, 3)).groupBy("doc", "tie", "bucket").agg(*[F.sum(c) for c in ("times", "words", "rows")])
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect()))
    monkeypatch.setattr(importance, "small", lambda df, row_bytes: False)
    assert sorted(map(str, importance.resample(odd, target, orders=(1, 2, 3)).collect())) == plain


def test_draw_returns_whole_rows(spark, odd):
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    out = importance.draw(odd, target, percent=50)
    assert out.columns == odd.columns and 0 < out.count() < odd.count()
    assert importance.resample(odd.filter("false"), target).count() == 0
    assert importance.resample(odd, target.filter("false")).filter("rank is not null").count() > 0
    with pytest.raises(ValueError, match="orders"):
        importance.features(odd, (0,))

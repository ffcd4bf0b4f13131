"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gives its set of distinct five-word shingles (64-bit hashes), a
   128-bit name of the set, 125 minima and from them 25 band keys.  Texts with the
   same set are one class from here on.
2. Star round: in each bucket of a band every class is a candidate with the
   bucket's smallest, so candidates grow with the members, not with their pairs.
   Their signatures are compared batch by batch; a pair goes as soon as the
   posterior probability that its similarity reaches the threshold falls below
   ``miss``.  Survivors are verified on full sets built from whole texts, grouped by
   hub, hubs with many partners split by salt.
3. Links so far are joined to components.  In buckets that still hold more than one
   component, members of different components are compared, in blocks of bounded
   size, each member of a smaller component with all others and the largest one's
   members with those only: first by an exact bound (in an order that puts rare shingles first, linked
   sets meet within a prefix, so an edited copy that misses its original meets only
   copies with an edit of its own), then by signature batches, last on full sets.  So
   no candidate link between different components is skipped, and members of one
   component are never paired.
4. Components are closed again and handed to all documents.

A pair at the threshold shares no bucket with probability (1 - t**5)**25: 4e-7 at
0.85 and 5e-5 at 0.8.

Cases: null text is empty; texts without words have an empty set and are linked
with nothing; texts of fewer than five words are one shingle; rows with a null
doc_id are returned unlinked and kept; rows that share a doc_id are one document
and kept or dropped together; ties go to the smallest doc_id; a very long text is one
set in memory; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.llm import bytes_kernel as bk
from quittance.llm.common import join_small, save
from quittance.llm.components import connected

WIDTH, BANDS, ROWS = 5, 25, 5
HASHES = BANDS * ROWS
STEP = 25
BLOCK = 1024
HUB = 256
COUNTERS = 20
_seeds = np.random.Generator(np.random.PCG64(77))
_XOR = _seeds.integers(0, 2**32, HASHES, dtype=np.uint32)
_MUL = _seeds.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _seeds.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * bk.U(2) + bk.U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row of a chunk."""
    data = bk.LOWER[data]
    starts, ends = bk.word_bounds(data, offsets)
    words = bk.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    at = np.searchsorted(starts, offsets)
    n = len(words) - WIDTH + 1
    if n > 0:
        grams = words[:n] * bk.PLACE[0]
        for k in range(1, WIDTH):
            grams = grams + words[k : n + k] * bk.PLACE[k]
        grams = bk.mixed(grams)
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= WIDTH:
            g = np.sort(grams[lo : hi - WIDTH + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif hi > lo:
            out.append(bk.mixed(np.array([sum(int(w) * int(p) for w, p in zip(words[lo:hi], bk.PLACE[8:], strict=False)) % 2**64], np.uint64) + bk.U(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """The HASHES minima of a set, 32 bits each."""
    s = (shingles >> bk.U(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), 1024):
        h = s[k : k + 1024, None] ^ _XOR
        h *= _MUL
        np.minimum(low, h.min(0), out=low)
    return low


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, a, b, bands, sig): set size, the set's name, band keys, low byte of each minimum."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in bk.chunks(batch.column("text")):
                sets = shingle_sets(data, offsets)
                n = np.array([len(s) for s in sets], np.int64)
                name = np.array([[s.sum(dtype=np.uint64), bk.mixed(s ^ bk.PLACE[20]).sum(dtype=np.uint64)] for s in sets], np.uint64).view(np.int64)
                low = np.array([minima(s) if len(s) else np.zeros(HASHES, np.uint32) for s in sets], np.uint32)
                keys = bk.mixed((low.reshape(-1, BANDS, ROWS) * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                some = n > 0
                places = np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32)
                sig = (low ^ (low >> np.uint32(16)) ^ (low >> np.uint32(8))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array(name[:, 0]), pa.array(name[:, 1]),
                     pa.ListArray.from_arrays(pa.array(places), pa.array(keys[some].ravel())), pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "n", "a", "b", "bands", "sig"],
                )

    return d.mapInArrow(bk.tidied(run), "doc_id long, n long, a long, b long, bands array<long>, sig binary")


def fewest_matches(threshold: float, miss: float) -> list[int]:
    """For each number of compared places, a multiple of STEP, the fewest equal ones that keep a pair.

    With a uniform prior the posterior of the rate of equal bytes after m of k is
    Beta(m + 1, k - m + 1), whose tail above r is a binomial sum.  r is the rate at
    the threshold, as unequal minima share a byte once in 256.
    """
    r = threshold + (1 - threshold) / 256
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(k + 1, m) * r**m * (1 - r) ** (k + 1 - m)
        out.append(m)
    return out


def survivors(left: np.ndarray, right: np.ndarray, limits: list[int]) -> np.ndarray:
    """Which pairs of signature rows remain after the sequential comparison."""
    alive = np.arange(len(left))
    equal = np.zeros(len(left), np.int32)
    for i, least in enumerate(limits):
        cut = slice(i * STEP, (i + 1) * STEP)
        equal[alive] += (left[alive, cut] == right[alive, cut]).sum(1)
        alive = alive[equal[alive] >= least]
    return alive


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _star_candidates(pairs: DataFrame, reps: DataFrame, percent: int, miss: float) -> DataFrame:
    """pairs(u, v) that survive the size bound and the sequential comparison."""
    one = reps.select(F.col("rep").alias("u"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    two = reps.select(F.col("rep").alias("v"), F.col("n").alias("nv"), F.col("sig").alias("sv"))
    both = pairs.join(two, "v").filter(F.col("sv").isNotNull()).join(one, "u").filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    limits = fewest_matches(percent / 100, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = pa.array(survivors(_matrix(b.column("su")), _matrix(b.column("sv")), limits))
                yield pa.RecordBatch.from_arrays([b.column("u").take(keep), b.column("v").take(keep)], ["u", "v"])

    return both.select("u", "v", "su", "sv").mapInArrow(bk.tidied(run), "u long, v long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v), written, whose full sets reach the threshold.

    A hub u stands once before its partners in a sorted stream; hubs of more than
    HUB partners are split by salt into as many streams.
    """
    crowd = pairs.groupBy("u").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    dealt = save(pairs.join(crowd, "u").withColumn("salt", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).select("u", "v", "salt"), "near-pairs")
    hubs = save(dealt.select("u", "salt").distinct(), "near-hubs")
    partners = join_small(docs.select(F.col("doc_id").alias("v"), "text"), dealt, "v", "inner", 40).select("u", "salt", F.lit(1).alias("side"), "v", "text")
    centres = join_small(docs.select(F.col("doc_id").alias("u"), "text"), hubs, "u", "inner", 32).select("u", "salt", F.lit(0).alias("side"), F.col("u").alias("v"), "text")
    stream = centres.unionByName(partners).repartition("u", "salt").sortWithinPartitions("u", "salt", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for b in batches:
            us, vs, sides = (b.column(c).to_pylist() for c in ("u", "v", "side"))
            found: tuple[list, list] = ([], [])
            for lo, _, data, offsets in bk.chunks(b.column("text")):
                for k, s in enumerate(shingle_sets(data, offsets), lo):
                    if sides[k] == 0:
                        if now != us[k] or len(hub) and not np.array_equal(hub[-1], s):
                            hub = [*(hub if now == us[k] else []), s]
                        now = us[k]
                    elif any(_alike(h, s, percent) for h in hub):
                        found[0].append(us[k])
                        found[1].append(vs[k])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

    return stream.mapInArrow(bk.tidied(run), "u long, v long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _open_buckets(labelled: DataFrame) -> DataFrame:
    """(key, heavy, heavy_n, light_n) of buckets of labelled(key, rep, label) with several labels: the largest label and the sizes of both sides."""
    sides = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    top = sides.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("labels")).filter("labels > 1")
    return top.select("key", F.col("top.label").alias("heavy"), F.col("top.n").alias("heavy_n"), (F.col("size") - F.col("top.n")).alias("light_n"))


def _cells(light: Column, light_blocks: Column, heavy_blocks: Column, own: Column) -> Column:
    """The cells (kind, i, j, side) that a member of block own takes part in.

    Kind 0 pairs blocks of the light side, kind 1 a light block i with a heavy block j.
    A heavy member is sent once per light block, so a lone outsider costs one copy.
    """

    def cell(kind: int, i, j, side) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))

    upto = lambda n: F.sequence(F.lit(0), n - 1)
    within = F.transform(upto(light_blocks), lambda k: cell(0, F.least(own, k), F.greatest(own, k), own > k))
    across = F.transform(upto(heavy_blocks), lambda h: cell(1, own, h, F.lit(0)))
    return F.when(light, F.concat(within, across)).otherwise(F.transform(upto(light_blocks), lambda i: cell(1, i, own, F.lit(1))))


def _cross_candidates(mixed: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs of different components within a bucket, from mixed(key, heavy, heavy_n, light_n, rep, label, n, sig, prefix).

    A bucket is dealt to tasks as pairs of blocks of about BLOCK members.
    """
    light = F.col("label") != F.col("heavy")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.when(light, blocks("light_n")).otherwise(blocks("heavy_n"))).cast("int")
    dealt = mixed.withColumn("cell", F.explode(_cells(light, blocks("light_n"), blocks("heavy_n"), own)))
    dealt = dealt.select("key", "cell.kind", "cell.i", "cell.j", "cell.side", "rep", "label", "n", "sig", "prefix")
    dealt = dealt.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j", "side")
    limits = fewest_matches(percent / 100, miss)

    def compare(rows: list[tuple]) -> tuple[list, list]:
        whole = rows[0][1] == 0 and rows[0][2] == rows[0][3]  # a block with itself
        side, rep, label, n = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6, 7))
        sig = np.frombuffer(b"".join(r[8] for r in rows), np.uint8).reshape(-1, HASHES)
        held = [np.frombuffer(r[9], np.uint32) for r in rows]
        size = np.array([len(x) for x in held])
        ids = np.concatenate(held)
        row = np.repeat(np.arange(len(rows)), size)
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        order = np.argsort(ids, kind="stable")
        ids, row, rank = ids[order], row[order], rank[order]

        def meets(x: int) -> np.ndarray:
            """Rows that meet x early enough in both prefixes for the overlap that the threshold asks."""
            lo, hi = np.searchsorted(ids, held[x], "left"), np.searchsorted(ids, held[x], "right")
            at = np.concatenate([np.arange(i, j) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)])
            mine = np.repeat(np.arange(len(lo)), hi - lo)
            y = row[at]
            asked = -(-percent * (n[x] + n[y]) // (100 + percent))
            hit = np.zeros(len(rows), bool)
            hit[y[(mine <= n[x] - asked) & (rank[at] <= n[y] - asked)]] = True
            return hit

        found: tuple[list, list] = ([], [])
        right = np.flatnonzero((side == 1) | whole)
        for x in np.flatnonzero(side == 0):
            y = right[(label[right] != label[x]) & ((rep[right] > rep[x]) | (not whole))]
            if len(y):
                y = y[meets(x)[y]]
            if len(y):
                y = y[survivors(np.broadcast_to(sig[x], (len(y), HASHES)), sig[y], limits)]
                found[0].extend(np.minimum(rep[y], rep[x]).tolist())
                found[1].extend(np.maximum(rep[y], rep[x]).tolist())
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:4] != row[:4]:
                    yield _pairs(compare(group))
                    group = []
                group.append(row)
        if group:
            yield _pairs(compare(group))

    return dealt.mapInArrow(bk.tidied(run), "u long, v long").distinct()


def _own_sets(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, set) of the rows of a batch (rep, a, text) whose text is the one that the name a stands for."""
    named = b.column("a").to_numpy()
    for lo, _, data, offsets in bk.chunks(b.column("text")):
        for k, s in enumerate(shingle_sets(data, offsets), lo):
            if len(s) and s.sum(dtype=np.uint64).view(np.int64) == named[k]:
                yield k, s


def _place(s: np.ndarray) -> np.ndarray:
    return (s >> bk.U(64 - COUNTERS)).astype(np.int64)


def _rarity(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall on each of 2**COUNTERS places: rare shingles fall on low counts.

    The table's size is fixed; a fuller table orders worse but never wrongly.
    """
    block = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTERS, np.int32)
        for b in batches:
            for _, s in _own_sets(b):
                np.add.at(total, _place(s), 1)
        for k in range(0, len(total), block):
            if total[k : k + block].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total[k : k + block].tobytes()])], ["first", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("first").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part, np.int32).astype(np.int64)
                total[k] = total[k] + x if k in total else x
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes()])], ["first", "part"])

    out = np.zeros(1 << COUNTERS, np.int32)
    summed = texts.mapInArrow(bk.tidied(count), "first long, part binary").repartition("first").mapInArrow(bk.tidied(add), "first long, part binary")
    for r in summed.toLocalIterator():  # one table of fixed size
        out[r["first"] : r["first"] + block] = np.frombuffer(r["part"], np.int32)
    return out


def _prefixes(nodes: DataFrame, body: DataFrame, percent: int) -> DataFrame:
    """(rep, a, prefix) of nodes(rep, a): the rarest shingles, so many that a linked set must hold one of them."""
    texts = join_small(body.select(F.col("doc_id").alias("rep"), "text"), nodes, "rep", "inner", 32).select("rep", "a", "text")
    rare = texts.sparkSession.sparkContext.broadcast(_rarity(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for k, s in _own_sets(b):
                n = len(s) - (-(-percent * len(s) // 100)) + 1
                order = np.lexsort((s, rare.value[_place(s)]))[:n]
                rows.append(k)
                out.append(s[order].astype(np.uint32).tobytes())  # low halves: a false meeting only costs a comparison
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rep").take(at), b.column("a").take(at), pa.array(out, pa.binary())], ["rep", "a", "prefix"])

    return texts.mapInArrow(bk.tidied(run), "rep long, a long, prefix binary").dropDuplicates(["rep", "a"])


def _pairs(found: tuple[list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; kept is doc_id = component_id."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sig = save(signatures(docs, doc_id, text), "near-signatures")
    usable = sig.filter("n > 0 and doc_id is not null")
    classes = save(usable.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")), "near-classes")
    picked = classes.select(F.col("rep").alias("doc_id"), "a", "b")
    reps = save(usable.join(picked, ["doc_id", "a", "b"], "left_semi").select(F.col("doc_id").alias("rep"), "a", "n", "bands", "sig"), "near-reps")

    rows = reps.select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot < last")
    live = save(rows.join(buckets.select("key", "pivot"), "key"), "near-buckets")
    star = live.filter("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct()
    star = save(_star_candidates(star, reps, percent, miss), "near-star")
    links = save(_verified(star, body, percent), "near-links")

    first = save(connected(links), "near-components").withColumnRenamed("node", "rep")
    labelled = save(live.join(first, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label")), "near-labelled")
    mixed = save(labelled.join(_open_buckets(labelled), "key"), "near-open")
    nodes = save(reps.select("rep", "a").join(mixed.select("rep").distinct(), "rep", "left_semi"), "near-nodes")
    prefixes = save(_prefixes(nodes, body, percent), "near-prefixes")
    facts = reps.select("rep", "a", "n", "sig").join(prefixes, ["rep", "a"])
    mixed = mixed.join(facts.drop("a"), "rep").select("key", "heavy", "heavy_n", "light_n", "rep", "label", "n", "sig", "prefix")
    cross = save(_cross_candidates(mixed, percent, miss), "near-cross")
    more = save(_verified(cross, body, percent), "near-links")
    named = first.select(F.col("component").alias("u"), F.col("rep").alias("v"))
    final = save(connected(named.unionByName(more)), "near-components")

    moved = classes.join(final, classes["rep"] == final["node"], "left").select("a", "b", "n", F.coalesce("component", "rep").alias("component"), "times", "rep")
    moved = save(moved.filter("times > 1 or component <> rep").select("a", "b", "n", "component"), "near-moved")
    out = join_small(sig.select("doc_id", "n", "a", "b"), moved, ["a", "b", "n"], "left", 48)
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def near_dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group one document stays, the one with the smallest doc_id.

    Of rows with equal doc_id and text one stays; rows with a null doc_id, null and empty
    texts stay; an empty table stays empty; columns stay those of docs.
    """
    gone = save(near_duplicates(docs).filter("not kept").select("doc_id").distinct(), "near-dropped")
    left = join_small(docs, gone, "doc_id", "left_anti", 24)
    again = save(docs.groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1 and doc_id is not null").select("doc_id"), "near-repeated")
    if not again.head(1):
        return left
    rest = join_small(left, again, "doc_id", "left_anti", 24)
    return rest.unionByName(join_small(left, again, "doc_id", "left_semi", 24).dropDuplicates(["doc_id", "text"]))

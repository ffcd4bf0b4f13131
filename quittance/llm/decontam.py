"""Benchmark decontamination by latent semantic retrieval.

The benchmark is a stated query set.  It is taken as one block, or as several where it has
more than ``terms`` different words or WORDS words, which bounds what a task and the
driver hold of it.  For a block:

1. One pass over whole texts keeps, per document, the words that the block knows
   (term and place): the postings.  All later steps read these.
2. Document frequencies of terms over all passages (PASSAGE words each) give TF-IDF
   weights, smoothed and never zero, so items of frequent words can be found too; a
   word the block lacks counts in a passage's length like the passage's known ones.
3. Randomised SVD of the passages' matrix A together with the items' passages: the
   sketch Z = At (A W) is summed up over partitions, and Z (Wt Z)^-1 Zt, whose
   factors the driver decomposes, stands for At A.  Its leading singular vectors are
   the latent space.  The driver holds terms x sketch numbers, bounded by the block.
4. Sliding passages of two widths are projected to the latent space, as sums of blocks of
   words, and held against all items' passages at once: those whose cosine reaches
   ``cosine`` are candidates.  Verbatim copies have a bound of their own beside it, exact
   for any rank: the stretch around a passage must hold some of the item's rarest
   places, then enough of its places at all, to share what makes a verbatim copy.
5. Candidates are checked by the longest common subsequence of words between item
   and stretch.  A verbatim share of the item is a leak by itself.  Of latent candidates a
   smaller share is one if most of the words in common stand in the item's order, more than
   in a shuffled text of them, and some of its answer (its last sentence) does: a
   paraphrase has other words, but the order of those it keeps, and the answer.  Sentences
   in another order are compared one by one, and must then share more.
6. Items of fewer than ``min_words`` words say too little for a share: they are leaks
   where all their words follow one another in the text, and nowhere else.

Cases: null or empty texts and items without words match nothing; an item of one word
matches every text with that word; a null doc_id or item_id is carried through;
repeated rows are reported once each; ties between passages go to the larger cosine,
then answer, then place; a very long text is searched as a whole, 48 words a passage; extra columns are not read;
an empty table of documents or an empty benchmark gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm import bytes_kernel as bk
from quittance.llm.common import drop, save, small

PASSAGE, WIDTHS = 48, (24, 48)
RANK, EXTRA = 96, 16
#: Different words, and words, of a block of the benchmark: a sketch takes TERMS * 112 * 4 bytes.
TERMS, WORDS = 1 << 17, 1 << 21
ROWS, HITS = 256, 1 << 20  # rows, and occurrences of rare words, looked at together
CHUNK = 1 << 13  # passages, or blocks of words, whose vectors are held together
SCHEMA = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_ratio double, place long"
#: The same with a hash of the text, which tells rows apart whose doc_id is null or repeated.
ROW_SCHEMA = "doc_id long, text_hash long, item_id long, cosine double, lcs_ratio double, answer_ratio double, place long"


@dataclass(frozen=True)
class Limits:
    cosine: float = 0.65
    verbatim: float = 0.75
    paraphrase: float = 0.36
    least_order: int = 11
    in_order: float = 0.6
    reordered: float = 0.7
    reordered_answer: float = 0.6
    answer: float = 0.2
    min_words: int = 5

    def reworded(self, n: int, both: int, order: int) -> bool:
        """Whether a text that has both of an item's n words, order of them in its order, says the item in other words.

        A shuffled text of the words has them all, but no more than about twice their root in order;
        a few words are in order by chance, so there must be least_order, or a verbatim share.
        """
        return order >= max(self.paraphrase * n, min(self.least_order, self.verbatim * n)) and order >= max(self.in_order * both, 2 * both**0.5)


#: Bytes that part words: white space and ASCII marks.
_PART = bk.SPACE.copy()
_PART[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk, case folded for ASCII and Latin-1, and where each row's begin."""
    data = bk.LOWER[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        data[1:][capital] += 0x20
    clean = np.where(_PART[data], np.uint8(32), data)
    starts, ends = bk.word_bounds(clean, offsets)
    hashes = bk.span_hashes(clean, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def _of_text(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]))[0]


class Vocabulary:
    """Sorted term hashes with a table over their leading bits."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.bits = max(8, int(len(terms)).bit_length() + 3)
        self.table = np.searchsorted(terms, np.arange(1 << self.bits, dtype=np.uint64) << bk.U(64 - self.bits))
        ends = np.append(self.table[1:], len(terms))
        self.deepest = int((ends - self.table).max()) if len(terms) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The term of each hash, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.terms):
            return out
        at = self.table[(h >> bk.U(64 - self.bits)).astype(np.int64)]
        for k in range(self.deepest):
            i = np.minimum(at + k, len(self.terms) - 1)
            hit = self.terms[i] == h
            out[hit] = i[hit]
        return out


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n", text.strip()) if x]


@dataclass
class Block:
    """A block of the benchmark: term ids of each item, of its answer and of its sentences, and its vocabulary."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: Vocabulary
    parts: list[list[np.ndarray]]
    brief: list[tuple[int | None, np.ndarray]] = field(default_factory=list)  # items below min_words

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], min_words: int) -> Block:
        hashed = [(i, _of_text(t or ""), [_of_text(x) for x in sentences(t or "")] or [np.zeros(0, np.uint64)]) for i, t in items]
        hashed = [x for x in hashed if len(x[1])]
        v = Vocabulary(np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[1] for x in hashed)])))
        long = [x for x in hashed if len(x[1]) >= min_words]
        brief = [(i, v.find(w)) for i, w, _ in hashed if len(w) < min_words]
        parts = [[v.find(x) for x in said] for _, _, said in long]
        return cls([x[0] for x in long], [v.find(x[1]) for x in long], [x[-1] for x in parts], v, parts, brief)

    def passages(self) -> list[tuple[int, np.ndarray]]:
        """(item, terms) of the items' own passages of at most PASSAGE words."""
        out = []
        for k, w in enumerate(self.words):
            for a in range(0, max(1, len(w) - PASSAGE // 2), PASSAGE // 2) if len(w) > PASSAGE else [0]:
                out.append((k, w[a : a + PASSAGE]))
        return out


def blocks_of(benchmark: DataFrame, min_words: int, terms: int = TERMS, words: int = WORDS) -> Iterator[Block]:
    """benchmark(item_id, text) in order, cut where a block would have more than terms different words or words words."""
    held: list[tuple[int | None, str | None]] = []
    seen: set[int] = set()
    size = 0
    for r in benchmark.orderBy("item_id", "text").toLocalIterator():
        own = _of_text(r["text"] or "").tolist()
        if held and (len(seen) + len(set(own) - seen) > terms or size + len(own) > words):
            yield Block.of(held, min_words)
            held, seen, size = [], set(), 0
        held.append((r["item_id"], r["text"]))
        seen.update(own)
        size += len(own)
    if held:
        yield Block.of(held, min_words)


def postings(docs: DataFrame, block, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, n, terms, places): known words of each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(block.value.vocabulary.terms)
        for b in batches:
            for lo, hi, data, offsets in bk.chunks(b.column("text")):
                h, at = word_hashes(data, offsets)
                term = v.find(h)
                known = np.flatnonzero(term >= 0)
                row = np.searchsorted(at, known, "right") - 1
                edge = np.searchsorted(known, at).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(edge), pa.array(x.astype(np.int32))) for x in (term[known], known - at[row])]
                keys = [b.column(c).slice(lo, hi - lo) for c in ("doc_id", "text_hash")]
                out = pa.RecordBatch.from_arrays([*keys, pa.array(np.diff(at)), *lists], ["doc_id", "text_hash", "n", "terms", "places"])
                yield out.filter(pa.array(np.diff(edge) > 0))

    said = F.col(text).cast("string")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(said).alias("text_hash"), said.alias("text"))
    return d.mapInArrow(bk.tidied(run), "doc_id long, text_hash long, n long, terms array<int>, places array<int>")


def gathered(posted: DataFrame) -> DataFrame:
    """posted in at most a few partitions a core, so that what each task sums up beforehand is sent that often only."""
    return posted.coalesce(max(1, 3 * posted.sparkSession.sparkContext.defaultParallelism))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row starts, terms, places, words of each row) of a batch of postings."""
    lists = b.column("terms")
    ends = lists.offsets.to_numpy()
    base = ends[0] if len(ends) else 0
    terms = lists.values.to_numpy()[base : ends[-1]] if len(ends) else np.zeros(0, np.int32)
    lists = b.column("places")
    o = lists.offsets.to_numpy()
    places = lists.values.to_numpy()[o[0] : o[-1]] if len(o) else np.zeros(0, np.int32)
    return ends - base, terms, places, b.column("n").to_numpy()


def _cells(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, term) of the distinct cells of a batch's passages, sorted by passage, and the passages' word counts."""
    edge, terms, places, n = _flat(b)
    count = (n + PASSAGE - 1) // PASSAGE
    first = np.concatenate([[0], np.cumsum(count)])
    passage = np.repeat(first[:-1], np.diff(edge)) + places // PASSAGE
    cell = np.unique(passage.astype(np.int64) << 32 | terms)
    words = np.full(int(first[-1]), PASSAGE, np.int64)
    words[first[1:][count > 0] - 1] = (n - (count - 1) * PASSAGE)[count > 0]
    return cell >> 32, (cell & 0xFFFFFFFF).astype(np.int64), words


def frequencies(posted: DataFrame, n_terms: int) -> np.ndarray:
    """Passages that hold each term; sums of per-partition counts, collected once per term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 512):
                total += np.bincount(_cells(b.slice(k, 512))[1], minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in gathered(posted).mapInArrow(bk.tidied(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r["term"]] = r["df"]
    return out


def _random(n_terms: int, width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(5)).standard_normal((n_terms, width), dtype=np.float32)


def _row_sums(rows: np.ndarray, at: np.ndarray, head: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows[at], times weight, over the short runs that begin at head: a step for each place in a run, for all runs at once."""
    size = np.diff(np.append(head, len(at)))
    order = np.argsort(-size, kind="stable")  # runs that go on are always the first ones
    begin, count = head[order], np.searchsorted(np.sort(-size), -np.arange(1, int(size.max(initial=0)) + 1), "right")
    out = np.zeros((len(head), rows.shape[1]), np.float32)
    for k, n in enumerate(count.tolist()):
        i = begin[:n] + k
        out[:n] += rows[at[i]] if weight is None else rows[at[i]] * weight[i, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def _add_sketch(z: np.ndarray, passage: np.ndarray, term: np.ndarray, words: np.ndarray, idf: np.ndarray, w: np.ndarray, scale: float = 1.0) -> None:
    """z += At (A w) over the cells of a batch; rows of A have unit length, each unknown word as long as the row's known ones on average."""
    if not len(term):
        return
    head = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    size = np.diff(np.append(head, len(term)))
    weight = idf[term]
    known = np.add.reduceat(weight**2, head)
    length = np.sqrt(known * words[passage[head]] / size)
    weight = (weight / np.repeat(length, size)).astype(np.float32)
    y = _row_sums(w, term, head, weight) * np.float32(scale)
    order = np.argsort(term, kind="stable")
    t = term[order]
    at = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    z[t[at]] += np.add.reduceat(np.repeat(y, size, axis=0)[order] * weight[order][:, None], at, axis=0)


def latent_space(posted: DataFrame, block: Block, idf: np.ndarray, share: float) -> np.ndarray:
    """Terms x RANK: leading right singular vectors of the passages' TF-IDF matrix."""
    n, width = len(idf), RANK + EXTRA
    known = posted.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, w = np.zeros((n, width), np.float32), _random(n, width)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                _add_sketch(z, *_cells(b.slice(k, 128)), known.value, w)
        for k in range(0, n, 256):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([z[k : k + 256].tobytes()])], ["first", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, part in zip(b.column("first").to_pylist(), b.column("part").to_pylist(), strict=True):
                x = np.frombuffer(part, np.float32)
                total[k] = total[k] + x if k in total else x.astype(np.float64)
        for k, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x.astype(np.float32).tobytes()])], ["first", "part"])

    z = np.zeros((n, width), np.float32)
    summed = gathered(posted).mapInArrow(bk.tidied(run), "first long, part binary").repartition("first").mapInArrow(bk.tidied(add), "first long, part binary")
    for r in summed.toLocalIterator():  # terms x sketch numbers, bounded by the block
        z[r["first"] : r["first"] + 256] = np.frombuffer(r["part"], np.float32).reshape(-1, width)
    w = _random(n, width)
    own = np.zeros((n, width), np.float32)
    for _, terms in block.passages():
        cells = np.unique(terms).astype(np.int64)
        _add_sketch(own, np.zeros(len(cells), np.int64), cells, np.array([len(terms)]), idf, w)
    weight = max(1.0, np.abs(z).sum() / max(np.abs(own).sum(), 1e-9) * share)
    z += np.float32(weight) * own
    core = (w.T @ z).astype(float)
    core = (core + core.T) / 2
    value, vector = np.linalg.eigh(core)
    good = value > max(value.max(), 1e-12) * 1e-7
    factor = z @ (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    u, s, _ = np.linalg.svd(factor, full_matrices=False)
    return u[:, : min(RANK, int((s > 1e-6).sum()))].astype(np.float32)


def common_subsequence(pattern: dict[int, int], full: int, words: list[int]) -> int:
    """Length of the longest common subsequence; pattern has the bit mask of each term's places."""
    s = full
    for t in words:
        m = pattern.get(t)
        if m is not None:
            u = s & m
            s = ((s + u) | (s - u)) & full
    return full.bit_length() - s.bit_count() if full else 0


def _masks(terms: np.ndarray) -> tuple[dict[int, int], int]:
    out: dict[int, int] = {}
    for k, t in enumerate(terms.tolist()):
        out[t] = out.get(t, 0) | 1 << k
    return out, (1 << len(terms)) - 1


@dataclass
class Rare:
    """The rarest places of each item: a stretch that shares ``need`` places with an item holds ``some`` of these.

    An item of n words then misses at most n - need places, so among any n - need + some it has some.
    """

    need: np.ndarray
    some: np.ndarray
    items: np.ndarray  # of each entry, ascending
    terms: np.ndarray

    @classmethod
    def of(cls, block: Block, df: np.ndarray, paraphrase: float) -> Rare:
        size = np.array([len(w) for w in block.words], np.int64)
        need = np.maximum(np.ceil(size * paraphrase - 1e-9).astype(np.int64), 1)
        some = np.maximum(need // 4, 1)
        terms = [np.unique(w[np.argsort(df[w], kind="stable")[: len(w) - m + c]]) for w, m, c in zip(block.words, need, some, strict=True)]
        return cls(need, some, np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate([np.zeros(0, np.int32), *terms]))


@dataclass
class Often:
    """How often each term stands in each item, as sorted cells."""

    cells: np.ndarray
    counts: np.ndarray
    n_terms: int

    @classmethod
    def of(cls, block: Block) -> Often:
        n = max(len(block.vocabulary.terms), 1)
        all_ = [w.astype(np.int64) + k * n for k, w in enumerate(block.words)]
        return cls(*np.unique(np.concatenate([np.zeros(0, np.int64), *all_]), return_counts=True), n)

    def find(self, item: np.ndarray, term: np.ndarray) -> np.ndarray:
        if not len(self.cells):
            return np.zeros(len(item), np.int64)
        cell = item * self.n_terms + term
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        return np.where(self.cells[at] == cell, self.counts[at], 0)


@dataclass
class Brief:
    """Items of few words, by their number of words and a mix of their terms."""

    by_size: dict[int, tuple[np.ndarray, np.ndarray]]  # sorted mixes, and the item of each
    items: list[tuple[int | None, np.ndarray]]

    @classmethod
    def of(cls, block: Block) -> Brief:
        out = {}
        for n in {len(w) for _, w in block.brief}:
            own = np.array([k for k, (_, w) in enumerate(block.brief) if len(w) == n])
            mix = np.array([_mix([t[None] for t in block.brief[k][1].astype(np.uint64)])[0] for k in own], np.uint64)
            order = np.argsort(mix, kind="stable")
            out[n] = mix[order], own[order]
        return cls(out, block.brief)

    def find(self, b: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
        """(row, item, place) of the first place in each row where all words of an item follow one another."""
        edge, terms, places, _ = _flat(b)
        row = np.repeat(np.arange(b.num_rows), np.diff(edge))
        seen = set()
        for n, (mixes, own) in self.by_size.items():
            last = len(terms) - n + 1
            if last <= 0:
                continue
            joined = (row[n - 1 :] == row[:last]) & (places[n - 1 :] - places[:last] == n - 1)
            at = np.flatnonzero(joined)
            mix = _mix([terms[at + k].astype(np.uint64) for k in range(n)])
            lo, hi = np.searchsorted(mixes, mix, "left"), np.searchsorted(mixes, mix, "right")
            of, k = _ranges(lo, hi - lo)
            for i, item in zip(at[of].tolist(), own[k].tolist(), strict=True):
                if (row[i], item) not in seen and np.array_equal(terms[i : i + n], self.items[item][1]):
                    seen.add((row[i], item))
                    yield int(row[i]), item, int(places[i])


def _mix(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for k, c in enumerate(columns):
        out += bk.mixed(c + bk.U(1)) * bk.PLACE[k % len(bk.PLACE)]
    return out


def search(posted: DataFrame, block, idf: np.ndarray, df: np.ndarray, space: np.ndarray, limits: Limits) -> DataFrame:
    """Leaks of the block's items: the best checked passage of each document and item."""
    shared = posted.sparkSession.sparkContext.broadcast((idf, space, Rare.of(block.value, df, limits.verbatim)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, basis, rare = shared.value
        items = block.value
        rows = basis * weights[:, None].astype(np.float32)
        own = items.passages()
        asked = np.array([_unit(rows, np.unique(t)) for _, t in own], np.float32).reshape(len(own), rows.shape[1])
        asked_of = np.array([k for k, _ in own], np.int64)
        sizes, often, brief = np.array([len(w) for w in items.words], np.int64), Often.of(items), Brief.of(items)
        masks, answers = [_masks(w) for w in items.words], [_masks(w) for w in items.answers]
        parts, bags = [[_masks(x) for x in said] for said in items.parts], [Counter(w.tolist()) for w in items.words]
        below = np.nextafter(limits.verbatim, 0)  # sentences in another order are no verbatim copy
        for b in batches:
            found: dict[tuple, tuple] = {}
            ids, hashes = b.column("doc_id").to_pylist(), b.column("text_hash").to_pylist()
            out = [(ids[r], hashes[r], items.brief[k][0], 1.0, 1.0, 1.0, place) for r, k, place in brief.find(b)]
            for first in range(0, b.num_rows if len(sizes) else 0, ROWS):
                some = b.slice(first, ROWS)
                for row, k, place, terms, around in _windows(some, sizes, often, rare):
                    words = around.tolist()
                    kept = common_subsequence(*masks[k], words) / len(items.words[k])
                    if kept >= limits.verbatim:
                        x = _unit(rows, np.unique(terms))
                        c = max(float(q @ x) for q in asked[asked_of == k])
                        best = (kept, c, common_subsequence(*answers[k], words) / max(len(items.answers[k]), 1), place)
                        found[first + row, k] = max(found.get((first + row, k), best), best)
                for row, k, place, c, around in _nearest(some, sizes, rows, asked, asked_of, limits.cosine):
                    words = around.tolist()
                    kept = common_subsequence(*masks[k], words) / len(items.words[k])
                    answer = common_subsequence(*answers[k], words) / max(len(items.answers[k]), 1)
                    order = round(kept * len(items.words[k]))
                    leak = kept >= limits.verbatim or (answer >= limits.answer and limits.reworded(len(items.words[k]), (bags[k] & Counter(words)).total(), order))
                    if not leak and len(parts[k]) > 1 and answer >= limits.reordered_answer:
                        apart = sum(common_subsequence(*m, words) for m in parts[k]) / len(items.words[k])
                        leak, kept = apart >= limits.reordered, max(kept, min(apart, below))
                    if leak:
                        best = (kept, c, answer, place)
                        found[first + row, k] = max(found.get((first + row, k), best), best)
            out += [(ids[r], hashes[r], items.ids[k], c, lcs, ans, place) for (r, k), (lcs, c, ans, place) in found.items()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "text_hash", "item_id", "cosine", "lcs_ratio", "answer_ratio", "place"])

    return posted.mapInArrow(bk.tidied(run), ROW_SCHEMA)


def _reach(sizes: np.ndarray, width: int) -> np.ndarray:
    """How far from a window's middle the stretch goes that is compared with each item."""
    return np.maximum(sizes, width) // 2 + sizes // 4 + 4


def _nearest(b: pa.RecordBatch, sizes: np.ndarray, rows: np.ndarray, asked: np.ndarray, asked_of: np.ndarray, floor: float) -> Iterator[tuple]:
    """(row, item, place, cosine, terms of the stretch around) of the passages whose cosine with an item's passage in the latent space is floor or more.

    Where passages follow one another closely, the nearest stands for them: the stretch holds them all.
    """
    edge, terms, places, n = _flat(b)
    if not len(terms) or not len(asked):
        return
    step, most = WIDTHS[0] // 3, max(WIDTHS)
    room = -(-n // step) + most // step  # blocks of each row, with empty ones behind it
    first = np.concatenate([[0], np.cumsum(room)])
    block = np.repeat(first[:-1], np.diff(edge)) + places // step
    head = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    sums = np.zeros((int(first[-1]), rows.shape[1]), np.float32)
    for k in range(0, len(head), CHUNK):
        end = int(head[k + CHUNK]) if k + CHUNK < len(head) else len(terms)
        sums[block[head[k : k + CHUNK]]] = _row_sums(rows, terms[head[k] : end], head[k : k + CHUNK] - head[k])
    slide, across = sums, 1
    for width in WIDTHS:  # each some of the one before, end to end
        times, own = width // step // across, len(sums) - width // step + 1
        slide = sum((slide[k * across : k * across + own] for k in range(1, times)), slide[:own])
        across *= times
        count = np.maximum(1, -(-(n - width) // (width // 3)) + 1)
        of, k = _ranges(np.zeros(len(n), np.int64), count)
        at = first[of] + k * (width // 3 // step)
        hits = []
        for j in range(0, len(at), CHUNK):
            x = slide[at[j : j + CHUNK]]
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            cosine = x @ asked.T
            w, q = np.nonzero(cosine >= floor)
            hits.append((w + j, asked_of[q], cosine[w, q]))
        w, item, c = (np.concatenate([h[k] for h in hits]) for k in range(3))
        order = np.lexsort((w, item))
        w, item, c = w[order], item[order], c[order]
        if not len(w):
            continue
        near = (item[1:] == item[:-1]) & (of[w[1:]] == of[w[:-1]]) & (w[1:] - w[:-1] <= 2)
        group = np.concatenate([[0], np.cumsum(~near)])
        group = group * (len(w) + 1) + (np.arange(len(w)) - np.searchsorted(group, group)) // 4  # long runs have one each four passages
        order = np.lexsort((-c, group))
        best = order[np.append(True, group[order][1:] != group[order][:-1])]
        for j in best.tolist():
            row, place = int(of[w[j]]), int(k[w[j]] * (width // 3))
            reach = int(_reach(sizes[item[j]], width))
            lo, hi = edge[row] + np.searchsorted(places[edge[row] : edge[row + 1]], [place + width // 2 - reach, place + width // 2 + reach])
            yield row, int(item[j]), place, float(c[j]), terms[lo:hi]


def _unit(rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """A passage's place in the latent space, of unit length."""
    x = rows[terms].sum(0)
    return x / max(np.linalg.norm(x), 1e-9)


def _ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range, member) of all members of the ranges that begin at first."""
    of = np.repeat(np.arange(len(first)), count)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]


def _parts(size: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of positions whose sizes add up to about most."""
    part = (np.cumsum(size) - size) // most
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
    yield from map(slice, edge, [*edge[1:], len(part)])


def _windows(b: pa.RecordBatch, sizes: np.ndarray, often: Often, rare: Rare) -> Iterator[tuple]:
    """(row, item, place, terms of the window, terms of the stretch around) wherever the stretch may share ``need`` places.

    Two exact bounds: the stretch holds enough of the item's rarest places, and a common subsequence is
    no longer than the item's places whose words stand in the stretch.
    """
    edge, terms, places, n = _flat(b)
    if not len(terms):
        return
    reach = {w: _reach(sizes, w) for w in WIDTHS}
    # postings of all rows on one line, rows farther apart than any stretch reaches
    gap = int(n.max()) + 2 * max(int(r.max()) for r in reach.values()) + max(WIDTHS)
    line = np.repeat(np.arange(len(n), dtype=np.int64), np.diff(edge)) * gap + places
    same = line // gap * often.n_terms + terms
    order = np.argsort(same, kind="stable")
    again = same[order[1:]] == same[order[:-1]]
    before = np.full(len(line), -1)  # the same word's place before, in its row
    before[order[1:][again]] = line[order[:-1][again]]
    by_term = np.argsort(terms, kind="stable")
    count = np.bincount(terms, minlength=often.n_terms)
    start, per_entry = np.cumsum(count) - count, count[rare.terms]
    per_item = np.bincount(rare.items, per_entry, len(sizes)).astype(np.int64)
    for part in _parts(per_item, HITS):
        entries = slice(*np.searchsorted(rare.items, [part.start, part.stop]))
        of, at = _ranges(start[rare.terms[entries]], per_entry[entries])
        item, hit = rare.items[entries][of], line[by_term[at]]
        order = np.lexsort((hit, item))
        item, hit = item[order], hit[order]
        last = np.arange(len(hit)) + rare.some[item] - 1
        fits = np.flatnonzero(last < len(hit))
        fits = fits[item[last[fits]] == item[fits]]
        for width in WIDTHS:
            yield from _stretches(width, item[fits], hit[fits], hit[last[fits]], gap, n, line, terms, before, reach[width], often, rare)


def _stretches(width, item, hit, last, gap, n, line, terms, before, reach, often, rare) -> Iterator[tuple]:
    """Windows of a width whose stretch holds hit and last and passes the bound on its words."""
    step = width // 3
    row, r = hit // gap, reach[item]
    count = np.maximum(1, -(-(n[row] - width) // step) + 1)
    low = np.maximum((last - r - row * gap - width // 2) // step + 1, 0)
    high = np.minimum((hit + r - row * gap - width // 2) // step, count - 1)
    most = int(count.max(initial=1))
    some = np.flatnonzero(high >= low)
    of, k = _ranges(low[some], (high - low + 1)[some])
    code = np.unique((row[some][of] * len(rare.need) + item[some][of]) * most + k)
    row, item, place = code // most // len(rare.need), code // most % len(rare.need), code % most * step
    begin = row * gap + np.maximum(place + width // 2 - reach[item], 0)
    lo, hi = np.searchsorted(line, begin), np.searchsorted(line, row * gap + place + width // 2 + reach[item])
    good = np.flatnonzero(hi - lo >= rare.need[item])
    row, item, place, begin, lo, hi = (x[good] for x in (row, item, place, begin, lo, hi))
    for part in _parts(hi - lo, HITS):
        of, at = _ranges(lo[part], (hi - lo)[part])
        first = before[at] < begin[part][of]
        held = np.bincount(of, np.where(first, often.find(item[part][of], terms[at]), 0), part.stop - part.start)
        for k in (np.flatnonzero(held >= rare.need[item[part]]) + part.start).tolist():
            a, z = np.searchsorted(line, [row[k] * gap + place[k], row[k] * gap + place[k] + width])
            yield int(row[k]), int(item[k]), int(place[k]), terms[a:z], terms[lo[k] : hi[k]]


def leaking_rows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits(), share: float = 0.5, terms: int = TERMS) -> DataFrame:
    """Rows of ROW_SCHEMA of every leak found: the texts are read once per block of the benchmark."""
    spark = docs.sparkSession
    asked = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    out = None
    for own in blocks_of(asked, limits.min_words, terms):
        n_terms = len(own.vocabulary.terms)
        if not n_terms:
            continue
        block = spark.sparkContext.broadcast(own)
        posted = save(postings(docs, block, doc_id, text), "postings")
        df = frequencies(posted, n_terms)
        total = posted.agg(F.sum(F.ceil(F.col("n") / PASSAGE))).first()[0] or 1
        idf = np.log((total + 1) / (df + 1)) + 1
        space = latent_space(posted, own, idf, share)
        found = save(search(posted, block, idf, df, space, limits), "leaks")
        drop(spark, posted)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], ROW_SCHEMA)


def find_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs_ratio, answer_ratio, place of every leak found; options are those of leaking_rows()."""
    return leaking_rows(docs, benchmark, **options).drop("text_hash")


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that hold a benchmark item go; the columns stay those of docs.

    Rows are told apart by doc_id and text, so a leaking text goes whether its doc_id is
    null, repeated or shared with a clean text, and a clean text with that doc_id stays.
    Null and empty texts stay; repeated leaking rows all go; an empty table stays empty.
    """
    leaks = save(leaking_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("leak_id"), F.col("text_hash").alias("leak_hash")).distinct(), "leaking")
    right = F.broadcast(leaks) if small(leaks, 32) else leaks
    return docs.join(right, docs["doc_id"].cast("long").eqNullSafe(right["leak_id"]) & (F.xxhash64(docs["text"].cast("string")) == right["leak_hash"]), "left_anti")

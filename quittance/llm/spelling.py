"""Spelling variants: every word's neighbours at one edit, its more frequent form, and the root of its forms.

The vocabulary is dealt out by range and each range becomes shards of a compact trie:
inner nodes where words part, labels for what does not branch.  Shards are broadcast
in rounds of bounded size, and every word's automaton for distance one runs over all
of them depth first: along the word's own path, and at each place where another
character branches off, into the one subtree state that is left after a replaced, an
inserted or a deleted character.  As a pair is found at the first place where the two
words differ, it is found once.  Rounds give a word's number of neighbours and best
form within their shards; sums and the least of these come in one shuffle by word.

A round sends ``ROUND_BYTES`` of packed words through the driver at most; a larger
vocabulary takes more rounds.  No word has more neighbours than its length and the
alphabet allow, so no key of the joins is hot; counting is combined before its shuffle.

Cases: a null or empty text has no words; a null doc_id counts as an empty id; repeated
rows count each; among forms of equal count the smallest in code-point order is taken;
words of any length are whole (a shard holds one longer than its bound alone); other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.llm.common import let, new_folder, save

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: UTF-8 bytes of the words of a shard, and of the shards that a round broadcasts.
SHARD_BYTES, ROUND_BYTES = 1 << 20, 4 << 20
FOUND = "word string, n_near long, best_n long, best string"


def ascii_lower(word: Column) -> Column:
    """Only A-Z lower-cased."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def thinned(doc_id: Column, word: Column, every: int) -> Column:
    """word, without one of its characters where its hash with the document's id is a multiple of every: noise that is the same in every run."""
    mixed = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return let(mixed, lambda h: F.when(h % every != 0, word).otherwise(let((h % F.char_length(word)).cast("int"), lambda k: F.concat(F.substring(word, F.lit(1), k), F.substring(word, k + 2, F.char_length(word))))))


def vocabulary(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n as a written table: the words of at least least_length characters that occur least_count times; every asks for noise."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(RUN), F.lit(0))).alias("word"))
    d = d.filter(F.char_length("word") >= least_length).withColumn("word", ascii_lower(F.col("word")))
    if every:
        d = d.withColumn("word", thinned(F.col("doc"), F.col("word"), every)).filter(F.char_length("word") >= least_length)
    return save(d.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count), "spelling-words")


def pack(words: list[str], counts: list[int]) -> bytes:
    """Sorted words and counts as a trie in depth-first order: what each word shares with the one before, and its rest."""
    shared = [0, *(len(os.path.commonprefix([a, b])) for a, b in zip(words, words[1:], strict=False))]
    return zlib.compress(json.dumps([shared, [w[k:] for k, w in zip(shared, words, strict=True)], counts]).encode(), 1)


def unpack(packed: bytes) -> list[tuple[str, int]]:
    out, word = [], ""
    for k, rest, n in zip(*json.loads(zlib.decompress(packed)), strict=True):
        word = word[:k] + rest
        out.append((word, n))
    return out


class Trie:
    """Words with counts.  A branch is {character: edge}, with a count under "" if a word ends there; an edge is (label, branch or count)."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        """words: sorted and different."""
        self.top: dict = {}
        todo = [(self.top, 0, len(words), 0)]
        while todo:
            branch, low, high, depth = todo.pop()
            if len(words[low][0]) == depth if low < high else False:
                branch[""] = words[low][1]
                low += 1
            while low < high:
                first, end = words[low][0], low + 1
                while end < high and words[end][0][depth] == first[depth]:
                    end += 1
                if end == low + 1:
                    branch[first[depth]] = (first[depth + 1 :], words[low][1])
                else:
                    common = len(os.path.commonprefix([first, words[end - 1][0]]))
                    below: dict = {}
                    branch[first[depth]] = (first[depth + 1 : common], below)
                    todo.append((below, low, end, common))
                low = end

    @staticmethod
    def count(edge: tuple, word: str, at: int) -> int:
        """Count of the word that is word[at:] from edge on, or 0."""
        while True:
            label, below = edge
            if not word.startswith(label, at):
                return 0
            at += len(label)
            if below.__class__ is int:
                return below if at == len(word) else 0
            if at == len(word):
                return below.get("", 0)
            edge = below.get(word[at])
            if edge is None:
                return 0
            at += 1

    def near(self, word: str) -> list[tuple[str, int]]:
        """Words at one edit, with their counts."""
        out, count, end = [], self.count, len(word)
        branch, at = self.top, 0
        while True:
            own, after = word[at : at + 1], word[at + 1 : at + 2]  # empty at the end, as the key of a count is
            for c, edge in branch.items():
                if c == own:
                    continue
                if c == "":
                    if at + 1 == end:  # the last character deleted
                        out.append((word[:at], edge))
                    continue
                label, below = edge
                if below.__class__ is int:  # one word; what it lacks or has tells the edit
                    gap = end - at - len(label)
                    if (gap == 0 or (gap == 1 and own) or (gap == 2 and c == after)) and word.endswith(label):
                        out.append((word[:at] + c + label, below))
                    continue
                if (label or own in below) and (n := count(edge, word, at)):  # inserted
                    out.append((word[:at] + c + word[at:], n))
                if own:
                    if (label or after in below) and (n := count(edge, word, at + 1)):  # replaced
                        out.append((word[:at] + c + word[at + 1 :], n))
                    if c == after and (n := count(edge, word, at + 2)):  # deleted
                        out.append((word[:at] + word[at + 1 :], n))
            edge = branch.get(own) if own else None
            if edge is None:
                return out
            label, below = edge
            at += 1
            if not word.startswith(label, at):
                k = len(os.path.commonprefix([label, word[at:]]))
                at += k
                self.beside(label[k:], below, word, at, out)
                return out
            at += len(label)
            if below.__class__ is int:
                if at + 1 == end:  # the word is one longer than the leaf
                    out.append((word[:at], below))
                return out
            branch = below

    def beside(self, label: str, below: dict | int, word: str, at: int, out: list[tuple[str, int]]) -> None:
        """near() where word leaves the middle of a label, whose rest is label."""
        c, edge = label[0], (label[1:], below)
        if n := self.count(edge, word, at):
            out.append((word[:at] + c + word[at:], n))
        if at < len(word):
            if n := self.count(edge, word, at + 1):
                out.append((word[:at] + c + word[at + 1 :], n))
            if c == word[at + 1 : at + 2] and (n := self.count(edge, word, at + 2)):
                out.append((word[:at] + word[at + 1 :], n))


class Shards:
    """Packed shards of one round; the trie is built where it is first used and stays with that worker's copy."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed, self.trie = packed, None

    def near(self, word: str) -> list[tuple[str, int]]:
        if self.trie is None:
            self.trie = Trie([x for p in self.packed for x in unpack(p)])
        return self.trie.near(word)


def shards(words: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """part, nth, size, packed of the vocabulary's shards, in order of (part, nth): a written table."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, nth, part = [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "nth": pa.array([nth], pa.int32()), "size": pa.array([size], pa.int64()), "packed": pa.array([pack(held, counts)], pa.binary())})

        for b in batches:
            for w, n, part in zip(*[b.column(c).to_pylist() for c in ("word", "n", "part")], strict=True):  # noqa: B007
                if held and size + len(w.encode()) > shard_bytes:
                    yield shard()
                    held, counts, size, nth = [], [], 0, nth + 1
                held.append(w)
                counts.append(n)
                size += len(w.encode())
        if held:
            yield shard()

    d = words.repartitionByRange(parts, "word").sortWithinPartitions("word").select("word", "n", F.spark_partition_id().alias("part"))
    return save(d.mapInArrow(run, "part int, nth int, size long, packed binary"), "spelling-shards")


def neighbours(words: DataFrame, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """word, n_near, best_n, best of the words(word, n) that have neighbours: their number, and the count and text of the most frequent."""
    spark = words.sparkSession
    tries, path, rounds = shards(words, shard_bytes), new_folder(spark, "spelling-near"), []
    for part, nth, size in tries.select("part", "nth", "size").orderBy("part", "nth").toLocalIterator():
        if not rounds or rounds[-1][2] + size > round_bytes:
            rounds.append([(part, nth), (part, nth), 0])
        rounds[-1][1:] = (part, nth), rounds[-1][2] + size
    if not rounds:
        return spark.createDataFrame([], FOUND)
    at = F.struct("part", "nth")
    for low, high, _ in rounds:
        lowest, highest = (F.struct(F.lit(a).alias("part"), F.lit(b).alias("nth")) for a, b in (low, high))
        packed = [bytes(r["packed"]) for r in tries.filter((at >= lowest) & (at <= highest)).orderBy("part", "nth").select("packed").toLocalIterator()]
        shared = spark.sparkContext.broadcast(Shards(packed))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            near = shared.value.near
            for b in batches:
                rows = []
                for w in b.column("word").to_pylist():
                    if found := near(w):
                        best, n = min(found, key=lambda x: (-x[1], x[0]))
                        rows.append((w, len(found), n, best))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])

        words.select("word").mapInArrow(run, FOUND).write.mode("append").parquet(path)
        shared.destroy()
    found = spark.read.schema(FOUND).parquet(path)
    least = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("least")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("least.n")).alias("best_n"), F.col("least.word").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of links(word, form): form after form to the last.  Paths double, so rounds are few: counts grow along a path."""
    d = save(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = d.select(F.col("word").alias("over"), F.col("root").alias("beyond"))
        if not d.join(further, d["root"] == further["over"], "left_semi").head(1):
            return d
        d = save(d.join(further, d["root"] == further["over"], "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, ratio: int = 10, least_length: int = 7, least_count: int = 2, every: int | None = None, shard_bytes: int = SHARD_BYTES, round_bytes: int = ROUND_BYTES, **columns) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row per word of the vocabulary.

    form is the word's most frequent neighbour if that occurs ratio times as often or more.
    """
    words = vocabulary(docs, least_length, least_count, every, **columns)
    near = neighbours(words, shard_bytes, round_bytes)
    taken = F.col("best_n") >= ratio * F.col("n")
    d = words.join(near, "word", "left").select("word", F.when(taken, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("best_n")).alias("form_n"))
    d = save(d, "spelling-forms")
    last = roots(d.filter("form is not null"))
    return d.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

"""Token counts by a linear longest-match automaton.

The vocabulary is a trie.  Where greedy longest match would emit a piece and start
again, the automaton follows a failure link to the node of what remains and adds
the number of pieces popped on the way; both are worked out once, breadth first.
Each character is read once and no piece is ever built.

A word is a run of characters other than ASCII white space; it is matched with the
vocabulary's word-start mark before it.  A character that the vocabulary lacks costs
its UTF-8 bytes (byte fallback).  Counts of words seen before come from a bounded
cache, which changes no result.

Cases: null or empty text has 0 words and 0 tokens; repeated rows count alike; a very
long word is still read in one pass; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the production query; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD_START = "▁"
CACHE = 1 << 19
#: Largest vocabulary that is sent to the executors unless the caller allows more.
MOST_PIECES = 2_000_000


class Automaton:
    """Greedy longest-match piece counts of words over a vocabulary."""

    def __init__(self, pieces: Iterable[str], mark: str = WORD_START) -> None:
        self.mark = mark
        vocabulary = {p for p in pieces if p}
        edges: list[dict[str, int]] = [{}]
        cost: list[int] = [0]  # of ending here; 0: not a piece
        for piece in sorted(vocabulary | {c for p in vocabulary for c in p}):
            node = 0
            for c in piece:
                if c not in edges[node]:
                    edges[node][c] = len(edges)
                    edges.append({})
                    cost.append(0)
                node = edges[node][c]
            cost[node] = 1 if piece in vocabulary else len(piece.encode())
        fail, popped = [0] * len(edges), [0] * len(edges)
        level = [(node, 0, c) for c, node in edges[0].items()]
        while level:
            for node, parent, c in level:
                if cost[node]:
                    popped[node] = cost[node]  # what remains is nothing: back to the root
                    continue
                z, total = fail[parent], popped[parent]
                while c not in edges[z]:  # every character of the trie starts at the root, so this ends
                    total += popped[z]
                    z = fail[z]
                fail[node], popped[node] = edges[z][c], total
            level = [(child, node, c) for node, _, _ in level for c, child in edges[node].items()]
        self.edges, self.fail, self.popped = edges, fail, popped

    def count(self, word: str) -> int:
        """Pieces of the marked word."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node, total = 0, 0
        for c in self.mark + word:
            while True:
                child = edges[node].get(c)
                if child is not None:
                    node = child
                    break
                if node == 0:
                    total += len(c.encode())
                    break
                total += popped[node]
                node = fail[node]
        while node:
            total += popped[node]
            node = fail[node]
        return total


class _Counts(dict):
    """word bytes -> pieces, worked out when missing."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word.decode())
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def pieces_of(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model file, read on the driver."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    return [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


def count_tokens(docs: DataFrame, pieces: list[str], doc_id: str = "doc_id", text: str = "text", most_pieces: int = MOST_PIECES) -> DataFrame:
    """doc_id, n_words, n_tokens of every row.  The vocabulary is sent to the executors; one of more than most_pieces is refused."""
    if len(pieces) > most_pieces:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is over the bound of {most_pieces}")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            counts = counts if counts is not None else _Counts(Automaton(shared.value))
            n_words, n_tokens = [], []
            column = b.column("text").cast(pa.binary())
            for raw in column:
                words = (raw.as_py() or b"").split()
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, n_tokens long")

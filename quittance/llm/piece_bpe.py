"""SentencePiece encoding and decoding of the merge type (BPE), exact, by backtracking.

Merging picks the best pair of the whole text again and again.  What it ends with is
the only sequence of pieces in which every two neighbours, merged anew on their own,
come out as just these two: a merge across their border would have happened among
them as well.  So the pieces are found left to right: the longest piece that an
Aho-Corasick automaton finds at a position is tried first, then the pieces that are
its prefixes; a piece fits if it and the one before it merge to themselves; where
nothing fits, the position is marked in a bitfield and the piece before it gives way
to a shorter one.  As a text has one such sequence up to any position, a marked
position is never entered again, and the work is linear in the text.

A text is first cut where no merge can reach: around characters that are part of no
longer piece, and before the word mark if no piece has it inside.  Parts and verdicts
on neighbours seen before come from bounded caches, which change no result.

Models with a table of character normalisation, with user-defined or unused pieces,
without byte fallback or with marks at word ends are refused.

Cases: a null or empty text has no pieces; repeated rows and ids count each; a null
id stays null; a very long text is one row's work, in memory that grows with it alone;
characters that the model lacks are their UTF-8 bytes; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
#: Entries of the caches of parts and of neighbours, for each worker.
CACHE = 1 << 19
#: Ids of an Arrow batch of results, unless one text alone has more.
BATCH_IDS = 1 << 21
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Model:
    """What encoding and decoding need of a model file; about as large as the file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    dummy_prefix: bool
    unknown_surface: str


def read_model(path: str) -> Model:
    """The model of a file, read on the driver; ValueError for one that is not of the kinds above."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    kinds = tuple(p.type for p in m.pieces)
    no = {
        "not of the merge type": m.trainer_spec.model_type != pb.TrainerSpec.BPE, "without byte fallback": not m.trainer_spec.byte_fallback, "with marks at word ends": m.trainer_spec.treat_whitespace_as_suffix,
        "with a table of normalisation": bool(m.normalizer_spec.precompiled_charsmap or m.denormalizer_spec.precompiled_charsmap), "that drops white space": m.normalizer_spec.remove_extra_whitespaces,
        "that does not mark white space": not m.normalizer_spec.escape_whitespaces, "with user-defined or unused pieces": bool({USER, UNUSED} & set(kinds)),
    }
    if found := [k for k, v in no.items() if v]:
        raise ValueError(f"{path} is a model {' and '.join(found)}")
    return Model(tuple(p.piece for p in m.pieces), tuple(p.score for p in m.pieces), kinds, m.normalizer_spec.add_dummy_prefix, m.trainer_spec.unk_surface)


class _Cache(dict):
    """What has been worked out for a key; emptied when full."""

    def __init__(self, work: Callable, keep: Callable[[object], bool] = lambda key: True) -> None:
        super().__init__()
        self.work, self.keep = work, keep

    def __missing__(self, key):
        found = self.work(key)
        if self.keep(key):
            if len(self) >= CACHE:
                self.clear()
            self[key] = found
        return found


class Encoder:
    """Ids of texts under a model."""

    def __init__(self, model: Model) -> None:
        import ahocorasick

        normal = {p: i for i, p in enumerate(model.pieces) if model.kinds[i] == NORMAL}
        self.ids = {p: np.int32(i).tobytes() for p, i in normal.items()}
        self.bytes_at = {int(p[3:5], 16): np.int32(i).tobytes() for i, p in enumerate(model.pieces) if model.kinds[i] == BYTE}
        self.score = {p: model.scores[i] for p, i in normal.items()}
        self.dummy = SPACE_MARK if model.dummy_prefix else ""
        self.finder = ahocorasick.Automaton()
        self.shorter: dict[str, str] = {}
        for p in normal:
            self.finder.add_word(p, (len(p) - 1, p))
            if len(p) > 1:
                self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in normal), p[0])
        self.finder.make_automaton()
        glued = {c for p in normal if len(p) > 1 for c in p}
        marked = any(b == SPACE_MARK and a != SPACE_MARK for p in normal for a, b in zip(p, p[1:], strict=False))
        many = "".join(map(re.escape, sorted(glued - {SPACE_MARK})))
        parts = rf"[{SPACE_MARK}{many}]+" if marked else rf"{SPACE_MARK}*[{many}]+|{SPACE_MARK}+" if many else rf"{SPACE_MARK}+"
        self.parts = re.compile(rf"{parts}|[\s\S]").findall
        self.fit = _Cache(self.fits)
        self.known = _Cache(self.part, lambda part: len(part) <= 64)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the pair of highest score, the leftmost of equals, until none is a piece."""
        score, parts = self.score, list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbours (the first is empty at the beginning) merge to themselves."""
        return self.merged(pair[0] + pair[1]) == [p for p in pair if p]

    def pieces(self, part: str) -> list[str]:
        """Pieces of a text without normalisation; a character without a piece stands for itself."""
        longest = list(part)
        for end, (back, p) in self.finder.iter(part):
            longest[end - back] = p  # ends come in order, so the longest stays
        fit, shorter, n = self.fit, self.shorter, len(part)
        failed, out, at, last = bytearray(n + 1), [], 0, ""
        piece = longest[0]
        while True:
            end = at + len(piece)
            if not failed[end] and fit[last, piece]:
                out.append(piece)
                if end == n:
                    return out
                at, last, piece = end, piece, longest[end]
            elif piece in shorter:
                piece = shorter[piece]
            else:
                failed[at] = 1
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else ""

    def part(self, part: str) -> bytes:
        """Ids of a part as int32 in the machine's byte order."""
        ids, of_byte = self.ids, self.bytes_at
        return b"".join([ids[p] if p in ids else b"".join([of_byte[b] for b in p.encode()]) for p in self.pieces(part)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as int32 in the machine's byte order."""
        return b"".join(map(self.known.__getitem__, self.parts(self.dummy + text.replace(" ", SPACE_MARK)))) if text else b""


def _each_byte(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


class Decoder:
    """Texts of ids under a model."""

    def __init__(self, model: Model) -> None:
        import codecs

        codecs.register_error("quittance-byte", _each_byte)
        surface = {CONTROL: lambda p: b"", UNKNOWN: lambda p: model.unknown_surface.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.surfaces = pa.array([surface.get(k, lambda p: p.replace(SPACE_MARK, " ").encode())(p) for p, k in zip(model.pieces, model.kinds, strict=True)], pa.binary())
        self.control = np.array([k == CONTROL for k in model.kinds])
        self.leads = np.array([k == NORMAL and p.startswith(SPACE_MARK) for p, k in zip(model.pieces, model.kinds, strict=True)])
        self.dummy = model.dummy_prefix

    def decode(self, ids: pa.ListArray) -> list[str | None]:
        """One text per list, None for a null one; ids that the model lacks raise."""
        offsets = ids.offsets.to_numpy()
        flat = ids.values.slice(offsets[0], offsets[-1] - offsets[0])
        offsets, numbers = offsets - offsets[0], flat.to_numpy()
        surfaces = self.surfaces.take(flat).cast(pa.large_binary())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), surfaces), pa.scalar(b"", pa.large_binary()))
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        controls = np.concatenate([[0], np.cumsum(self.control[numbers])])
        out: list[str | None] = []
        for k, raw in enumerate(joined):
            i, j = offsets[k], offsets[k + 1]
            if missing[k]:
                out.append(None)
            elif controls[i] == controls[j]:
                text = raw.as_py().decode("utf-8", "quittance-byte")
                out.append(text[1:] if self.dummy and i < j and self.leads[numbers[i]] else text)
            else:  # a control piece ends a run of bytes
                cuts = [i - 1, *(i + np.flatnonzero(self.control[numbers[i:j]])), j]
                runs = [(a + 1, b) for a, b in zip(cuts, cuts[1:], strict=False) if a + 1 < b]
                text = "".join(b"".join(surfaces[a:b].to_pylist()).decode("utf-8", "quittance-byte") for a, b in runs)
                out.append(text[1:] if self.dummy and runs and self.leads[numbers[runs[0][0]]] else text)
        return out


def encode(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row, without begin or end ids.  The model is sent to the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(shared.value)
            start, held, size = 0, [], 0
            for k, t in enumerate(b.column("text")):
                held.append(encoder.encode(t.as_py()))
                size += len(held[-1]) // 4
                if size >= BATCH_IDS or k + 1 == b.num_rows:
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in held])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(held), np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, len(held)), ids], ["doc_id", "ids"])
                    start, held, size = k + 1, [], 0

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: Model) -> DataFrame:
    """encoded(doc_id, ids) with the ids' text; null ids have a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for b in batches:
            decoder = decoder or Decoder(shared.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(decoder.decode(b.column("ids")), pa.string())], ["doc_id", "ids", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")

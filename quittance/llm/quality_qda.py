"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text gives a short vector of statistics (lengths, symbol, separator, capital
and digit rates, distinct words, repeated neighbours ...), squashed by logarithms.
Class means and covariances come from moment sums over all labelled training rows;
covariances are shrunk toward their scaled identity, their Cholesky factors are
computed once, and a score is the posterior: the logistic of the difference of the two
Mahalanobis log-densities plus the log-prior ratio, scaled and shifted as fits the training
rows best, since real statistics are no Gaussians.

Cases: a null or empty text is the vector of an empty text and is scored like any
other.  Labels with a null quality or doc_id are not used.  A document labelled
twice counts twice.  If a class has no row at all, every score is the other class's
share (0.5 without labels).  Repeated rows score alike; extra columns are not read.
A very long text is one row of a chunk in memory; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quittance.llm import bytes_kernel as bk
from quittance.llm.common import save

FEATURES = (
    "log_words", "log_word_length", "symbol_rate", "mark_rate", "bar_rate", "capital_rate", "digit_rate",
    "other_punctuation_rate", "distinct_rate", "repeat_rate", "stop_rate", "line_rate", "dup_line_rate",
)
D = len(FEATURES)
RIDGE = 1e-3


def _class(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    lut[list(chars)] = 1
    return lut


SYMBOL, MARK, BAR = _class(b"#*$%&<>~^=_"), _class(b"!?"), _class(b"|")
CAPITAL, DIGIT, OTHER = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,;:'\"()-")
#: The second byte of two-byte capitals of the Latin-1 block follows 0xC3.
LATIN_CAPITAL = _class(bytes(range(0x80, 0x9F)))
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))


def text_vectors(column: pa.Array) -> np.ndarray:
    """Statistics of each text, a row of D doubles each."""
    out = np.zeros((len(column), D))
    for lo, hi, data, offsets in bk.chunks(column):
        out[lo:hi] = _vectors(data, offsets)
    return out


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def _vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends = bk.word_bounds(data, offsets)
    at = np.searchsorted(starts, offsets)
    words = np.diff(at).astype(float)
    one = np.maximum(words, 1)
    rate = lambda lut: np.log1p(_per_row(lut[data], offsets) / one)
    letters = np.maximum(_per_row(LETTER[data], offsets), 1)
    capital = CAPITAL[data]
    if len(data) > 1:
        capital[1:] |= (data[:-1] == 0xC3) & (LATIN_CAPITAL[data[1:]] == 1)
    hashes = bk.span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(words)), np.diff(at))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(words))
    same = np.zeros(len(h), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    repeats = np.bincount(row[same], minlength=len(words))
    short = np.bincount(row[(ends - starts) <= 3], minlength=len(words))
    lines, dup_lines = _lines(data, offsets)
    return np.column_stack([
        np.log1p(words),
        np.log1p(np.bincount(row, ends - starts, minlength=len(words)) / one),
        rate(SYMBOL), rate(MARK), rate(BAR),
        _per_row(capital, offsets) / letters,
        rate(DIGIT), rate(OTHER),
        np.log((distinct + 1) / (words + 1)) + 0.3 * np.log1p(words / 50),
        np.log1p(20 * repeats / one),
        short / one,
        np.log1p(lines / one * 10),
        np.log1p(dup_lines),
    ])


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each row, and those equal to an earlier one (of 20 bytes or more)."""
    cut = data == 10
    lines = _per_row(cut, offsets) + 1
    edge = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(cut) + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    stop = stop - ((stop > edge) & cut[np.maximum(stop - 1, 0)] if len(data) else 0)
    long = stop - edge >= 20
    edge, stop = edge[long], stop[long]
    if not len(edge):
        return lines, np.zeros(len(lines))
    row = np.searchsorted(offsets, edge, "right") - 1
    h = bk.span_hashes(data, edge, stop)
    order = np.lexsort((h, row))
    twin = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    return lines, np.bincount(row[order][1:][twin], minlength=len(lines)).astype(float)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every document."""
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = text_vectors(b.column("text")) if b.num_rows else np.zeros((0, D))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, D), pa.int32()), flat)], ["doc_id", "x"])

    return d.mapInArrow(bk.tidied(run), "doc_id long, x array<double>")


def centre_of(rows: DataFrame) -> np.ndarray:
    """The mean of rows(x, y), about which moments are summed so that no digits are lost."""
    means = rows.select(*[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(D)]).first()
    return np.array([m or 0.0 for m in means])


def moments(rows: DataFrame, centre: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """For each class of rows(x, y): count, sum of x - centre, sum of its square.  Sums are added up by place on the executors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, D) - centre
            y = b.column("y").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        k, place = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(place, pa.int32()), pa.array(total.ravel())], ["k", "place", "v"])

    sums = rows.mapInArrow(bk.tidied(partial), "k int, place int, v double").groupBy("k", "place").agg(F.sum("v").alias("v"))
    flat = np.zeros((2, 1 + D + D * D))
    for r in sums.toLocalIterator():  # 2 * (1 + D + D * D) rows, whatever the input
        flat[r["k"], r["place"]] = r["v"]
    return {k: (f[0], f[1 : D + 1], f[D + 1 :].reshape(D, D)) for k, f in enumerate(flat)}


@dataclass
class Discriminant:
    """Two Gaussian classes with cached Cholesky factors (inverse of L, lower), in scaled coordinates about a centre."""

    centre: np.ndarray
    scale: np.ndarray
    mean: list[np.ndarray]
    whiten: list[np.ndarray]
    log_det: list[float]
    log_prior: float
    constant: float | None = None
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, m: dict, centre: np.ndarray, shrinkage: float = 0.1, floor: float = 0.02) -> Discriminant:
        n = np.array([m[0][0], m[1][0]])
        if not n.all():
            share = 0.5 if not n.any() else float(n[1] > 0)
            return cls(centre, np.ones(D), [np.zeros(D)] * 2, [np.eye(D)] * 2, [0.0, 0.0], 0.0, constant=share)
        mean_all = (m[0][1] + m[1][1]) / n.sum()
        var_all = np.diag(m[0][2] + m[1][2]) / n.sum() - mean_all**2
        scale = np.sqrt(np.maximum(var_all, 1e-9))
        means, whiten, log_det = [], [], []
        for k in (0, 1):
            mu = m[k][1] / n[k]
            cov = (m[k][2] / n[k] - np.outer(mu, mu)) / np.outer(scale, scale)
            target = max(np.trace(cov) / D, floor)
            cov = (1 - shrinkage) * cov + shrinkage * target * np.eye(D) + floor * np.eye(D)
            chol = np.linalg.cholesky(cov)
            means.append(mu / scale)
            whiten.append(np.linalg.inv(chol))
            log_det.append(2 * float(np.log(np.diag(chol)).sum()))
        return cls(centre, scale, means, whiten, log_det, float(np.log(n[1] / n[0])))

    def gap(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log-densities, plus the log-prior ratio."""
        z = (x - self.centre) / self.scale
        density = []
        for k in (0, 1):
            y = (z - self.mean[k]) @ self.whiten[k].T
            density.append(-0.5 * ((y * y).sum(1) + self.log_det[k]))
        return density[1] - density[0] + self.log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.gap(x) + self.shift, -40, 40)))

    def calibrate(self, gap: np.ndarray, bad: np.ndarray, good: np.ndarray, steps: int = 40) -> None:
        """Slope and shift of the likeliest logistic, by Newton steps on how many rows of both classes have each gap."""
        if self.constant is not None:
            return
        n = bad + good
        a = np.array([0.25, 0.0])
        f = np.column_stack([gap, np.ones(len(gap))])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(f @ a, -40, 40)))
            gradient = f.T @ (good - n * p) - RIDGE * a
            curve = (f * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ f + RIDGE * np.eye(2)
            step = np.linalg.solve(curve, gradient)
            a = a + step / max(1.0, np.abs(step).max() / 0.5)
        self.slope, self.shift = float(max(a[0], 1e-3)), float(a[1])


def gap_counts(rows: DataFrame, model: Discriminant) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gap, rows of class 0, rows of class 1) in bins of the gap's inverse hyperbolic sine, at most some 1,600."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.arcsinh(model.gap(x)) * 50).astype(np.int64)), b.column("y").cast(pa.int32())], ["bin", "y"])

    counted = rows.select("x", "y").mapInArrow(bk.tidied(run), "bin long, y int").groupBy("bin").agg(F.count_if(F.col("y") == 0).alias("bad"), F.count_if(F.col("y") == 1).alias("good")).collect()
    column = lambda c: np.array([r[c] for r in counted], float)
    return np.sinh(column("bin") / 50), column("bad"), column("good")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learnt from labels outside the held-out fold."""
    seen = save(features(docs), "quality-features")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held_out
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    taught = save(seen.join(y.filter(~fold), "doc_id").select("x", "y"), "quality-taught")
    centre = centre_of(taught)
    model = Discriminant.fit(moments(taught, centre), centre)
    if model.constant is None:
        model.calibrate(*gap_counts(taught, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = seen.mapInArrow(bk.tidied(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

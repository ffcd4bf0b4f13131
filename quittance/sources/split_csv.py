"""Quoted CSV read by many tasks, line ends inside quotes included, with every record's number in its file.

Spark deals a text file out in byte ranges; where a range begins inside quotes, its first
lines belong to a record begun before.  One pass counts, for each range, its quotes and the
records that begin in it either way; sums along a file then tell each range whether it begins
inside quotes and how many records came before.  A second pass puts records together.  The
few that reach across ranges travel as fragments and are joined by their number.

Quotes are doubled inside quoted fields and stand nowhere else, as CSV writers do; a lone
quote inside an unquoted field would join lines, so files with such fields are no CSV here.
Blank lines between records are no records.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quittance.errors import LedgerError
from quittance.plans.scratch import written

#: (file, number of the record in it, the header being 1) of a row.
PLACE = "_place"
#: Byte ranges of one read: what the driver sends to every task is about a hundred bytes each.
MOST_RANGES = 1 << 18


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and range (its first byte) of the physical lines; rows of a range come in order."""
    d = spark.read.option("lineSep", "\n").text(path)
    return d.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))


def _ranges(b: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The stretches of a batch that lie in one range."""
    file, at = b.column("file").to_pylist(), b.column("range").to_pylist()
    start = 0
    for k in range(1, b.num_rows + 1):
        if k == b.num_rows or (file[k], at[k]) != (file[start], at[start]):
            yield file[start], at[start], b.slice(start, k - start)
            start = k


def _before(value: pa.Array, inside: int) -> tuple[np.ndarray, int]:
    """(whether each line begins inside quotes, whether the next does)."""
    quotes = pc.count_substring(value, '"').to_numpy(zero_copy_only=False)
    ahead = (np.cumsum(quotes) + inside) % 2
    return np.concatenate([[inside], ahead[:-1]]).astype(bool), int(ahead[-1])


def _blank(value: pa.Array) -> np.ndarray:
    return pc.is_in(value, value_set=pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def ranges_of(lines: DataFrame) -> DataFrame:
    """(file, range, inside, before): whether a range begins inside quotes, and how many records of its file begin before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list[int]] = {}
        for b in batches:
            for file, at, part in _ranges(b):
                held = sums.setdefault((file, at), [0, 0, 0])  # quotes, records if it begins outside, and inside quotes
                value, blank = part.column("value"), _blank(part.column("value"))
                within, after = _before(value, held[0] % 2)
                held[0] += (after - held[0]) % 2
                held[1] += int((~within & ~blank).sum())
                held[2] += int((within & ~blank).sum())
        rows = [(f, r, *x) for (f, r), x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, (pa.string(), *[pa.int64()] * 4), strict=True)], ["file", "range", "quotes", "outside", "within"])

    d = written(lines.mapInArrow(run, "file string, range long, quotes long, outside long, within long"), "csv-ranges")
    d = d.groupBy("file", "range").agg(*[F.sum(c).alias(c) for c in ("quotes", "outside", "within")])
    ahead = W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("inside", F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2)
    begun = F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("outside"))
    return d.select("file", "range", F.col("inside").cast("int").alias("inside"), F.coalesce(F.sum(begun).over(ahead), F.lit(0)).alias("before"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, nth, record): every record's text, without its line end, and its number in the file from 1."""
    lines = _lines(spark, path)
    starts = written(ranges_of(lines), "csv-starts")
    if starts.count() > MOST_RANGES:
        raise LedgerError(f"{path}: more than {MOST_RANGES} byte ranges; raise spark.sql.files.maxPartitionBytes")
    known = spark.sparkContext.broadcast({(r["file"], r["range"]): (r["inside"], r["before"]) for r in starts.toLocalIterator()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, nth, whole = None, 0, 0, True
        held: list[str] = []

        def fragment(ended: bool) -> tuple:
            return at[0], nth, "\n".join(held), whole and ended, at[1]

        for b in batches:
            out = []
            for file, r, part in _ranges(b):
                if (file, r) != at:
                    if held:
                        out.append(fragment(False))
                    at, held = (file, r), []
                    inside, nth = known.value[at]
                    whole = not inside  # else what comes first is the rest of a record
                value = part.column("value")
                within, inside = _before(value, inside)
                for text, goes_on, blank in zip(value.to_pylist(), within.tolist(), _blank(value).tolist(), strict=True):
                    if not goes_on:
                        if held:
                            out.append(fragment(True))
                        held, whole = [], True
                        if blank:
                            continue
                        nth += 1
                    held.append(text)
            yield _batch(out)
        if held:
            yield _batch([fragment(not inside)])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["file", "nth", "record", "whole", "range"])

    d = written(lines.mapInArrow(run, "file string, nth long, record string, whole boolean, range long"), "csv-records")
    parts = d.filter("not whole").groupBy("file", "nth").agg(F.sort_array(F.collect_list(F.struct("range", "record"))).alias("parts"))
    joined = parts.select("file", "nth", F.array_join(F.transform("parts", lambda x: x["record"]), "\n").alias("record"))
    d = d.filter("whole").select("file", "nth", "record").unionByName(joined)
    return d.withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a CSV file, or of a folder of files with one header, as texts, and PLACE."""
    d = records(spark, path)
    heads = [r["record"] for r in d.filter("nth = 1").select(F.regexp_replace("record", "^﻿", "").alias("record")).distinct().limit(2).collect()]
    if not heads:
        raise LedgerError(f"{path}: the file has no header row")
    if len(heads) > 1:
        raise LedgerError(f"{path}: files with different headers: {heads[0]!r} and {heads[1]!r}")
    names = next(csv.reader([heads[0]]))
    columns = [f"c{k}" for k in range(len(names))]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}
    row = F.from_csv("record", ", ".join(f"{c} string" for c in columns), options)
    rows = d.filter("nth > 1").select(row.alias("row"), F.struct("file", "nth").alias(PLACE))
    return rows.select(*[F.col("row")[c].alias(c) for c in columns], PLACE).toDF(*names, PLACE)

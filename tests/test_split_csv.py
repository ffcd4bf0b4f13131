"""CSV by byte ranges: the records and numbers that one reader of the whole file gives."""

from __future__ import annotations

import csv
import random

import pytest

from quittance.errors import DuplicateIdError, LedgerError
from quittance.plans.engine import reconcile
from quittance.sources import ledger, split_csv
from tests.test_engine import frames, random_case

HARD = ["plain", "", 'he said "no"', "two\nlines", "a,b", "\n\n", 'ends "here"\n', "é中🙂", " spaced ", "x" * 300, 'q""q', "r\r\nn"]


@pytest.fixture
def small_ranges(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def write(path, rows, header=("id", "text", "n"), newline="\n", bom=""):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(bom)
        csv.writer(f, lineterminator=newline).writerows([header, *rows])
        f.write(newline)  # a blank line is no record


@pytest.mark.parametrize(("seed", "newline", "bom"), [(1, "\n", ""), (2, "\r\n", "﻿"), (3, "\n", "﻿")])
def test_ranges_give_what_one_reader_gives(spark, tmp_path, small_ranges, seed, newline, bom):
    r = random.Random(seed)
    rows = [(f"p{k}", r.choice(HARD) + r.choice(HARD), str(k)) for k in range(60)]
    write(tmp_path / "a.csv", rows, newline=newline, bom=bom)
    d = split_csv.read(spark, str(tmp_path / "a.csv"))
    assert d.columns == ["id", "text", "n", split_csv.PLACE]
    got = sorted((x[3]["nth"], x[0], x[1] or "", x[2]) for x in d.collect())
    assert got == [(k + 2, *row) for k, row in enumerate(rows)]
    starts = split_csv.ranges_of(split_csv._lines(spark, str(tmp_path / "a.csv"))).collect()
    assert len(starts) > 10 and {x["inside"] for x in starts} == {0, 1}


def test_a_record_over_many_ranges(spark, tmp_path, small_ranges):
    rows = [("p1", "\n".join(f"line {k}, with a comma" for k in range(40)), "1"), ("p2", "", "2")]
    write(tmp_path / "a.csv", rows)
    assert sorted((x["id"], x["text"] or "", x["n"]) for x in split_csv.read(spark, str(tmp_path / "a.csv")).collect()) == rows


def test_folders_and_headers(spark, tmp_path, small_ranges):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        write(folder / f"{k}.csv", [(f"p{k}{j}", "two\nlines", str(j)) for j in range(5)])
    assert split_csv.read(spark, str(folder)).count() == 15
    write(folder / "3.csv", [("p9", "x", "1")], header=("id", "other", "n"))
    with pytest.raises(LedgerError, match="different headers"):
        split_csv.read(spark, str(folder))
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(LedgerError, match="no header row"):
        ledger.read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "head.csv").write_text("id,date,amount,currency\n")
    assert ledger.read_payments(spark, str(tmp_path / "head.csv")).count() == 0


def test_the_first_bad_record_is_named(spark, tmp_path, small_ranges):
    lines = [f'p{k},2026-01-05,{"5.00" if k not in (17, 23) else "-1"},EUR,"two\nlines {k}"' for k in range(40)]
    (tmp_path / "b.csv").write_text("id,date,amount,currency,reference\n" + "\n".join(lines) + "\n")
    with pytest.raises(LedgerError, match="b.csv:19: amount: must be positive"):
        ledger.read_payments(spark, str(tmp_path / "b.csv"))


def test_all_repeated_ids_are_counted(spark):
    invoices, payments = random_case(3, 5, 40)
    i, p = frames(spark, invoices, payments)
    with pytest.raises(DuplicateIdError, match="p019 and 20 more"):
        reconcile(i, p.union(p))

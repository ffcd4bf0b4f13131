"""The engine and the operators on Spark."""

from __future__ import annotations

import datetime
import json
import random
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quittance.errors import DuplicateIdError, InvariantViolation, LedgerError
from quittance.functions.text import extract_refs, invoice_token, similarity
from quittance.operators import invariants, report, resolve
from quittance.plans.engine import reconcile
from quittance.plans.fold import Component, Line, OpenInvoice
from quittance.plans.parsers import ModelParser, default_parser
from quittance.plans.policy import Policy
from quittance.sources import generate, history, ledger, mapping
from quittance.streaming.payments import OpenLedger, start

I = "id string, customer_id string, customer_name string, number string, issue_date date, due_date date, amount decimal(18,2), currency string"
P = "id string, date date, amount decimal(18,2), currency string, reference string, counterparty string, customer_id string"
DAY = datetime.date(2026, 1, 5)


def day(n):
    return DAY + datetime.timedelta(n)


def frames(spark, invoices, payments):
    return spark.createDataFrame(invoices, I), spark.createDataFrame(payments, P)


def random_case(seed, n=60, m=50):
    r = random.Random(seed)
    names = {"c1": "Acme Kft", "c2": "Globex GmbH", "c3": "Számla Bt"}
    invoices = [(f"i{k:03d}", c := r.choice(list(names)), names[c], f"INV-2026-{k:04d}", day(r.randint(-40, 20)), None, Decimal(r.randint(1, 9) * 100), r.choice(["EUR", "HUF"])) for k in range(n)]
    payments = []
    for k in range(m):
        x = r.choice(invoices)
        amount = x[6] * r.choice([1, 1, 1, Decimal("0.98"), Decimal("0.5"), 2])
        who = r.choice([x[2], x[2], "", x[2].upper() + "!", "Nobody Ltd"])
        ref = r.choice([x[3], "", f"szamla {int(x[3][-4:])}", f"{x[3]} {r.choice(invoices)[3]}", "thanks"])
        payments.append((f"p{k:03d}", day(r.randint(0, 60)), amount.quantize(Decimal("0.01")), x[7], ref, who, r.choice([None, None, x[1], "unknown"])))
    return invoices, payments


def sequential(invoices, payments, policy):
    """One pass over everything, customers resolved by hand."""
    c = Component(policy)
    names = {}
    for x in invoices:
        token = invoice_token(x[3])
        c.add(OpenInvoice(x[0], x[1], x[3], (x[4] - datetime.date(1970, 1, 1)).days, int(x[6] * 100), x[7], token and token[:2]))
        names[x[2]] = x[1]
    out = {}
    for p in sorted(payments, key=lambda p: (p[1], p[0])):
        known = p[6] if p[6] in names.values() else None
        if known is None and p[5]:
            exact = [i for n, i in names.items() if similarity("xxxxx" + n, "xxxxx" + p[5]) == 100]
            close = max(((similarity(n, p[5]), n) for n in names), default=(0, ""))
            known = exact[0] if exact else names[close[1]] if close[0] > policy.fuzzy_ref_threshold else None
        out[p[0]] = c.decide(Line(p[0], (p[1] - datetime.date(1970, 1, 1)).days, int(p[2] * 100), p[3], p[4], known, [t[:2] for t in extract_refs(p[4])]))
    return out


@pytest.mark.parametrize("policy", [Policy(), Policy(require_customer_match=False), Policy(ambiguity_policy="resolve_by_policy", confidence_threshold=Decimal("0.5"), tie_break="largest_first")])
def test_components_equal_one_pass(spark, policy):
    invoices, payments = random_case(11)
    r = reconcile(*frames(spark, invoices, payments), policy)
    want = sequential(invoices, payments, policy)
    got = {x["payment_id"]: x for x in r.decided.collect()}
    assert set(got) == set(want)
    for k, o in want.items():
        assert (got[k]["status"], got[k]["review_reason"], got[k]["message"]) == (o.status, o.review, o.message), k
        parts = got[k]["chosen"] and [tuple(x) for x in got[k]["chosen"]["parts"]]
        assert parts == (o.chosen and [tuple(x) for x in o.chosen.parts])
    p = r.report.first()
    assert p["payments_total"] == len(payments) and p["money_in"] == sum(x[2] for x in payments) == p["money_allocated"] + p["money_residual"]


def test_refusals(spark):
    i, p = frames(spark, [("i1", "c1", "A", "1", DAY, None, Decimal(5), "EUR")], [("p1", DAY, Decimal(5), "EUR", "", "A", None)])
    with pytest.raises(DuplicateIdError, match="payment"):
        reconcile(i, p.union(p))
    with pytest.raises(LedgerError, match="floating"):
        reconcile(i.withColumn("amount", F.col("amount").cast("double")), p)
    for column, value, said in (
        ("amount", "cast(null as decimal(18,2))", "amount: not an amount"), ("amount", "cast(-1 as decimal(18,2))", "amount: must be positive"), ("amount", "cast(0.004 as decimal(18,3))", "amount: must be positive"),
        ("currency", "'EURO'", "currency: must be three letters"), ("currency", "null", "currency"), ("id", "null", "None.*id: must not be empty"), ("id", "' \t'", "id: must not be empty"),
    ):
        with pytest.raises(LedgerError, match=f"invoice .*{said}"):
            reconcile(i.withColumn(column, F.expr(value)), p)
        with pytest.raises(LedgerError, match=f"payment .*{said}"):
            reconcile(i, p.withColumn(column, F.expr(value)))
    with pytest.raises(LedgerError, match="payment 'p1': date: not a date"):
        reconcile(i, p.withColumn("date", F.lit(None).cast("date")))
    with pytest.raises(LedgerError, match="invoice 'i1': customer_id"):
        reconcile(i.withColumn("customer_id", F.lit("")), p)
    with pytest.raises(LedgerError, match="missing column.*number"):
        reconcile(i.drop("number"), p)
    none = reconcile(i, p.filter("false"))
    assert none.report.first()["payments_total"] == 0 and none.invoice_states.first()["status"] == "open"


def test_model_tier_only_proposes(spark):
    i, p = frames(spark, [("i7", "c1", "Acme", "INV-2026-0007", DAY, None, Decimal(50), "EUR")], [("p1", day(3), Decimal(50), "EUR", "the seventh", "", None), ("p2", day(4), Decimal(50), "EUR", "the other", "", None)])
    r = reconcile(i, p, parser=default_parser(lambda t: [{"seq": 7 if "seventh" in t else 12345}]))
    assert {x["payment_id"]: x["status"] for x in r.results.collect()} == {"p1": "matched", "p2": "unmatched"}
    assert r.report.first()["model_parser_calls"] == 2
    assert isinstance(default_parser(lambda t: []).parsers[1], ModelParser)


def test_similar_names_equal_all_pairs(spark):
    r = random.Random(2)
    names = ["".join(r.choice("ABCD") for _ in range(r.randint(4, 14))) for _ in range(60)]
    asked = [list(n) for n in names[:30]]
    for a in asked:
        for _ in range(r.randint(0, 2)):
            a[r.randrange(len(a))] = r.choice("ABCDX")
    asked = sorted({"".join(a) + r.choice(["", "Q", "ABCABC"]) for a in asked})
    left = spark.createDataFrame([(a,) for a in asked], "key string")
    right = spark.createDataFrame([(n, f"c{n}") for n in sorted(set(names))], "name_key string, customer_id string")
    got = {(x["key"], x["name_key"]) for x in resolve.similar_pairs(left, right, 80).filter("score > 80").collect()}
    assert got == {(a, n) for a in asked for n in set(names) if len(n) >= 5 and similarity(n, a) > 80}
    # the best name of each, by steps of fewer edits first
    payments = spark.createDataFrame([(a, a) for a in asked], "id string, counterparty string")
    got = {x["id"]: x["customer_id"] for x in resolve.by_similar_name(payments, right, 80).collect()}
    want = {a: min((-similarity(n, a), n) for n in set(names)) for a in asked}
    assert got == {a: f"c{n}" for a, (s, n) in want.items() if -s > 80 and len(n) >= 5}


def test_invariants_catch_every_break(spark):
    i, p = frames(spark, [("i1", "c1", "A", "1", DAY, None, Decimal(100), "EUR")], [("p1", DAY, Decimal(100), "HUF", "", "A", None)])
    row = lambda *x: spark.createDataFrame([x], "payment_id string, invoice_id string, amount decimal(18,2)")
    none = row("p1", "i1", Decimal(1)).filter("false")
    a, left = row("p1", "i1", Decimal(150)), none.select("payment_id", "amount")
    found = invariants.violations(i, p, a, none, left, report.invoice_states(i, a, none))
    assert {x["check"] for x in found.collect()} == {"payment_conservation", "invoice_bounds", "invoice_states", "global_conservation", "currency_alignment"}
    with pytest.raises(InvariantViolation, match="crosses currencies"):
        invariants.check(found)
    lost = row("p9", "i9", Decimal(1))
    assert invariants.references(lost, lost, lost.select("payment_id", "amount"), i, p).count() == 4


def test_files_round_trip(spark, tmp_path):
    invoices, payments = random_case(5, 20, 20)
    i, p = frames(spark, invoices, payments)
    ledger.write_invoices(i, f"{tmp_path}/i")
    ledger.write_payments(p, f"{tmp_path}/p")
    i2, p2 = ledger.read_invoices(spark, f"{tmp_path}/i"), ledger.read_payments(spark, f"{tmp_path}/p")
    assert sorted(map(tuple, i2.select(*i.columns).collect())) == sorted(map(tuple, i.collect()), key=lambda x: x[0])
    a, b = reconcile(i, p), reconcile(i2, p2)
    assert ledger.result_document(a) == ledger.result_document(b)
    body = {"invoices": [dict(zip(i.columns, map(str, x), strict=True)) | {"due_date": ""} for x in invoices], "payments": [{k: ("" if v is None else str(v)) for k, v in zip(p.columns, x, strict=True)} for x in payments]}
    assert json.loads(ledger.dumps(ledger.result_document(ledger.request(spark, json.dumps(body))))) == ledger.result_document(a)
    for path in ledger.write_all(a, f"{tmp_path}/out"):
        assert Path(path).is_dir()
    assert ledger.read_result(spark, f"{tmp_path}/out") == ledger.result_document(a)
    with pytest.raises(ValueError, match="too many"):
        ledger.result_document(a, most=21)
    back = spark.read.csv(f"{tmp_path}/out/allocations.csv", header=True)
    assert back.columns == ["payment_id", "invoice_id", "amount", "fee", "strategy", "confidence", "reason"] and back.count() == a.allocations.count()


def test_bad_files_are_named(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("﻿id,date,amount,currency\np1,2026-01-05,5.00,EUR\np2,2026-01-05,-1,EU\n")
    with pytest.raises(LedgerError, match="bad.csv:3: amount: must be positive; currency"):
        ledger.read_payments(spark, str(bad))
    bad.write_text("id,date,currency\np1,2026-01-05,EUR\n")
    with pytest.raises(LedgerError, match="missing column"):
        ledger.read_payments(spark, str(bad))
    with pytest.raises(LedgerError):
        ledger.read_payments(spark, str(tmp_path / "none.csv"))
    with pytest.raises(LedgerError, match="floating"):
        ledger.request(spark, '{"payments": [{"id": "p", "date": "2026-01-05", "amount": 1.5, "currency": "EUR"}]}')


def test_mapped_export(spark):
    raw = spark.createDataFrame([("7", " 2026-01-05 ", "5.00", "eur", "x")], "`Transaction ID` string, `Booking Date` string, `Credit Amount` string, Ccy string, Junk string")
    out = mapping.to_canonical(raw, mapping.propose(raw.columns, "payment"))
    assert out.columns == ["id", "date", "amount", "currency"] and out.first()["date"] == "2026-01-05"


def test_history(spark, tmp_path):
    h = history.RunHistory(spark, f"file://{tmp_path}")
    h.create_draft("r1", label="first")
    h.create_draft("r2")
    h.mark_complete("r1", payment_count=3, money_in="5.00")
    h.save_mapping("r1", [("invoice", "id", "Key", "alias")])
    h.save_mapping("r1", [("invoice", "id", "Ref", "manual")])
    assert h.get("r1")["status"] == "complete" and h.get("r1")["label"] == "first" and h.count() == 2 and h.count("draft") == 1
    assert [tuple(x) for x in h.mapping("r1").collect()] == [("invoice", "id", "Ref", "manual")]
    assert h.delete("r2") and h.get("r2") is None and not h.delete("r2")
    h.save_mapping("r1", [])
    assert h.mapping("r1").count() == 0
    h.log_access("r1", "ann", "download")
    h.log_access("r1", "bob", "view")
    assert [(x["who"], x["action"]) for x in h.accesses("r1").collect()] == [("ann", "download"), ("bob", "view")]
    h.backup_to(f"file://{tmp_path}/copy")
    other = history.RunHistory(spark, f"file://{tmp_path}/copy")
    assert other.get("r1") == h.get("r1") and other.accesses().count() == 2


def test_history_before_its_first_run_and_of_other_formats(spark, tmp_path):
    h = history.RunHistory(spark, f"file://{tmp_path}/new")
    assert (h.count(), h.get("r1"), h.mapping("r1").count(), h.accesses().count(), h.migrate()) == (0, None, 0, 0, history.FORMAT)
    old = history.RunHistory(spark, f"file://{tmp_path}/old")
    row = (None, "r9", 5, datetime.datetime(2026, 1, 1), "kept", "complete", False)
    spark.createDataFrame([row], "kind string, run_id string, version bigint, created_at timestamp_ntz, label string, status string, deleted boolean").write.parquet(old._path(version=1))
    assert old.migrate() == 1 and old.get("r9")["label"] == "kept" and old.migrate() == history.FORMAT and old.count() == 1
    spark.range(1).write.parquet(f"file://{tmp_path}/old/v{history.FORMAT + 1}/runs")
    with pytest.raises(LedgerError, match="newer"):
        old.migrate()


def test_sweep_deletes_files_then_records(spark, tmp_path):
    from quittance.sources.runner import artifact, artifacts, create_folder, sweep

    h, now = history.RunHistory(spark, f"file://{tmp_path}/h"), datetime.datetime(2026, 6, 1)
    ids = {name: f"{k:032x}" for k, name in enumerate(("old", "stale", "fresh", "draft"))}
    for name, age in (("old", 40), ("stale", 3), ("fresh", 3), ("draft", 0)):
        h.create_draft(ids[name], created_at=now - datetime.timedelta(days=age))
        (tmp_path / "runs" / ids[name] / "result.json").mkdir(parents=True)
        (tmp_path / "runs" / ids[name] / "result.json" / "part").write_text("x" * 10)
    for name in ("old", "fresh"):
        h.mark_complete(ids[name])
    root = f"file://{tmp_path}/runs"
    (tmp_path / "runs" / ids["old"] / "notes.txt").write_text("x")
    assert artifacts(spark, root, ids["old"]) == {"result.json": 10} and artifacts(spark, root, "f" * 32) == {}
    assert artifact(spark, root, ids["old"], "result.json") == f"{root}/{ids['old']}/result.json"
    for run, name in ((ids["old"], "../x"), ("../runs", "result.json"), (ids["old"], "allocations.csv"), (ids["old"], "notes.txt")):
        with pytest.raises(LedgerError):
            artifact(spark, root, run, name)
    with pytest.raises(LedgerError, match="not the id of a run"):
        create_folder(spark, root, "../elsewhere")
    assert artifacts(spark, root, create_folder(spark, root, "e" * 32).rpartition("/")[2]) == {}
    (tmp_path / "runs" / ("e" * 32)).rmdir()
    assert sweep(h, root, retention_days=30, now=now) == {"expired": 1, "abandoned": 1}
    assert {r["run_id"] for r in h.runs().collect()} == {ids["fresh"], ids["draft"]}
    assert sorted(x.name for x in (tmp_path / "runs").iterdir()) == sorted([ids["fresh"], ids["draft"]])
    assert sweep(h, root, retention_days=None, now=now) == {"expired": 0, "abandoned": 0}


def test_generated_cases(spark):
    clean = generate.generate(spark, seed=3, invoice_count=200)
    r = reconcile(clean.invoices, clean.payments)
    q = report.quality(r.allocations, clean.truth, r.results).first()
    assert q["precision"] == 1.0 and q["recall"] >= 0.99
    noisy = generate.generate(spark, seed=3, invoice_count=200, noise=generate.noise_at(0.3))
    again = generate.generate(spark, seed=3, invoice_count=200, noise=generate.noise_at(0.3))
    assert sorted(noisy.payments.collect()) == sorted(again.payments.collect())
    r = reconcile(noisy.invoices, noisy.payments)
    q = report.quality(r.allocations, noisy.truth, r.results).first()
    assert q["precision"] > 0.9 and 0.5 < q["recall"] < 1
    assert generate.truth_rows(noisy).count() == noisy.payments.count()
    assert generate.noise_at(0.2, "amount").label == "amt=0.20" and generate.Noise().label == "clean"


def test_stream_survives_a_restart(spark, tmp_path):
    """A ledger that starts again from its folder and checkpoint goes on with the balances left; a replayed epoch changes nothing."""
    invoices, payments = random_case(8, 20, 12)
    i, p = frames(spark, invoices, payments)
    rows = p.orderBy("date", "id").collect()
    folder, got, results = tmp_path / "in", {}, {}

    def deliver(r, epoch):
        got[epoch] = [(x["payment_id"], x["invoice_id"], x["amount"]) for x in r.allocations.collect()]
        results[epoch] = r.results.count()

    for k in range(3):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], P).coalesce(1).write.mode("append").parquet(str(folder))
        book = OpenLedger(i, f"file://{tmp_path}/ledger", deliver=deliver)  # a new driver each time
        assert book.last == k - 1
        start(spark.readStream.schema(P).parquet(str(folder)), book, str(tmp_path / "cp"), once=True).awaitTermination()
    assert results == {0: 4, 1: 4, 2: 4}
    # the same batches one after another, without a stream
    want, now = [], i
    for k in range(3):
        r = reconcile(now, spark.createDataFrame(rows[4 * k : 4 * k + 4], P), customers=i)
        want += [(x["payment_id"], x["invoice_id"], x["amount"]) for x in r.allocations.collect()]
        left = {x["invoice_id"]: x["open_balance"] for x in r.invoice_states.collect() if x["open_balance"] > 0}
        now = spark.createDataFrame([(*x[:6], left[x[0]], x[7]) for x in invoices if x[0] in left], I)
    assert sorted(x for y in got.values() for x in y) == sorted(want) and want
    again = OpenLedger(i, f"file://{tmp_path}/ledger", deliver=deliver)
    assert again.last == 2
    again.apply(spark.createDataFrame(rows[:4], P), 2)
    assert results == {0: 4, 1: 4, 2: 4}
    face = {x[0]: x[6] for x in invoices}
    paid = {}
    for _, k, x in want:
        paid[k] = paid.get(k, 0) + x
    assert all(v <= face[k] for k, v in paid.items())


def test_rest_stands_without_llm(tmp_path):
    """The entry module works where the training-data package is absent."""
    root = Path(__file__).resolve().parents[1]
    for x in root.iterdir():
        if x.name not in (".git", "quittance", "corpus_pipeline.py", "tests"):
            (tmp_path / x.name).symlink_to(x)
    (tmp_path / "quittance").mkdir()
    for x in (root / "quittance").iterdir():
        if x.name != "llm":
            (tmp_path / "quittance" / x.name).symlink_to(x)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'op1_quality_qda' in e.queries(), set(e.oracle_sql()) <= set(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert said.split()[1:] == ["False", "True"]
    # a package that is there but cannot be imported is told about, and takes nothing else with it
    (tmp_path / "quittance" / "llm").mkdir()
    (tmp_path / "quittance" / "llm" / "__init__.py").write_text("")
    (tmp_path / "quittance" / "llm" / "queries.py").write_text("import a_module_that_is_not_there")
    broken = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert broken.stdout.split()[0] == said.split()[0] and "cannot be imported" in broken.stderr


def test_command_line(spark, tmp_path, capsys):
    from quittance.cli import main
    from quittance.sources.runner import execute, remove

    (tmp_path / "i.csv").write_text("Key,ContactName,AccountCode,Invoice Number,InvoiceDate,Total,Currency\n7,Acme Kft,c1,INV-2026-0007,2026-01-05,100.00,eur\n")
    (tmp_path / "b.csv").write_text("Transaction ID,Booking Date,Credit Amount,Ccy,Remittance Information,Payer Name\nt1,2026-01-09,100.00,EUR,INV-2026-0007,ACME KFT\n")
    assert main(["run", str(tmp_path / "i.csv"), str(tmp_path / "b.csv"), "--out", f"{tmp_path}/out"]) == 0
    assert "1 matched" in capsys.readouterr().out
    assert main(["run", str(tmp_path / "none.csv"), str(tmp_path / "b.csv")]) == 2
    assert main(["version"]) == 0
    book = history.RunHistory(spark, f"file://{tmp_path}/history")
    done = execute(spark, str(tmp_path / "i.csv"), str(tmp_path / "b.csv"), f"{tmp_path}/out2", history=book, run_id="r1")
    assert (done.invoices, done.payments, book.get("r1")["status"], book.get("r1")["money_in"]) == (1, 1, "complete", "100.00")
    assert remove(spark, f"{tmp_path}/out2") == 4
    with pytest.raises(LedgerError, match="more than"):
        execute(spark, str(tmp_path / "i.csv"), str(tmp_path / "b.csv"), f"{tmp_path}/out3", max_rows=0)


def test_sample_case_runs_from_its_files(spark, tmp_path, capsys):
    from quittance.cli import main

    assert main(["sample", str(tmp_path / "case")]) == 0
    assert main(["run", str(tmp_path / "case" / "invoices.csv"), str(tmp_path / "case" / "bank.csv"), "--out", str(tmp_path / "out")]) == 0
    assert "invoices  60:" in capsys.readouterr().out
    truth = spark.read.csv(str(tmp_path / "case" / "truth.csv"), header=True)
    assert truth.columns == ["payment_id", "invoice_ids"] and truth.count() == generate.sample(spark).payments.count()


def test_quality_bench(spark, tmp_path):
    from quittance.plans import quality_bench

    names = [s[0] for s in quality_bench.scenarios()]
    assert len(names) == 13 and names.count("overall") == 6
    rows = quality_bench.run(spark, [quality_bench.scenarios()[0]], seeds=(0,), invoices=60)
    m = quality_bench.means(rows)
    assert m.first()["precision"] == 1.0
    assert quality_bench.differences(m, m).count() == 0
    assert quality_bench.differences(m, m.withColumn("recall", F.col("recall") - 0.1)).count() == 1
    with pytest.raises(LedgerError, match="no benchmark"):
        quality_bench.read_results(spark, f"file://{tmp_path}/none")
    quality_bench.write_results(spark, m, f"file://{tmp_path}/bench", seeds=1, invoices=60)
    assert quality_bench.check(spark, f"file://{tmp_path}/bench", m) == []
    assert "recall was" in quality_bench.check(spark, f"file://{tmp_path}/bench", m.withColumn("recall", F.lit(0.5)))[0]
    assert len(quality_bench.check(spark, f"file://{tmp_path}/bench", m.filter("false"))) == 5
    assert any("overall | 0.0" in x["value"] for x in spark.read.text(f"file://{tmp_path}/bench/results.md").collect())

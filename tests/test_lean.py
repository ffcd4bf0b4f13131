"""What a run need not read, search or send through Python stays out, and the results are those of the whole."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quittance.functions.subsets import find_subsets
from quittance.functions.text import extract_refs, invoice_token, refs_of
from quittance.operators import candidates, invariants, pairs
from quittance.plans import engine
from quittance.plans.policy import Policy
from tests.test_engine import day, frames, random_case, sequential


def test_only_invoices_that_a_payment_can_see_are_folded(spark, monkeypatch):
    invoices, payments = random_case(21, 200, 12)
    invoices += [("far", "c1", "Acme Kft", "INV-2020-9999", day(-900), None, Decimal(100), "EUR"), ("none", "c9", "Idle Ltd", "INV-2026-8888", day(0), None, Decimal(100), "EUR")]
    seen = []

    def watched(stream, policy, keys):
        seen.extend(r["id"] for r in stream.filter("side = 0").select("id").collect())
        return plain(stream, policy, keys)

    plain = engine._run
    monkeypatch.setattr(engine, "_run", watched)
    got = {r["payment_id"]: r for r in engine.reconcile(*frames(spark, invoices, payments)).decided.collect()}
    want = sequential(invoices, payments, Policy())
    assert {k: (o.status, o.review, o.message, len(o.ranked)) for k, o in want.items()} == {k: (r["status"], r["review_reason"], r["message"], len(r["ranked"])) for k, r in got.items()}
    assert seen and not {"far", "none"} & set(seen)


TEXTS = ["INV-2024-000123", "INV-2024-000123 INV-2024-000124", "", "thanks", None, "2024-5", "no. 77", "számla 2024-5", "INV-2024-2023", "ref 1999-12345678 x", "INV-1899-000123", "INV-2024-00123456789", "12/2024", "INV 2024-77/1", "INV-20245-7"]


def test_references_of_a_table_are_read_as_one_by_one(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, reference string")
    got = {r["id"]: [tuple(t) for t in r["tokens"]] for r in pairs.with_refs(df, stored=True).collect()}
    lazily = {r["id"]: r["t"] and [tuple(t) for t in r["t"]] for r in df.select("id", refs_of(F.col("reference")).alias("t")).collect()}
    assert got == {k: extract_refs(t) for k, t in enumerate(TEXTS)} == lazily
    for held in (TEXTS, ["INV-2024-000123", "2024-5", "none"]):
        numbers = spark.createDataFrame(list(enumerate(held)), "id int, number string")
        read = pairs.with_token(numbers, stored=True)
        assert {r["id"]: (r["seq"], r["year"]) for r in read.collect()} == {k: (invoice_token(t) or (None, None))[:2] for k, t in enumerate(held)}
    assert "EvalPython" not in read._jdf.queryExecution().toString()


@pytest.mark.parametrize("budget", [50_000, 40])
def test_search_without_invoices_that_are_in_no_sum(spark, budget):
    r = random.Random(5)
    policy = Policy(search_node_budget=budget)
    paid = [Decimal(r.randint(2, 40)) for _ in range(60)]
    rows = [(f"p{k}", paid[k], f"i{k}-{n}", day(r.randint(0, 9)), Decimal(r.randint(1, 60)), r.random() < 0.3) for k in range(60) for n in range(r.choice([2, 3, 5, 8, 30]))]
    df = spark.createDataFrame(rows, "payment_id string, amount decimal(18,2), invoice_id string, issue_date date, balance decimal(18,2), hit boolean").withColumn("customer", F.lit(True))
    counted = candidates.with_counts(df, policy)
    width = candidates.ranked_width(counted, policy)
    got: dict = {}
    for s in candidates.search(width, policy).collect():
        got[s["payment_id"]] = ({tuple(s["items"][k]["invoice_id"] for k in p) for p in s["picks"]}, s["cut"])
    want = {}
    for p in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == p), key=lambda x: (not x[5], x[3], x[2]))[: policy.max_combination_candidates]
        owed, amount = [int(x[4] * 100) for x in own], int(own[0][1] * 100)
        bounds = {"most": policy.max_combination_size, "budget": budget, "results": policy.max_combinations_returned}
        found, cut = find_subsets(owed, amount, amount, **bounds) if sum(owed) >= amount else ([], False)
        if not found and sum(owed) >= amount:
            found, more = find_subsets(owed, amount, policy.widest_total(amount), **bounds)
            cut = cut or more
        if found or cut:
            want[p] = ({tuple(own[k][2] for k in f) for f in found}, cut)
    assert got == want and any(cut for _, cut in want.values()) == (budget == 40)
    assert (width.filter("eligible <= 24 and balance >= 2 * amount").count() == 0) == (budget == 50_000)


def test_hold_says_what_violations_say(spark):
    invoices, payments = frames(spark, *random_case(22, 30, 20))
    r = engine.reconcile(invoices, payments)
    whole = {"invoices": invoices, "payments": payments, "allocations": r.allocations, "fees": r.fees, "residuals": r.residuals, "states": r.invoice_states}
    one = r.allocations.orderBy("payment_id", "invoice_id").first()
    mine, other = F.col("payment_id") == one["payment_id"], F.col("invoice_id") == one["invoice_id"]
    broken = [
        {"allocations": r.allocations.withColumn("amount", F.when(mine, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(18,2)"))},
        {"allocations": r.allocations.withColumn("invoice_id", F.when(mine, "nobody").otherwise(F.col("invoice_id")))},
        {"residuals": spark.createDataFrame([("nobody", Decimal(1))], "payment_id string, amount decimal(18,2)")},
        {"states": r.invoice_states.filter(~other)},
        {"states": r.invoice_states.withColumn("status", F.when(other, "open").otherwise(F.col("status")))},
        {"payments": payments.withColumn("currency", F.when(F.col("id") == one["payment_id"], "CHF").otherwise(F.col("currency")))},
    ]
    assert invariants.hold(**whole) and not invariants.violations(**whole).head(1)
    for change in broken:
        assert invariants.violations(**(whole | change)).head(1) and not invariants.hold(**(whole | change)), change

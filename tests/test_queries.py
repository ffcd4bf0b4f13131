"""Queries over every payment against their SQL, on the smallest tables."""

from __future__ import annotations

from collections import Counter
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from quittance.operators import pairs
from quittance.plans.policy import Policy
from quittance.queries import ORACLE_SQL, QUERIES
from quittance.sources import derived

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_every_payment", "rank_every_payment", "tied_every_payment", "decide_every_payment", "review_every_payment", "decide_small_budget", "invoice_states", "run_report", "residuals", "inv_states", "inv_invoice_bounds", "allocation_view"])
def test_every_payment(spark, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        for t in ("orders", "customer"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
        said = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in said.description]
        want = Counter(said.fetchall())
    out = QUERIES[name](spark, SMALL)
    assert sorted(out.columns) == sorted(columns)
    assert want and Counter(tuple(r) for r in out.select(*columns).collect()) == want


def test_results_hold_every_payment_and_sums(spark):
    asked = derived.payments(spark, SMALL).count()
    report = QUERIES["run_report"](spark, SMALL).first()
    assert report["payments_total"] == asked and report["review_rate"] == report["payments_in_review"] / asked
    parts = Counter(r["payment_id"] for r in QUERIES["allocation_view"](spark, SMALL).select("payment_id").collect())
    assert max(parts.values()) > 1, "a sum of several invoices"
    cut = QUERIES["decide_small_budget"](spark, SMALL).filter("search_truncated").collect()
    assert cut and any(r["review_reason"] == "search_truncated" for r in QUERIES["decide_small_budget"](spark, SMALL).collect())


def test_no_payment_is_left_out(spark):
    asked = {r["id"] for r in derived.payments(spark, SMALL).select("id").collect()}
    decided = [r["payment_id"] for r in QUERIES["decide_every_payment"](spark, SMALL).select("payment_id").collect()]
    assert len(decided) == len(asked) and set(decided) == asked
    # several payments of one customer, and payments of strangers, are explained
    explained = {r["payment_id"] for r in QUERIES["score_every_payment"](spark, SMALL).select("payment_id").distinct().collect()}
    assert len(explained) > derived.single_payments(spark, SMALL).count()
    assert any(i.endswith("8") for i in explained)


def test_any_customer_in_the_whole_window(spark):
    p = derived.payments(spark, SMALL).select("id", "date", "currency").collect()
    i = derived.invoices(spark, SMALL).select("id", "issue_date", "currency").collect()
    first, last = timedelta(days=120), timedelta(days=5)
    want = Counter((x["id"], y["id"]) for x in p for y in i if x["currency"] == y["currency"] and x["date"] - first <= y["issue_date"] <= x["date"] + last)
    whole = QUERIES["eligible_any_customer_whole"](spark, SMALL)
    assert whole.columns == ["payment_id", "invoice_id"] and Counter(tuple(r) for r in whole.collect()) == want
    near = Counter((x["id"], y["id"]) for x in p for y in i if x["currency"] == y["currency"] and x["date"] - timedelta(days=1) <= y["issue_date"] <= x["date"])
    assert Counter(tuple(r) for r in QUERIES["eligible_any_customer"](spark, SMALL).collect()) == near
    # few rows make the pairs, but no task makes most of them
    tasks = [r["count"] for r in whole.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(tasks) < sum(tasks) / 4


def test_classes_of_any_customer(spark):
    p = derived.payments(spark, SMALL)
    i = derived.invoices(spark, SMALL)
    want = Counter(tuple(r) for r in QUERIES["eligible_any_customer_whole"](spark, SMALL).collect())
    rows = pairs.by_currency_classes(p, i, Policy(require_customer_match=False)).collect()
    of = {kind: {r["id"]: r["of"] for r in rows if r["kind"] == kind} for kind in ("payment", "invoice")}
    inside = {kind: {c: [x for x, y in held.items() if y == c] for c in set(held.values())} for kind, held in of.items()}
    found = Counter((x, y) for r in rows if r["kind"] == "pair" for x in inside["payment"][r["id"]] for y in inside["invoice"][r["of"]])
    assert found == want
    for kind, place, side in (("payment", 0, p), ("invoice", 1, i)):
        own = Counter(pair[place] for pair in want)
        assert {r["id"]: r["links"] for r in rows if r["kind"] == kind} == {r["id"]: own[r["id"]] for r in side.select("id").collect()}
    assert sum(r["links"] for r in rows if r["kind"] == "pair") == len(want)


@pytest.mark.parametrize("name", ["invoice_tokens", "ref_tokens", "ref_evidence_exact", "ref_evidence_fuzzy", "eligible_by_token", "score_every_payment", "rank_every_payment", "decide_small_budget", "eligible_any_customer", "eligible_any_customer_whole"])
def test_keys_beyond_six_digits(spark, tmp_path, name):
    """Orders whose keys are far apart but begin with the same six digits, others of six digits: each number names one invoice."""
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        key = "CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 998500 ELSE 30000000 + o_orderkey END"
        db.execute(f"COPY (SELECT * REPLACE ({key} AS o_orderkey) FROM '{SMALL}/orders.parquet') TO '{tmp_path}/orders.parquet'")
        db.execute(f"COPY (FROM '{SMALL}/customer.parquet') TO '{tmp_path}/customer.parquet'")
        for t in ("orders", "customer"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        said = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in said.description]
        want = Counter(said.fetchall())
    out = QUERIES[name](spark, str(tmp_path))
    assert want and Counter(tuple(r) for r in out.select(*columns).collect()) == want

"""Candidates made where the pairs of a payment are: the same as those made step by step, without further exchanges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quittance.operators import candidates, pairs, resolve
from quittance.plans.policy import Policy
from quittance.plans.scratch import written
from tests.test_engine import frames, random_case

SHOWN = ("payment_id", "strategy", "invoice_ids", "n", "named", "allocated", "fee", "residual")


def sides(spark, policy):
    invoices, payments = frames(spark, *random_case(31, 200, 12))
    known = resolve.resolve(pairs.with_refs(payments), invoices, policy.fuzzy_ref_threshold, fuzzy=False)
    return written(known, "payments"), written(pairs.with_token(invoices), "invoices")


def rows(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


@pytest.mark.parametrize("policy", [Policy(), Policy(search_node_budget=4), Policy(allow_combinations=False), Policy(require_customer_match=False, date_window_days_after=20)])
def test_candidates_in_one_pass_are_those_of_the_steps(spark, monkeypatch, policy):
    p, i = sides(spark, policy)
    found = pairs.evidence(pairs.eligible(p, i, policy), policy, fuzzy=False).withColumn("customer", F.col("resolved").isNotNull())
    counted = candidates.with_counts(found, policy)
    want, cut = candidates.singles(counted, policy), set()
    if policy.allow_combinations:
        searched = candidates.search(candidates.ranked_width(counted, policy), policy)
        want = want.select(*SHOWN).unionByName(candidates.combinations(searched, policy).select(*SHOWN))
        cut = {r["payment_id"] for r in searched.filter("cut").collect()}
    want = rows(want)
    kinds = {r[1] for r in want}
    assert "exact_single" in kinds and (policy != Policy() or "combination" in kinds) and bool(cut) == (policy.search_node_budget == 4)
    everyone = {r["id"] for r in p.collect()}
    for most in (pairs.MOST, 2) if policy == Policy() else (pairs.MOST,):  # with crowded customers, too
        monkeypatch.setattr(pairs, "MOST", most)
        got = written(candidates.explained(pairs.considered(p, i, policy), policy, best=False), "got")
        assert rows(got.filter("strategy is not null")) == want
        first = got.filter("rank = 1").collect()
        assert sorted(r["payment_id"] for r in first) == sorted(everyone)
        assert {r["payment_id"] for r in first if r["cut"]} == cut
        assert all(sum(x["amount"] for x in r["parts"]) == r["allocated"] and sum(x["fee"] for x in r["parts"]) == r["fee"] for r in first if r["strategy"])
        best = written(candidates.explained(pairs.considered(p, i, policy), policy), "best").filter("points = top")
        assert rows(best) == rows(got.filter("points = top"))


def test_a_payment_stays_where_its_pairs_are(spark):
    p, i = sides(spark, Policy())
    met, keys = pairs.considered(p, i, Policy())[0]
    plan = candidates._ranked_singles(met, Policy(), keys, True)._jdf.queryExecution().executedPlan().toString()
    assert keys and plan.count("Exchange ") <= 2, plan  # those of the join
    assert "EvalPython" not in plan and "MapInArrow" not in plan

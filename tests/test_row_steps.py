"""What is counted, searched and ranked of a payment is made in its row."""

from __future__ import annotations

import random

from quittance.functions.subsets import find_subsets, some_add_up
from quittance.operators import candidates, pairs
from quittance.plans.policy import Policy
from tests.test_one_pass import sides


def test_nothing_is_dealt_out_or_sorted_for_ranks(spark):
    p, i = sides(spark, Policy())
    met = pairs.considered(p, i, Policy())
    found = candidates.explained(met, Policy())
    plan = found.filter("points = top and tied > 1")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("ArrowEvalPython") == len(met) and "MapInArrow" not in plan, plan


def test_rows_that_add_up_are_those_with_a_sum():
    r = random.Random(3)
    rows = [[r.randint(1, 40) for _ in range(r.randint(0, 14))] for _ in range(400)]
    low = [r.randint(2, 160) for _ in rows]
    high = [a + r.randint(0, 3) for a in low]
    for most in (2, 4):
        got = some_add_up(rows, low, high, most)
        want = [bool(find_subsets(a, x, y, most=most)[0]) for a, x, y in zip(rows, low, high, strict=True)]
        assert all(g or not w for g, w in zip(got, want, strict=True))
        assert all(g == w for g, w, a in zip(got, want, rows, strict=True) if len(a) <= 12) and not all(want)

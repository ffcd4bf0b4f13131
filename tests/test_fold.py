"""The ordered fold on the hard cases, and the laws it must keep."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quittance.functions.text import extract_refs, invoice_token
from quittance.plans.fold import Component, Line, OpenInvoice
from quittance.plans.policy import Policy


def inv(i, amount, customer="c1", day=0, currency="EUR", number=None):
    number = number or f"INV-2026-{i:04d}"
    token = invoice_token(number)
    return OpenInvoice(f"i{i}", customer, number, day, round(amount * 100), currency, token and token[:2])


def pay(i, amount, reference="", day=20, currency="EUR", customer="c1"):
    return Line(f"p{i}", day, round(amount * 100), currency, reference, customer, [t[:2] for t in extract_refs(reference)])


def run(invoices, payments, policy=Policy()):
    c = Component(policy)
    for x in invoices:
        c.add(x)
    return {p.id: c.decide(p) for p in sorted(payments, key=lambda p: (p.day, p.id))}, c


@pytest.mark.parametrize(
    ("invoices", "payment", "policy", "status", "strategy", "review"),
    [
        ([(1, 1000)], (1, 1000, "szamla 1"), {}, "matched", "exact_single", None),
        ([(1, 1000)], (1, 17.5, "rent"), {}, "review", None, "below_threshold"),
        ([(1, 1000, "c1", -200)], (1, 1000), {}, "unmatched", None, "no_candidate"),
        ([(1, 1000)], (1, 1000, "", 20, "HUF"), {}, "unmatched", None, "no_candidate"),
        ([(1, 300)], (1, 500, "szamla 1"), {}, "partially_matched", "overpayment", None),
        ([(1, 1000)], (1, 971, "szamla 1"), {}, "matched", "fee_tolerance", None),
        ([(1, 1000)], (1, 969, "szamla 1"), {}, "matched", "partial", None),
        ([(1, 1000)], (1, 999.99, "szamla 1"), {"fee_tolerance_pct": Decimal(0), "fee_tolerance_abs": Decimal(0)}, "matched", "partial", None),
        ([(1, 100), (2, 200), (3, 300)], (1, 600, "szamla 1 and szamla 2 and szamla 3"), {}, "matched", "combination", None),
        ([(1, 100), (2, 200)], (1, 295, "szamla 1 and szamla 2"), {}, "matched", "combination", None),
        ([(1, 500), (2, 500)], (1, 500), {}, "review", None, "ambiguous"),
        ([(1, 1000)], (1, 971), {}, "review", None, "below_threshold"),
        ([(1, 500), (2, 640)], (1, 500), {}, "matched", "exact_single", None),
        ([(1, 500, "c1"), (2, 500, "c2")], (1, 500, "", 20, "EUR", "c2"), {}, "matched", "exact_single", None),
        ([(1, 500)], (1, 500, "szamla 1", 20, "EUR", None), {}, "matched", "exact_single", None),
        ([(1, 500)], (1, 500, "", 20, "EUR", None), {}, "unmatched", None, "no_candidate"),
    ],
)
def test_cases(invoices, payment, policy, status, strategy, review):
    out, _ = run([inv(*x) for x in invoices], [pay(*payment)], Policy(**policy))
    o = out["p1"]
    assert (o.status, o.chosen and o.chosen.strategy, o.review) == (status, strategy, review)


def test_fees_split_and_running_balances():
    out, c = run([inv(1, 100), inv(2, 200)], [pay(1, 295, "szamla 1 and szamla 2")])
    assert sum(f for _, _, f in out["p1"].chosen.parts) == 500 and all(x.balance == 0 for x in c.by_id.values())
    out, c = run([inv(1, 300)], [pay(1, 200, "szamla 1", 20), pay(2, 100, "szamla 1", 21)])
    assert [out[p].chosen.strategy for p in ("p1", "p2")] == ["partial", "exact_single"] and c.by_id["i1"].balance == 0


def test_ties_follow_the_policy():
    resolve = {"ambiguity_policy": "resolve_by_policy", "confidence_threshold": Decimal("0.5")}
    for tie, first in (("oldest_first", "i1"), ("newest_first", "i2")):
        out, _ = run([inv(1, 500, day=0), inv(2, 500, day=3)], [pay(1, 500)], Policy(tie_break=tie, **resolve))
        assert out["p1"].chosen.invoices == [first]


def test_near_misses_count_only_without_exact_ones():
    out, _ = run([inv(42, 500), inv(142, 500)], [pay(1, 500, "INV-2026-0042")])
    assert out["p1"].chosen.invoices == ["i42"]
    out, _ = run([inv(42, 1000), inv(77, 1500)], [pay(1, 1000, "INV-2026-004")])
    assert out["p1"].chosen.invoices == ["i42"] and "reference" in out["p1"].chosen.reasons[0]


def test_budget_is_told():
    many = [inv(k, 10 * k + 0.01) for k in range(1, 25)]
    out, _ = run(many, [pay(1, 87)], Policy(search_node_budget=5))
    assert out["p1"].truncated and out["p1"].review == "search_truncated"


ledgers = st.lists(st.tuples(st.integers(1, 40), st.sampled_from(["c1", "c2", "c3"]), st.integers(-30, 10), st.sampled_from(["EUR", "HUF"])), max_size=8)
lines = st.lists(st.tuples(st.integers(1, 80), st.integers(0, 8), st.integers(0, 30), st.sampled_from(["EUR", "HUF"]), st.sampled_from(["c1", "c2", "c3", None])), max_size=6)
policies = st.builds(Policy, tie_break=st.sampled_from(["oldest_first", "newest_first", "largest_first", "smallest_first"]), ambiguity_policy=st.sampled_from(["review", "resolve_by_policy"]), confidence_threshold=st.sampled_from([Decimal("0.5"), Decimal("0.8")]))


@given(ledgers, lines, policies, st.randoms())
@settings(max_examples=200, deadline=None)
def test_laws(ledger, statement, policy, r):
    def build():
        return [inv(k, a, c, d, u) for k, (a, c, d, u) in enumerate(ledger, 1)], [pay(k, a, f"szamla {n}" if n else "", d, u, c) for k, (a, n, d, u, c) in enumerate(statement, 1)]

    invoices, payments = build()
    out, c = run(invoices, payments, policy)
    again, more = build()
    r.shuffle(again)
    r.shuffle(more)
    out2, _ = run(again, more, policy)
    assert {k: (o.status, o.chosen and o.chosen.parts) for k, o in out.items()} == {k: (o.status, o.chosen and o.chosen.parts) for k, o in out2.items()}
    by = {p.id: p for p in payments}
    assert set(out) == set(by)
    for k, o in out.items():
        if o.chosen:
            assert sum(a for _, a, _ in o.chosen.parts) + o.chosen.residual == by[k].amount
            assert all(a > 0 and f >= 0 and c.by_id[i].currency == by[k].currency and -120 <= c.by_id[i].day - by[k].day <= 5 for i, a, f in o.chosen.parts)
    taken = {}
    for o in out.values():
        for i, a, f in o.chosen.parts if o.chosen else []:
            taken[i] = taken.get(i, 0) + a + f
    assert all(0 <= x.balance == x.face - taken.get(x.id, 0) for x in c.by_id.values())


def test_components_commute():
    """Folding each customer and currency by itself gives what one pass over everything gives."""
    r = random.Random(4)
    for _ in range(40):
        invoices = [(k, r.randint(1, 9) * 100, r.choice(["c1", "c2"]), r.randint(-20, 0), r.choice(["EUR", "HUF"])) for k in range(1, 10)]
        payments = [(k, r.randint(1, 12) * 100, r.choice(["", f"szamla {r.randint(1, 9)}"]), r.randint(1, 30), r.choice(["EUR", "HUF"]), r.choice(["c1", "c2"])) for k in range(1, 10)]
        whole, _ = run([inv(*x) for x in invoices], [pay(*x) for x in payments])
        parts = {}
        for c in ("c1", "c2"):
            for u in ("EUR", "HUF"):
                parts |= run([inv(*x) for x in invoices if x[2] == c and x[4] == u], [pay(*x) for x in payments if x[5] == c and x[4] == u])[0]
        assert {k: (o.status, o.chosen and o.chosen.parts) for k, o in whole.items()} == {k: (o.status, o.chosen and o.chosen.parts) for k, o in parts.items()}

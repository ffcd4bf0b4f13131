"""Text, confidence, subsets, policy and mapping without Spark."""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quittance.functions.confidence import CEILING, Evidence, points, reasons
from quittance.functions.subsets import apportion, find_subsets
from quittance.functions.text import canonical, extract_refs, invoice_token, similarity, tokens_meet
from quittance.plans.parsers import ChainParser, ModelParser, RuleParser, sane_tokens
from quittance.plans.policy import Policy
from quittance.sources.mapping import corrected, fill_gaps, normalise, propose, sorted_ratio


@pytest.mark.parametrize(
    ("text", "seq", "year"),
    [
        ("INV-2026-0007", 7, 2026), ("2026/0007", 7, 2026), ("0007/2026", 7, 2026), ("szamla 7", 7, None), ("számla 7", 7, None), ("#7", 7, None), ("paid INV-2026-0007, thanks", 7, 2026),
        ("Rechnung Nr. 0007/2026", 7, 2026), ("20260007", 7, 2026), ("INV2026007", 7, 2026), ("no. 7", 7, None), ("invoice 2026", 2026, None), ("2026-01-25", 1, 2026), ("42 43", 42, None), ("1999 2001", 1999, None),
    ],
)
def test_references(text, seq, year):
    assert extract_refs(text)[0][:2] == (seq, year)


def test_reference_lists():
    assert [t[:2] for t in extract_refs("ref 42 and 43")] == [(42, None), (43, None)]
    assert [t[:2] for t in extract_refs("order 9 invoice 2026/0007")][0] == (7, 2026)
    for nothing in ("", None, "rent", "DE89370400440532013000123"):
        assert extract_refs(nothing) == []
    # the better evidence replaces the token, the first place stays
    assert extract_refs("7 xxxxxxxxxxxxxxxxxx invoice 7")[0] == (7, None, "7", True)
    assert invoice_token("OPENING") is None and invoice_token("INV-2026-0042")[:2] == (42, 2026)
    assert tokens_meet(4, None, 4, 2020) and not tokens_meet(4, 2021, 4, 2020) and not tokens_meet(3, None, 4, None)


def test_similarity():
    assert canonical("Számla-2026/0042") == "SZAMLA20260042"
    assert similarity("INV-2026-0042", "INV-2026-0142") == 90
    assert similarity("INV-2026-0042", "ref INV2026-0042 thanks") == 100
    assert similarity("INV-2026-0042", "paid inv 2026 0043 sorry") < 100
    assert similarity("42", "invoice 1042") == 0 and similarity("INV-2026-0042", "") == 0
    assert similarity("INV-2026-0042", "2") == 100  # a short second text may score high


@given(st.text("ABC1", min_size=5, max_size=9), st.text("ABC1", min_size=1, max_size=12))
@settings(max_examples=200, deadline=None)
def test_similarity_is_the_best_window(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for k, e in enumerate(y, 1):
                last, row[k] = row[k], last + 1 if c == e else max(row[k], row[k - 1])
        return row[-1]

    def best(n, h):
        return max(200 * lcs(n, h[max(0, k) : k + len(n)]) / (len(n) + len(h[max(0, k) : k + len(n)])) for k in range(1 - len(n), len(h)))

    want = max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len))
    assert similarity(a, b) == int(want + 1e-9)


def test_points():
    assert points(Evidence("exact_single", named=1, customer=True, unique=True, sole=True)) == CEILING
    assert points(Evidence("exact_single", customer=True, unique=True)) == 8600
    assert points(Evidence("partial", customer=True)) == 5600
    assert points(Evidence("fee_tolerance", named=1, customer=True, unique=True, shortfall=1, tolerance=3)) == 10300 - 200 - 200
    assert points(Evidence("combination", 3, 1, customer=True, unique=True)) == 6200 + 533 + 600 + 1000 - 800
    assert points(Evidence("combination", 2, 0, unique=True, truncated=True)) == 5800
    assert reasons(Evidence("combination", 3, 1))[0] == "combination of 3 invoices, reference matched 0 of 3"
    assert reasons(Evidence("combination", 3, 2))[0].endswith("matched 2 of 3")


@given(st.lists(st.integers(1, 30), max_size=8), st.integers(1, 60), st.integers(0, 5), st.integers(2, 4))
@settings(max_examples=300, deadline=None)
def test_subsets_are_all_found(amounts, target, slack, most):
    got, cut = find_subsets(amounts, target, target + slack, most=most, results=10**6)
    n = len(amounts)
    want = [c for k in range(2, most + 1) for c in combinations(range(n), k) if target <= sum(amounts[i] for i in c) <= target + slack]
    assert got == sorted(want, key=lambda s: (len(s), s)) and not cut


def test_subset_bounds():
    assert find_subsets([1, 1, 1, 1], 2, 2, results=2)[0] == [(0, 1), (0, 2)]
    assert find_subsets(list(range(100, 124)), 5000, 5000, budget=5) == ([], False)
    assert find_subsets([10 * k + 1 for k in range(1, 25)], 87, 87, budget=5)[1]
    with pytest.raises(ValueError):
        find_subsets([0, 1], 1, 1)


@given(st.integers(0, 10**6), st.lists(st.integers(1, 10**7), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_apportion_keeps_every_cent(amount, weights):
    parts = apportion(amount, weights)
    assert sum(parts) == amount and all(abs(p * sum(weights) - amount * w) < sum(weights) for p, w in zip(parts, weights, strict=True))


def test_policy():
    assert Policy().tolerance_cents(3350) == 100 and Policy().tolerance_cents(3450) == 104  # halves go to the even cent
    assert Policy(fee_tolerance_cap=Decimal("2")).tolerance_cents(10**6) == 200
    assert Policy.from_json('{"fee_tolerance_pct": 0.05, "tie_break": "largest_first"}').fee_tolerance_pct == Decimal("0.05")
    for bad in ({"fee_tolerance_pct": "1"}, {"max_combination_size": 1}, {"tie_break": "best"}, {"surprise": 1}, {"fuzzy_ref_threshold": 101}):
        with pytest.raises(ValueError):
            Policy.from_mapping(bad)


def test_parsers():
    class Broken:
        def __call__(self, text):
            raise RuntimeError(text)

    found = ChainParser((RuleParser(), ModelParser(lambda t: [{"seq": 9, "year": 1500}, {"seq": -1}, {"seq": 9}])))
    assert found.parse("INV-2026-0007").tokens == ((7, 2026),) and found.parse("INV-2026-0007").model_calls == 0
    said = found.parse("the ninth")
    assert said.tokens == ((9, None),) and said.model_calls == 1
    broken = ModelParser(Broken()).parse("x")
    assert (broken.tokens, broken.source, broken.model_calls) == ((), "model:error", 1)
    assert sane_tokens([{"seq": 10**8}, {"seq": True}, {"seq": "3"}]) == ()
    with pytest.raises(ValueError):
        ChainParser(())


def test_mapping():
    assert normalise("InvoiceDate") == "invoice date" and normalise("Számla_szám") == "szamla szam" and normalise("ID") == "id"
    p = propose(["ContactName", "Invoice Number", "InvoiceDate", "DueDate", "Total", "Currency", "AccountCode", "Reference", "Sent"], "invoice")
    assert p.filled() == {"id": "Reference", "customer_id": "AccountCode", "customer_name": "ContactName", "number": "Invoice Number", "issue_date": "InvoiceDate", "due_date": "DueDate", "amount": "Total", "currency": "Currency"}
    assert not p.gaps() and not p.doubtful()
    q = propose(["Transaction ID", "Booking Date", "Credit Amount", "Ccy", "Remittance Information", "Payer Name"], "payment")
    assert q.filled()["reference"] == "Remittance Information" and q.filled()["counterparty"] == "Payer Name"
    near = propose(["id", "date", "amuont", "currency"], "payment")
    assert near.doubtful() and (near.gaps() == ["amount"] or near.sources["amount"] == ("amuont", "fuzzy"))
    changed = corrected(p, {"amount": "Sent", "number": "Nowhere", "due_date": " Sent "})
    assert changed.sources["due_date"] == ("Sent", "manual") and changed.gaps() == ["number", "amount"] and changed.sources["id"] == ("Reference", "alias")
    assert corrected(p, {}) == p
    gap = propose(["ident", "when", "how much", "cur"], "payment")
    filled = fill_gaps(gap, lambda kind, wanted, free: {"id": "ident", "date": "when", "amount": "how much", "reference": "cur", "currency": "cur"})
    assert not filled.gaps() and {how for t, (_, how) in filled.sources.items() if t in ("id", "date", "amount")} == {"model"} and "reference" not in filled.filled()
    assert fill_gaps(gap, lambda *a: 1 / 0) == gap == fill_gaps(gap, lambda *a: {"id": "elsewhere"})
    assert set(fill_gaps(gap, lambda *a: dict.fromkeys(gap.gaps(), "cur")).filled()) >= set(gap.filled())
    assert sorted_ratio("a b", "b a") == 100.0


def test_plain_references_are_read_alike(spark):
    """What built-in functions read of references and numbers is what the parser reads, years at their bounds, long runs and other letters included."""
    from quittance.functions.text import YEARS, extract_refs, invoice_token, invoice_token_of, refs_of

    years = [1989, YEARS[0], 1999, 2000, 2024, 2099, YEARS[-1], 2101, 9999]
    runs = ["0", "7", "1990", "2100", "2101", "0199", "1999", "19991", "123456", "2024123", "12345678", "20240001", "123456789"]
    texts = [f"{a}{y}-{r}{b}" for a in ("", "INV-", "paid\n no ", "re: szamla, see the letter ", "ár ", "x١") for y in years for r in runs for b in ("", " thanks\n", "-", " ű")]
    texts += ["", " ", "none", "é", "INV-2024-1 INV-2024-2", "2024-1 2", "2024/17", "a1990b", None, "٣", "INV-1995-000001 INV-1995-000001"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(3)
    got = {r["i"]: r for r in df.select("i", refs_of(df["t"]).alias("refs"), invoice_token_of(df["t"]).alias("own")).collect()}
    for i, t in enumerate(texts):
        assert [tuple(x) for x in got[i]["refs"]] == extract_refs(t), t
        own = invoice_token(t)
        assert (got[i]["own"] and tuple(got[i]["own"])) == (own and own[:2]), t


def test_nobody_is_looked_for_by_similar_name_when_all_are_known(spark, monkeypatch):
    from quittance.operators import resolve

    monkeypatch.setattr(resolve, "similar_pairs", lambda *a, **k: pytest.fail("names were compared"))
    i = spark.createDataFrame([("c1", "Alpha Trade"), ("c2", "Beta Works"), ("c3", "Twin"), ("c4", "Twin")], "customer_id string, customer_name string")
    p = spark.createDataFrame([("p1", "ALPHA TRADE", None), ("p2", "", "c2"), ("p3", "", None), ("p4", None, ""), ("p5", "beta works", "c1")], "id string, counterparty string, customer_id string")
    assert {r["id"]: r["resolved"] for r in resolve.resolve(p, i, 88).collect()} == {"p1": "c1", "p2": "c2", "p3": None, "p4": None, "p5": "c1"}

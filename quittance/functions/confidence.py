"""Confidence in basis points, exactly, and the reasons that go with it."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, in basis points.
#: What each kind of explanation is worth by itself.
BASE = {"exact_single": 7000, "combination": 6200, "fee_tolerance": 5800, "partial": 5000, "overpayment": 4800}
ALL_NAMED, SOME_NAMED = 2900, 1600
CUSTOMER_KNOWN, UNIQUE, SOLE = 600, 1000, 400
PER_EXTRA_INVOICE, WHOLE_FEE = 400, 600
CEILING = 9900

# The phrases of reasons and messages.
HEADLINE = {
    "exact_single": "exact amount",
    "fee_tolerance": "amount within fee tolerance",
    "combination": "combination of {n} invoices",
    "partial": "part payment, invoice stays open",
    "overpayment": "pays the invoice in full and leaves a residual",
}
NO_CUSTOMER = "customer not identified from the bank line"
NOTHING_ELSE = "no other invoice or combination explains this amount"
OUT_OF_BUDGET = "combination search hit its budget, so uniqueness is unproven"
ONLY_ONE_OPEN = "only one invoice was open for this customer"
NOTHING_FITS = "no open invoice matches this payment"
BUDGET_SPENT = "combination search hit its budget before finding an explanation"
TIED = "{n} allocations explain this payment equally well (confidence {confidence}); the engine will not choose between them"
TOO_LOW = "best explanation scored {confidence}, below the {threshold} threshold: {reason}"
RUN_WARNING = "{n} payment(s) hit the combination search budget ({budget} nodes); results for those are not proven unique"


@dataclass(frozen=True)
class Evidence:
    strategy: str
    invoices: int = 1
    named: int = 0
    customer: bool = False
    unique: bool = False
    sole: bool = False
    shortfall: int = 0
    tolerance: int = 0
    truncated: bool = False


def points(e: Evidence) -> int:
    """Half-up rounded basis points between 0 and CEILING, in whole numbers throughout."""
    n, m, t = e.invoices, e.named, e.tolerance if e.shortfall > 0 and e.tolerance > 0 else 1
    short = e.shortfall if e.tolerance > 0 else 0
    whole = BASE[e.strategy] + ALL_NAMED * (m >= n) + CUSTOMER_KNOWN * e.customer + UNIQUE * (e.unique and not e.truncated) + SOLE * e.sole - PER_EXTRA_INVOICE * (n - 1)
    top = whole * n * t + SOME_NAMED * m * t * (0 < m < n) - WHOLE_FEE * short * n
    return min(max((2 * top + n * t) // (2 * n * t), 0), CEILING)


def _named_of(m: int, n: int) -> int:
    """How many invoices the headline says were named: the coverage, kept to 28 digits, times n, cut off."""
    return int(Decimal(m) / Decimal(n) * n)


def reasons(e: Evidence) -> list[str]:
    said = HEADLINE[e.strategy].format(n=e.invoices)
    if e.named >= e.invoices:
        said += " and reference" if e.invoices == 1 else f", reference matched all {e.invoices}"
    elif e.named:
        said += f", reference matched {_named_of(e.named, e.invoices)} of {e.invoices}"
    else:
        said += ", no reference"
    out = [said]
    if not e.customer:
        out.append(NO_CUSTOMER)
    if e.truncated:
        out.append(OUT_OF_BUDGET)
    elif e.unique:
        out.append(NOTHING_ELSE)
    if e.sole:
        out.append(ONLY_ONE_OPEN)
    return out


# --- columns: single-invoice candidates and combinations alike ---------------------------


def points_of(strategy: Column, n: Column, m: Column, customer: Column, unique: Column, sole: Column, shortfall: Column, tolerance: Column) -> Column:
    """points() for columns without search truncation; n and m are integers, money columns whole cents.  Only a fee or a part of the invoices named needs wide decimals."""
    yes = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0))
    base = F.element_at(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv]), strategy)
    charged = (shortfall > 0) & (tolerance > 0)
    t = F.when(charged, tolerance).otherwise(F.lit(1))
    whole = base + yes(m >= n, ALL_NAMED) + yes(customer, CUSTOMER_KNOWN) + yes(unique, UNIQUE) + yes(sole, SOLE) - PER_EXTRA_INVOICE * (n - 1)
    simple = ~charged & ((m == 0) | (m >= n))
    small, (n, m) = whole, [c.cast("decimal(10,0)") for c in (n, m)]
    whole = small.cast("decimal(10,0)")
    top = whole * n * t + yes((m > 0) & (m < n), SOME_NAMED) * m * t - F.when(charged, shortfall).otherwise(F.lit(0)) * WHOLE_FEE * n
    rounded = F.floor((2 * top + n * t).cast("decimal(38,0)") / (2 * n * t).cast("decimal(38,0)"))
    return F.least(F.greatest(F.when(simple, small).otherwise(rounded.cast("int")), F.lit(0)), F.lit(CEILING)).cast("int")


def headline_of(strategy: Column, n: Column, m: Column) -> Column:
    """First reason of a candidate."""
    told = m
    for b in range(2, 25):  # where the coverage, kept to 28 digits, times n stays below the count
        for a in range(1, b):
            if _named_of(a, b) != a:
                told = F.when((m == a) & (n == b), _named_of(a, b)).otherwise(told)
    phrase = F.when((m >= n) & (n == 1), " and reference").when(m >= n, F.concat(F.lit(", reference matched all "), n.cast("string")))
    phrase = phrase.when(m > 0, F.concat(F.lit(", reference matched "), told.cast("string"), F.lit(" of "), n.cast("string"))).otherwise(", no reference")
    head = F.element_at(F.create_map(*[F.lit(x) for kv in HEADLINE.items() for x in kv]), strategy)
    return F.concat(F.replace(head, F.lit("{n}"), n.cast("string")), phrase)


def filled(template: str, **parts: Column) -> Column:
    """A fixed phrase with columns in its places."""
    import string

    out = []
    for text, name, _, _ in string.Formatter().parse(template):
        out += [F.lit(text)] * bool(text) + ([parts[name].cast("string")] if name else [])
    return F.concat(*out)

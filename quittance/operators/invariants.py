"""The laws of money, each a frame of (check, key, message) rows that must be empty."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.errors import InvariantViolation
from quittance.functions.money import MONEY
from quittance.plans.scratch import some


def _sums(df: DataFrame, key: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.sum("amount").cast(MONEY).alias(name))


def _say(check: str, key: Column, *parts: Column | str) -> list[Column]:
    return [F.lit(check).alias("check"), key.alias("key"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("message")]


def references(allocations: DataFrame, fees: DataFrame, residuals: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Rows that cite a payment or an invoice nobody knows."""

    def unknown(df: DataFrame, what: str, column: str, known: DataFrame, kind: str) -> DataFrame:
        lost = df.join(known.select(F.col("id").alias(column)), column, "left_anti")
        return lost.select(*_say("references", F.col(column), f"{what} cites unknown {kind} ", F.col(column)))

    return (
        unknown(allocations, "allocation", "payment_id", payments, "payment")
        .unionByName(unknown(allocations, "allocation", "invoice_id", invoices, "invoice"))
        .unionByName(unknown(fees, "fee", "invoice_id", invoices, "invoice"))
        .unionByName(unknown(residuals, "residual", "payment_id", payments, "payment"))
    )


def payment_conservation(allocations: DataFrame, residuals: DataFrame, payments: DataFrame) -> DataFrame:
    """Payments whose allocations and residual do not add up to what arrived."""
    d = payments.select(F.col("id").alias("key"), "amount").join(_sums(allocations, "payment_id", "a"), "key", "left").join(_sums(residuals, "payment_id", "r"), "key", "left").na.fill(0, ["a", "r"])
    used = (F.col("a") + F.col("r")).cast(MONEY)
    return d.filter(used != F.col("amount")).select(*_say("payment_conservation", F.col("key"), "payment ", F.col("key"), ": allocated ", F.col("a"), " + residual ", F.col("r"), ", but ", F.col("amount"), " arrived"))


def invoice_bounds(allocations: DataFrame, fees: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoices that got more than their face value."""
    d = invoices.select(F.col("id").alias("key"), "amount").join(_sums(allocations, "invoice_id", "a"), "key", "left").join(_sums(fees, "invoice_id", "f"), "key", "left").na.fill(0, ["a", "f"])
    return d.filter((F.col("a") + F.col("f")).cast(MONEY) > F.col("amount")).select(*_say("invoice_bounds", F.col("key"), "invoice ", F.col("key"), ": allocated ", F.col("a"), " + fees ", F.col("f"), " exceeds face value ", F.col("amount")))


def invoice_states(states: DataFrame, invoices: DataFrame) -> DataFrame:
    """States that do not add up, contradict their status, belong to no invoice, or are missing."""
    s = states.select(F.col("invoice_id").alias("key"), "status", "allocated", F.col("fee_written_off").alias("fee"), F.col("open_balance").alias("open"))
    d = s.join(invoices.select(F.col("id").alias("key"), F.col("amount").alias("face")), "key", "full")
    wrong = F.when(F.col("face").isNull(), "state of an unknown invoice").otherwise(_state_fault(*[F.col(c) for c in ("face", "status", "allocated", "fee", "open")]))
    return d.withColumn("wrong", wrong).filter("wrong is not null").select(*_say("invoice_states", F.col("key"), "invoice ", F.col("key"), ": ", F.col("wrong")))


def global_conservation(allocations: DataFrame, residuals: DataFrame, payments: DataFrame) -> DataFrame:
    """A row if allocations and residuals of the run do not add up to all that arrived."""
    one = lambda df, name: df.agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias(name))
    d = one(allocations, "a").join(one(residuals, "r")).join(one(payments, "p"))
    return d.filter((F.col("a") + F.col("r")).cast(MONEY) != F.col("p")).select(*_say("global_conservation", F.lit("run"), "run total: allocated ", F.col("a"), " + residual ", F.col("r"), ", but ", F.col("p"), " arrived"))


def currency_alignment(allocations: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Allocations between different currencies."""
    d = allocations.join(invoices.select(F.col("id").alias("invoice_id"), F.col("currency").alias("to")), "invoice_id").join(payments.select(F.col("id").alias("payment_id"), F.col("currency").alias("from")), "payment_id")
    key = F.concat("payment_id", F.lit("->"), "invoice_id")
    return d.filter(F.col("from") != F.col("to")).select(*_say("currency_alignment", key, "allocation ", key, " crosses currencies ", F.col("from"), "->", F.col("to"), "; FX is out of scope"))


def _state_fault(face: Column, status: Column, allocated: Column, fee: Column, open_: Column) -> Column:
    """What is wrong with the state of a known invoice, or null."""
    zero = F.lit(0)
    return (
        F.when(status.isNull(), "no state reported")
        .when((allocated + fee + open_).cast(MONEY) != face, "state does not add up to the face value")
        .when(open_ < zero, "negative open balance")
        .when((status == "paid") & ((allocated != face) | (fee != zero)), "paid, but not allocated in full without fee")
        .when((status == "settled_with_fee") & (fee <= zero), "settled_with_fee, but no fee recorded")
        .when((status == "settled_with_fee") & (open_ != zero), "settled_with_fee, but still open")
        .when((status == "partially_paid") & ~((allocated > zero) & (allocated < face)), "partially_paid, but nothing or everything allocated")
        .when((status == "open") & ((allocated != zero) | (fee != zero)), "open, but money is allocated")
    )


def hold(invoices: DataFrame, payments: DataFrame, allocations: DataFrame, fees: DataFrame, residuals: DataFrame, states: DataFrame) -> bool:
    """Whether a result breaks no law: what violations() says of it, without naming what is broken.

    All rows on a payment meet in one group, and all on an invoice, so each side is dealt out
    once for all laws.  Where every payment adds up and none is unknown, so does the run.
    """
    zero = F.lit(0).cast(MONEY)

    def side(df: DataFrame, key: str, known: int, **money: str) -> DataFrame:
        names = ("face", "a", "f", "r", "state_a", "state_f", "state_open")
        return df.select(F.col(key).alias("key"), F.lit(known).alias("known"), F.col("status") if "state_a" in money else F.lit(None).cast("string").alias("status"), *[(F.col(money[n]).cast(MONEY) if n in money else zero).alias(n) for n in names])

    def together(*sides: DataFrame) -> DataFrame:
        all_ = functools.reduce(DataFrame.unionByName, sides)
        total = [F.sum(n).cast(MONEY).alias(n) for n in ("face", "a", "f", "r", "state_a", "state_f", "state_open")]
        return all_.groupBy("key").agg(F.sum("known").alias("known"), F.count("status").alias("stated"), F.max("status").alias("status"), *total)

    p = together(side(payments, "id", 1, face="amount"), side(allocations, "payment_id", 0, a="amount"), side(residuals, "payment_id", 0, r="amount"))
    i = together(side(invoices, "id", 1, face="amount"), side(allocations, "invoice_id", 0, a="amount"), side(fees, "invoice_id", 0, f="amount"), side(states, "invoice_id", 0, state_a="allocated", state_f="fee_written_off", state_open="open_balance"))
    c = lambda n: F.col(n)
    broken = p.filter((c("known") != 1) | ((c("a") + c("r")).cast(MONEY) != c("face"))).select("key")
    fault = _state_fault(c("face"), c("status"), c("state_a"), c("state_f"), c("state_open"))
    broken = broken.unionByName(i.filter((c("known") != 1) | (c("stated") != 1) | ((c("a") + c("f")).cast(MONEY) > c("face")) | fault.isNotNull()).select("key"))
    return not some(broken.unionByName(currency_alignment(allocations, invoices, payments).select("key")))


def violations(invoices: DataFrame, payments: DataFrame, allocations: DataFrame, fees: DataFrame, residuals: DataFrame, states: DataFrame) -> DataFrame:
    """All violations of a result."""
    return (
        references(allocations, fees, residuals, invoices, payments)
        .unionByName(payment_conservation(allocations, residuals, payments))
        .unionByName(invoice_bounds(allocations, fees, invoices))
        .unionByName(invoice_states(states, invoices))
        .unionByName(global_conservation(allocations, residuals, payments))
        .unionByName(currency_alignment(allocations, invoices, payments))
    )


def check(found: DataFrame, shown: int = 100) -> None:
    """Raise with the violations, if any."""
    rows = found.orderBy("check", "key").limit(shown).collect()
    if rows:
        raise InvariantViolation(f"{len(rows)} invariant violation(s) shown:\n  - " + "\n  - ".join(r["message"] for r in rows))

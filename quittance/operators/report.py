"""Invoice states, the run report, display views, and quality against a known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance import __version__
from quittance.functions.money import MONEY, total


def invoice_states(invoices: DataFrame, allocations: DataFrame, fees: DataFrame) -> DataFrame:
    """invoice_id, status, face_value, allocated, fee_written_off, open_balance of every invoice."""
    paid = allocations.groupBy("invoice_id").agg(F.sum("amount").cast(MONEY).alias("allocated"))
    fee = fees.groupBy("invoice_id").agg(F.sum("amount").cast(MONEY).alias("fee_written_off"))
    d = invoices.select(F.col("id").alias("invoice_id"), F.col("amount").alias("face_value")).join(paid, "invoice_id", "left").join(fee, "invoice_id", "left").na.fill(0, ["allocated", "fee_written_off"])
    d = d.withColumn("open_balance", (F.col("face_value") - F.col("allocated") - F.col("fee_written_off")).cast(MONEY))
    status = F.when((F.col("open_balance") == 0) & (F.col("fee_written_off") > 0), "settled_with_fee").when(F.col("open_balance") == 0, "paid").when(F.col("allocated") > 0, "partially_paid").otherwise("open")
    return d.select("invoice_id", status.alias("status"), "face_value", F.col("allocated").cast(MONEY), F.col("fee_written_off").cast(MONEY), "open_balance")


def residuals(payments: DataFrame, allocations: DataFrame) -> DataFrame:
    """payment_id, amount of what was not allocated, where anything was left."""
    used = allocations.groupBy("payment_id").agg(F.sum("amount").cast(MONEY).alias("used"))
    d = payments.select(F.col("id").alias("payment_id"), F.col("amount").alias("came")).join(used, "payment_id", "left").na.fill(0, ["used"])
    return d.filter("used < came").select("payment_id", (F.col("came") - F.col("used")).cast(MONEY).alias("amount"))


def run_report(payments: DataFrame, results: DataFrame, allocations: DataFrame, fees: DataFrame, left: DataFrame, states: DataFrame, model_calls: DataFrame | None = None) -> DataFrame:
    """One row of counts and money totals."""
    n = lambda c, v: F.count_if(F.col("status") == v).cast("long").alias(c)
    p = payments.agg(F.count("*").cast("long").alias("payments_total"), total(F.col("amount")).alias("money_in"))
    r = results.agg(
        n("payments_matched", "matched"), n("payments_partially_matched", "partially_matched"), n("payments_in_review", "review"), n("payments_unmatched", "unmatched"),
        *([F.count_if("search_truncated").cast("long").alias("search_truncations")] if "search_truncated" in results.columns else [F.lit(0).cast("long").alias("search_truncations")]),
        *([F.coalesce(F.sum("model_calls"), F.lit(0)).cast("long").alias("model_parser_calls")] if "model_calls" in results.columns else [F.lit(0).cast("long").alias("model_parser_calls")]),
    )
    s = states.agg(F.count("*").cast("long").alias("invoices_total"), n("invoices_paid", "paid"), n("invoices_settled_with_fee", "settled_with_fee"), n("invoices_partially_paid", "partially_paid"), n("invoices_open", "open"))
    money = [df.agg(total(F.col("amount")).alias(name)) for df, name in ((allocations, "money_allocated"), (fees, "money_fees"), (left, "money_residual"))]
    out = p.join(r).join(s)
    for m in money:
        out = out.join(m)
    rate = F.coalesce(F.try_divide(F.col("payments_in_review").cast("double"), F.col("payments_total")), F.lit(0.0))
    return out.withColumn("review_rate", rate).withColumn("engine_version", F.lit(__version__))


def _or_empty(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def allocation_view(allocations: DataFrame, fees: DataFrame, results: DataFrame, invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Allocations with fee, strategy, confidence and the names a person reads; missing parts are empty."""
    d = (
        allocations.join(fees.select("payment_id", "invoice_id", F.col("amount").alias("fee")), ["payment_id", "invoice_id"], "left")
        .join(results.select("payment_id", "strategy", "confidence"), "payment_id", "left")
        .join(invoices.select(F.col("id").alias("invoice_id"), "number", "customer_name"), "invoice_id", "left")
        .join(payments.select(F.col("id").alias("payment_id"), "reference", "counterparty"), "payment_id", "left")
    )
    return d.select("payment_id", "invoice_id", "amount", *_or_empty("fee", "strategy", "confidence", "number", "customer_name", "reference", "counterparty"))


def review_view(results: DataFrame, payments: DataFrame) -> DataFrame:
    """The queue for people with the bank line beside the reason."""
    d = results.filter("review_reason is not null").join(payments.select(F.col("id").alias("payment_id"), F.col("amount").alias("payment_amount"), "reference", "counterparty"), "payment_id", "left")
    return d.select("payment_id", "review_reason", "message", *_or_empty("payment_amount", "reference", "counterparty"))


def state_view(states: DataFrame, invoices: DataFrame) -> DataFrame:
    """Invoice states with number and customer."""
    return states.join(invoices.select(F.col("id").alias("invoice_id"), "number", "customer_name"), "invoice_id", "left").select("invoice_id", "status", "face_value", "open_balance", *_or_empty("number", "customer_name"))


def page(df: DataFrame, order: str, limit: int = 250) -> tuple[DataFrame, int]:
    """The first rows and the honest total."""
    return df.orderBy(order).limit(limit), df.count()


def quality(predicted: DataFrame, truth: DataFrame, results: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (payment_id, invoice_id) pairs, and the share of payments left to people."""
    a, b = predicted.select("payment_id", "invoice_id").distinct(), truth.select("payment_id", "invoice_id").distinct()
    counts = a.agg(F.count("*").alias("predicted")).join(b.agg(F.count("*").alias("expected"))).join(a.intersect(b).agg(F.count("*").alias("hits")))
    asked = results.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("review", "unmatched")).alias("asked"))
    d = counts.join(asked)
    ratio = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(y)), F.lit(1.0))
    d = d.withColumn("precision", ratio("hits", "predicted")).withColumn("recall", ratio("hits", "expected"))
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return d.select("predicted", "expected", "hits", "precision", "recall", f1.alias("f1"), F.coalesce(F.try_divide(F.col("asked").cast("double"), F.col("n")), F.lit(0.0)).alias("review_rate"))

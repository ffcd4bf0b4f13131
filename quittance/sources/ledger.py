"""Reading ledgers and statements; writing canonical files and results."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.errors import LedgerError
from quittance.operators import validate
from quittance.plans.engine import Reconciliation, confidence_of, reconcile
from quittance.plans.policy import Policy
from quittance.sources import split_csv
from quittance.sources.split_csv import PLACE


def read_table(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """A raw table of strings: csv with a header row (quotes doubled, byte order mark allowed), json lines, or parquet."""
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "json":
        return spark.read.option("primitivesAsString", "true").json(path)
    if kind != "csv":
        raise ValueError(f"unknown kind of table: {kind}")
    try:
        df = split_csv.read(spark, path)
    except LedgerError:
        raise
    except Exception as e:  # Spark names a missing or headless file in many ways
        raise LedgerError(f"{path}: cannot be read: {str(e).splitlines()[0]}") from e
    return df.toDF(*[c.strip() for c in df.columns])


def accept_rows(raw: DataFrame, rows, required: tuple[str, ...], path: str) -> DataFrame:
    if missing := [c for c in required if c not in raw.columns]:
        raise LedgerError(f"{path}: missing column(s): {', '.join(missing)}")
    checked = rows(raw)
    if checked.filter(F.size("errors") > 0).limit(1).count():
        line, faults = _first_bad_line(checked)
        raise LedgerError(f"{path}:{line}: {'; '.join(faults)}")
    return checked.drop("errors", PLACE)


def _first_bad_line(checked: DataFrame) -> tuple[int, list[str]]:
    """Number (the header is 1) and faults of the first bad row.  Rows that come from no file are numbered as their partitions follow one another."""
    if PLACE not in checked.columns:
        checked = checked.select("errors").coalesce(1).withColumn(PLACE, F.struct(F.lit("").alias("file"), (F.monotonically_increasing_id() + 2).alias("nth")))
    first = checked.filter(F.size("errors") > 0).select("errors", PLACE).orderBy(PLACE).first()
    return first[PLACE]["nth"], first["errors"]


def read_invoices(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return accept_rows(read_table(spark, path, kind), validate.invoice_rows, validate.INVOICE_REQUIRED, path)


def read_payments(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return accept_rows(read_table(spark, path, kind), validate.payment_rows, validate.PAYMENT_REQUIRED, path)


def request(spark: SparkSession, body: str) -> Reconciliation:
    """Reconcile a JSON body {invoices, payments, config}; numbers with a fraction are refused as money."""
    given = json.loads(body)
    if unknown := sorted(set(given) - {"invoices", "payments", "config"}):
        raise LedgerError(f"unknown keys: {', '.join(unknown)}")
    frames = []
    for what, columns, required, rows in (
        ("invoices", validate.INVOICE_COLUMNS, validate.INVOICE_REQUIRED, validate.invoice_rows),
        ("payments", validate.PAYMENT_COLUMNS, validate.PAYMENT_REQUIRED, validate.payment_rows),
    ):
        items = given.get(what, [])
        if any(isinstance(r.get("amount"), float) for r in items):
            raise LedgerError(f"{what}: amounts must be strings, not binary floating point")
        raw = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in columns) for r in items], ", ".join(f"{c} string" for c in columns))
        frames.append(accept_rows(raw, rows, required, what))
    return reconcile(*frames, policy=Policy.from_mapping(given.get("config") or {}))


# --- writing: the names of columns and fields below are fixed values ---------------------------------


def _csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_invoices(df: DataFrame, path: str) -> None:
    _csv(df.select(*validate.INVOICE_COLUMNS), path)


def write_payments(df: DataFrame, path: str) -> None:
    _csv(df.select(*validate.PAYMENT_COLUMNS), path)


def allocation_rows(r: Reconciliation) -> DataFrame:
    """Allocations in the order they were made, with fee, strategy, confidence and reason."""
    fees = r.fees.select("payment_id", "invoice_id", F.col("amount").alias("fee"))
    d = r.allocations.join(fees, ["payment_id", "invoice_id"], "left").join(r.results.select("payment_id", "strategy", "confidence", "reason"), "payment_id", "left")
    return d.orderBy("seq", "pos").select("payment_id", "invoice_id", "amount", "fee", "strategy", "confidence", "reason")


def review_rows(r: Reconciliation) -> DataFrame:
    return r.review_queue.orderBy("date", "payment_id").select("payment_id", "reason", "message", "best_candidate", "best_confidence", "options")


def state_rows(r: Reconciliation) -> DataFrame:
    return r.invoice_states.orderBy("invoice_id").select("invoice_id", "status", "face_value", "allocated", "fee_written_off", "open_balance")


def _money(cents):
    return F.when(cents.isNotNull(), (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)").cast("string"))


def _candidate(c):
    return F.when(
        c.isNotNull(),
        F.struct(
            c["strategy"].alias("strategy"), confidence_of(c["points"]).cast("string").alias("confidence"), c["reasons"].alias("reasons"), F.transform(c["parts"], lambda x: x["invoice_id"]).alias("invoice_ids"),
            F.transform(c["parts"], lambda x: F.struct(x["invoice_id"].alias("invoice_id"), _money(x["amount"]).alias("amount"))).alias("allocations"),
            F.transform(F.filter(c["parts"], lambda x: x["fee"] > 0), lambda x: F.struct(x["invoice_id"].alias("invoice_id"), _money(x["fee"]).alias("amount"))).alias("fees"),
            _money(c["residual"]).alias("residual"), c["named"].alias("reference_matched"),
        ),
    )


def payment_documents(r: Reconciliation) -> DataFrame:
    """A nested row per payment, by id: the canonical form of results, money and confidence as strings."""
    d = r.decided
    return d.orderBy("payment_id").select("payment_id", "status", "review_reason", "search_truncated", _candidate(F.col("chosen")).alias("chosen"), F.transform("ranked", _candidate).alias("ranked_candidates"))


def review_documents(r: Reconciliation) -> DataFrame:
    return r.review_queue.orderBy("date", "payment_id").select("payment_id", "reason", "message", F.transform("candidates", _candidate).alias("candidates"))


def report_document(r: Reconciliation) -> dict[str, Any]:
    p = r.report.first().asDict()
    pick = lambda side, *names: {n: p[f"{side}_{n}"] for n in names}
    return {
        "engine_version": p["engine_version"],
        "payments": pick("payments", "total", "matched", "partially_matched", "in_review", "unmatched"),
        "invoices": pick("invoices", "total", "paid", "settled_with_fee", "partially_paid", "open"),
        "money": {k: str(v) for k, v in pick("money", "in", "allocated", "residual", "fees").items()},
        "search_truncations": p["search_truncations"],
        "model_parser_calls": p["model_parser_calls"],
    }


def _amounts(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.col("amount").cast("string").alias("amount"))


def result_sections(r: Reconciliation) -> dict[str, DataFrame]:
    """The parts of a result in their order, each row a document, money as text."""
    dated = r.residuals.join(r.results.select("payment_id", "date"), "payment_id")
    return {
        "payments": payment_documents(r), "allocations": _amounts(r.allocations.orderBy("seq", "pos"), "payment_id", "invoice_id"), "fees": _amounts(r.fees.orderBy("seq", "pos"), "payment_id", "invoice_id"),
        "residuals": _amounts(dated.orderBy("date", "payment_id"), "payment_id"),
        "invoice_states": state_rows(r).select("invoice_id", "status", *[F.col(c).cast("string").alias(c) for c in ("face_value", "allocated", "fee_written_off", "open_balance")]), "review_queue": review_documents(r),
    }


def result_document(r: Reconciliation, most: int = 100_000) -> dict[str, Any]:
    """The whole result as one ordered document, for results whose payments and invoices fit the driver; larger ones go through write_all."""
    n = r.results.count() + r.invoice_states.count()
    if n > most:
        raise ValueError(f"{n} payments and invoices are too many for one document; write_all() keeps them on the executors")
    as_json = lambda df: [json.loads(x[0]) for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    return {"report": report_document(r), **{name: as_json(df) for name, df in result_sections(r).items()}, "warnings": r.warnings}


def dumps(document: dict[str, Any]) -> str:
    return json.dumps(document, indent=2, ensure_ascii=False) + "\n"


def write_all(r: Reconciliation, folder: str) -> list[str]:
    """allocations.csv, review_queue.csv, invoice_states.csv and result.json under folder, each a folder of ordered parts.

    result.json holds a folder of JSON lines for each section: report, payments, allocations,
    fees, residuals, invoice_states, review_queue and warnings.
    """
    paths = [f"{folder.rstrip('/')}/{n}" for n in ("result.json", "allocations.csv", "review_queue.csv", "invoice_states.csv")]
    for name, df in result_sections(r).items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{paths[0]}/{name}")
    spark = r.results.sparkSession
    for name, lines in (("report", [json.dumps(report_document(r))]), ("warnings", [json.dumps(w) for w in r.warnings])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{paths[0]}/{name}")
    _csv(allocation_rows(r), paths[1])
    _csv(review_rows(r), paths[2])
    _csv(state_rows(r), paths[3])
    return paths


def read_result(spark: SparkSession, folder: str) -> dict[str, Any]:
    """What write_all() wrote, as result_document() has it; for results that fit the driver."""
    out: dict[str, Any] = {}
    for name in ("report", "payments", "allocations", "fees", "residuals", "invoice_states", "review_queue", "warnings"):
        rows = [json.loads(x["value"]) for x in spark.read.text(f"{folder.rstrip('/')}/result.json/{name}").collect()]
        out[name] = rows[0] if name == "report" else rows
    return out

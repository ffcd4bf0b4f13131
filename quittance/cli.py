"""python -m quittance.cli run INVOICES BANK --out FOLDER [--config JSON] | sample FOLDER | version"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quittance import __version__
from quittance.errors import InvariantViolation, LedgerError
from quittance.plans.policy import Policy
from quittance.sources import generate, ledger
from quittance.sources.runner import execute

BAD_INPUT, BROKEN_LAW = 2, 3


def summary(document: dict, warnings: list[str]) -> str:
    """What a person wants to know at once."""
    p, i, m = document["payments"], document["invoices"], document["money"]
    lines = [
        f"payments  {p['total']}: {p['matched']} matched, {p['partially_matched']} partially, {p['in_review']} to review, {p['unmatched']} unmatched",
        f"invoices  {i['total']}: {i['paid']} paid, {i['settled_with_fee']} settled with fee, {i['partially_paid']} partially paid, {i['open']} open",
        f"money     in {m['in']}, allocated {m['allocated']}, residual {m['residual']}, fees {m['fees']}",
    ]
    return "\n".join([*lines, *(f"warning   {w}" for w in warnings)])


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quittance", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    commands.add_parser("sample").add_argument("folder")
    run = commands.add_parser("run")
    run.add_argument("invoices")
    run.add_argument("bank")
    run.add_argument("--out", default="out")
    run.add_argument("--config")
    run.add_argument("--max-rows", type=int)
    given = parser.parse_args(arguments)
    if given.command == "version":
        print(__version__)
        return 0
    spark = SparkSession.builder.appName("quittance").getOrCreate()
    if given.command == "sample":
        print("\n".join(generate.write_case(generate.sample(spark), given.folder)))
        return 0
    try:
        policy = Policy.from_json(open(given.config, encoding="utf-8").read()) if given.config else Policy()
        done = execute(spark, given.invoices, given.bank, given.out, policy, max_rows=given.max_rows)
    except (LedgerError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD_INPUT
    except InvariantViolation as e:
        print(f"error: {e}", file=sys.stderr)
        return BROKEN_LAW
    print(summary(ledger.report_document(done.result), done.result.warnings))
    return 0


if __name__ == "__main__":
    sys.exit(main())

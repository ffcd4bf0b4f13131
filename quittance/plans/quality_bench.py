"""Quality under noise: cases of several seeds per scenario, their mean scores, and a comparison with committed ones."""

from __future__ import annotations

import json
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quittance import __version__
from quittance.errors import LedgerError
from quittance.operators.report import quality
from quittance.plans.engine import reconcile
from quittance.plans.policy import DEFAULT, Policy
from quittance.plans.scratch import there
from quittance.sources.generate import KINDS, Noise, generate, noise_at

SCORES = ("precision", "recall", "f1", "review_rate")
SCHEMA = "scenario string, level double, seed int, precision double, recall double, f1 double, review_rate double, runtime_ms double, payments bigint"


def scenarios(levels: Iterable[float] = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5), most: float = 0.5) -> list[tuple[str, float, Noise]]:
    """All noise together at each level, then each kind alone and the reference kind with each other at the highest."""
    out = [("overall", x, noise_at(x)) for x in levels]
    out += [(f"only:{d}", most, noise_at(most, d)) for d in KINDS]
    return out + [(f"reference+{d}", most, noise_at(most, "reference", d)) for d in KINDS if d != "reference"]


def run(spark: SparkSession, cases: list[tuple[str, float, Noise]], seeds: Iterable[int] = range(5), invoices: int = 400, policy: Policy = DEFAULT) -> DataFrame:
    """One row per case and seed; runtime is that of the reconciliation alone."""
    rows = []
    for name, level, noise in cases:
        for seed in seeds:
            case = generate(spark, seed, invoices, 10, noise)
            start = time.perf_counter()
            r = reconcile(case.invoices, case.payments, policy)
            took = (time.perf_counter() - start) * 1e3
            q = quality(r.allocations, case.truth, r.results).first()
            rows.append((name, level, seed, *(q[s] for s in SCORES), took, case.payments.count()))
    return spark.createDataFrame(rows, SCHEMA)


def means(rows: DataFrame) -> DataFrame:
    """Mean scores of each scenario and level, worst recall first."""
    m = rows.groupBy("scenario", "level").agg(*[F.bround(F.avg(s), 4).alias(s) for s in SCORES], F.bround(F.avg("runtime_ms"), 1).alias("runtime_ms"), F.bround(F.avg("payments"), 0).cast("bigint").alias("payments"))
    return m.orderBy("recall", "scenario", "level")


def differences(committed: DataFrame, fresh: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(scenario, level, score, committed, fresh) where a score moved by more than the tolerance or is gone; runtime is not compared."""
    f = fresh.select("scenario", "level", *[F.col(s).alias(f"new_{s}") for s in SCORES])
    j = committed.join(f, ["scenario", "level"], "left")
    rows = j.select("scenario", "level", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).alias("committed"), F.col(f"new_{s}").alias("fresh")) for s in SCORES])).alias("x")).select("scenario", "level", "x.*")
    return rows.filter(F.col("fresh").isNull() | (F.abs(F.col("committed") - F.col("fresh")) > tolerance))


# --- result files -----------------------------------------------------------------------------------


def write_results(spark: SparkSession, mean: DataFrame, folder: str, seeds: int, invoices: int) -> None:
    """results.csv, meta.json and results.md under folder; mean is that of means(), some dozen rows."""
    at = folder.rstrip("/")
    mean.coalesce(1).write.mode("overwrite").csv(f"{at}/results.csv", header=True)
    meta = json.dumps({"engine_version": __version__, "seeds": seeds, "invoices": invoices, "rows": mean.count()})
    for name, lines in (("meta.json", [meta]), ("results.md", table_lines(mean.collect(), seeds, invoices))):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/{name}")


def table_lines(rows: list[Row], seeds: int, invoices: int) -> list[str]:
    """Means as Markdown: all noise by level, one kind alone, pairs with broken references, the worst first."""
    pct = lambda x: f"{100 * x:.1f} %"
    out = [f"# Quality under noise, engine {__version__}", "", f"Means of {seeds} seeds of {invoices} invoices each. What goes to review counts as missed, not as wrong."]
    for title, prefix in (("All kinds together", "overall"), ("One kind alone", "only:"), ("References and one other kind", "reference+")):
        own = [r for r in rows if r["scenario"].startswith(prefix)]
        own.sort(key=lambda r: r["level"] if prefix == "overall" else r["recall"])
        out += ["", f"## {title}", "", "| noise | level | precision | recall | F1 | to review | ms |", "|---|---:|---:|---:|---:|---:|---:|"]
        out += [f"| {r['scenario']} | {r['level']:.1f} | {' | '.join(pct(r[s]) for s in SCORES)} | {r['runtime_ms']:.0f} |" for r in own]
    return out


def read_results(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    """(means, meta) as write_results() left them; LedgerError where there are none."""
    at = folder.rstrip("/")
    if not (there(spark, f"{at}/results.csv") and there(spark, f"{at}/meta.json")):
        raise LedgerError(f"no benchmark results in {folder}")
    kinds = "scenario string, level double, precision double, recall double, f1 double, review_rate double, runtime_ms double, payments bigint"
    return spark.read.schema(kinds).csv(f"{at}/results.csv", header=True), json.loads(spark.read.text(f"{at}/meta.json").first()["value"])


def check(spark: SparkSession, folder: str, fresh: DataFrame, tolerance: float = 0.001) -> list[str]:
    """What keeps committed results from being reproduced, in words; nothing if they are."""
    committed, meta = read_results(spark, folder)
    said = [] if meta["engine_version"] == __version__ else [f"results are of engine {meta['engine_version']}, this is {__version__}"]
    was, now = committed.count(), fresh.count()
    said += [] if was == now else [f"{was} committed rows, {now} fresh ones"]
    for r in differences(committed, fresh, tolerance).orderBy("scenario", "level", "score").collect():
        said.append(f"{r['scenario']} at {r['level']}: {r['score']} was {r['committed']}, is {'missing' if r['fresh'] is None else r['fresh']}")
    return said

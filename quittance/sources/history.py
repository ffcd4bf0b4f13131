"""Run history as an append-only table: every change is a new version, the last one counts."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.errors import LedgerError
from quittance.plans.scratch import files, there

STATUSES = ("draft", "complete", "failed")
SORTABLE = ("created_at", "label", "status", "payment_count", "money_in")
SCHEMA = (
    "run_id string, version bigint, created_at timestamp_ntz, label string, status string, config_json string, engine_version string, report_json string, "
    "invoice_count bigint, payment_count bigint, review_count bigint, money_in string, error string, deleted boolean, kind string, target string, source string, origin string, duration_ms bigint"
)
ACCESS = "at timestamp_ntz, run_id string, who string, action string"
#: Columns that each format of the table brought; a folder of an older format is copied into the newest one.
COLUMNS_SINCE = {1: (), 2: ("duration_ms",)}
FORMAT = max(COLUMNS_SINCE)
DRAFT_HOURS = 24


def latest(versions: DataFrame) -> DataFrame:
    """The last version of each run, deleted runs gone.  An aggregate, so versions combine before they move."""
    last = versions.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "run_id"]), "version").alias("v"))
    return last.select("run_id", "v.*").filter("not deleted")


def list_runs(runs: DataFrame, limit: int = 25, offset: int = 0, status: str | None = None, sort: str = "created_at") -> DataFrame:
    """A page of runs, newest first; unknown statuses do not filter, unknown columns do not sort."""
    key = sort if sort in SORTABLE and sort in runs.columns else "created_at"
    kept = runs.filter(F.col("status") == status) if status in STATUSES else runs
    return kept.orderBy(F.col(key).desc(), F.col("run_id").desc()).offset(max(0, offset)).limit(max(1, limit))


def sweepable(runs: DataFrame, expired_before: Column | None, stale_before: Column) -> DataFrame:
    """(run_id, why): runs past retention, and drafts that nobody confirmed and that are not expired too."""
    old = F.col("created_at") < expired_before if expired_before is not None else F.lit(False)
    stale = (F.col("status") == "draft") & (F.col("created_at") < stale_before)
    return runs.withColumn("why", F.when(old, "expired").when(stale, "abandoned")).filter("why is not null").select("run_id", "why")


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


class RunHistory:
    """Versions under a folder, mappings beside them, and who looked at what.

    A history without any run is an empty table, not an error.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str = "runs", version: int = FORMAT) -> str:
        return f"{self.folder}/v{version}/{table}"

    def _read(self, schema: str, table: str = "runs") -> DataFrame:
        path = self._path(table)
        return self.spark.read.schema(schema).parquet(path) if there(self.spark, path) else self.spark.createDataFrame([], schema)

    def _append(self, *rows: dict[str, Any]) -> None:
        """Versions of one moment, in one file."""
        base = {"version": int(_now().timestamp() * 1e6), "deleted": False}
        schema = self.spark.createDataFrame([], SCHEMA).schema
        values = [tuple((base | row).get(f.name) for f in schema) for row in rows]
        self.spark.createDataFrame(values, schema).coalesce(1).write.mode("append").parquet(self._path())

    def _all(self) -> DataFrame:
        return self._read(SCHEMA)

    def migrate(self) -> int:
        """Copy what an older format left into the newest one; a newer format than this library knows is refused.  Returns the format found."""
        known = [v for v in COLUMNS_SINCE if there(self.spark, self._path(version=v))]
        if there(self.spark, self.folder):
            fs, path = files(self.spark, self.folder)
            names = [x.getPath().getName() for x in fs.listStatus(path)]
            newer = [n for n in names if re.fullmatch(r"v\d+", n) and int(n[1:]) > FORMAT]
            if newer:
                raise LedgerError(f"{self.folder} holds history of format {max(newer)}, newer than v{FORMAT}; use the version of the library that wrote it")
        if not known:
            return FORMAT
        if (found := max(known)) < FORMAT:
            old = self.spark.read.parquet(self._path(version=found))
            schema = self.spark.createDataFrame([], SCHEMA).schema
            padded = [(F.col(f.name) if f.name in old.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
            old.select(*padded).write.mode("errorifexists").parquet(self._path())
        return found

    def runs(self) -> DataFrame:
        return latest(self._all().filter("kind is null"))

    def get(self, run_id: str) -> dict[str, Any] | None:
        found = self.runs().filter(F.col("run_id") == run_id).limit(1).collect()
        return found[0].asDict() if found else None

    def count(self, status: str | None = None) -> int:
        runs = self.runs()
        return (runs.filter(F.col("status") == status) if status in STATUSES else runs).count()

    def create_draft(self, run_id: str, label: str = "", config_json: str = "{}", created_at: datetime | None = None) -> None:
        self._append({"run_id": run_id, "created_at": created_at or _now(), "label": label, "status": "draft", "config_json": config_json})

    def _change(self, run_id: str, **values: Any) -> bool:
        held = self.get(run_id)
        if held is not None:
            held.pop("version")
            self._append(held | values)
        return held is not None

    def mark_complete(self, run_id: str, **report: Any) -> None:
        self._change(run_id, status="complete", error=None, **report)

    def mark_failed(self, run_id: str, error: str) -> None:
        self._change(run_id, status="failed", error=error)

    def delete(self, run_id: str) -> bool:
        return self._change(run_id, deleted=True)

    def save_mapping(self, run_id: str, entries: list[tuple[str, str, str, str]]) -> None:
        """(kind, target, source, origin) as proposed and confirmed; replaces what was saved before, also by nothing."""
        names = ("kind", "target", "source", "origin")
        self._append(*[{"run_id": run_id, **dict(zip(names, e, strict=True))} for e in entries] or [{"run_id": run_id, "kind": "none"}])

    def mapping(self, run_id: str) -> DataFrame:
        rows = self._all().filter((F.col("run_id") == run_id) & F.col("kind").isNotNull())
        last = rows.agg(F.max("version").alias("last"))
        return rows.join(F.broadcast(last), rows["version"] == last["last"]).filter("target is not null").select("kind", "target", "source", "origin")

    def log_access(self, run_id: str, who: str, action: str) -> None:
        """Remember who did what with a run; nothing of it is ever changed."""
        self.spark.createDataFrame([(_now(), run_id, who, action)], ACCESS).write.mode("append").parquet(self._path("access"))

    def accesses(self, run_id: str | None = None) -> DataFrame:
        rows = self._read(ACCESS, "access")
        return (rows if run_id is None else rows.filter(F.col("run_id") == run_id)).orderBy("at")

    def backup_to(self, folder: str) -> None:
        """Copy versions and accesses as they are now to another folder, which must hold no history yet."""
        other = RunHistory(self.spark, folder)
        for table, schema in (("runs", SCHEMA), ("access", ACCESS)):
            self._read(schema, table).write.mode("errorifexists").parquet(other._path(table))

    def expired(self, retention_days: int | None, now: datetime | None = None) -> DataFrame:
        """(run_id, why) of runs past retention, none without one, and of drafts that nobody confirmed for a day."""
        at = F.lit(now or _now()).cast("timestamp_ntz")
        old = None if retention_days is None else at - F.expr(f"INTERVAL {int(retention_days)} DAYS")
        return sweepable(self.runs(), old, at - F.expr(f"INTERVAL {DRAFT_HOURS} HOURS"))

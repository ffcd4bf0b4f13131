"""Money as decimal(18,2), rounded half up; whole cents inside kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quittance.errors import LedgerError
from quittance.plans.policy import Policy

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    """A string, integer or decimal as money; null if it is none."""
    return F.round(c.try_cast("decimal(38,10)"), 2).try_cast(MONEY)


def cents(c: Column) -> Column:
    return (c * 100).cast("long")


def from_cents(c: Column) -> Column:
    return (c.cast("decimal(20,0)") / 100).cast(MONEY)


def total(c: Column) -> Column:
    """Sum, 0.00 over nothing."""
    return F.coalesce(F.sum(c), F.lit(0).cast(MONEY)).cast(MONEY)


def refuse_floats(df: DataFrame, *columns: str) -> None:
    """Binary floats have lost cents before they arrive; their columns are an error."""
    bad = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.FloatType | T.DoubleType)]
    if bad:
        raise LedgerError(f"money must be text or decimal, not binary floating point: {', '.join(bad)}")


def fee_tolerance(face: Column, policy: Policy) -> Column:
    """The largest shortfall of a balance that is a fee; halves go to the even cent."""
    value = F.greatest(face.cast("decimal(28,2)") * F.lit(policy.fee_tolerance_pct), F.lit(policy.fee_tolerance_abs))
    if policy.fee_tolerance_cap is not None:
        value = F.least(value, F.lit(policy.fee_tolerance_cap))
    return F.bround(value, 2).cast(MONEY)

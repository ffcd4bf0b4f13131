"""The policy of a run: one immutable object whose values become literals of the plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from decimal import ROUND_HALF_EVEN, Decimal
from typing import Any

TIE_BREAKS = ("oldest_first", "newest_first", "largest_first", "smallest_first")
AMBIGUITY = ("review", "resolve_by_policy")


@dataclass(frozen=True)
class Policy:
    """Knobs of matching; money values are decimals, never floats."""

    date_window_days_after: int = 120
    date_window_days_before: int = 5
    fee_tolerance_pct: Decimal = Decimal("0.03")
    fee_tolerance_abs: Decimal = Decimal("1.00")
    fee_tolerance_cap: Decimal | None = None
    confidence_threshold: Decimal = Decimal("0.80")
    max_combination_size: int = 4
    max_combination_candidates: int = 24
    search_node_budget: int = 50_000
    max_combinations_returned: int = 16
    tie_break: str = "oldest_first"
    ambiguity_policy: str = "review"
    allow_partial: bool = True
    allow_overpayment: bool = True
    allow_combinations: bool = True
    require_customer_match: bool = True
    fuzzy_ref_threshold: int = 88
    verify_invariants: bool = True

    def __post_init__(self) -> None:
        checks = {
            "date_window_days_after must not be negative": self.date_window_days_after >= 0,
            "date_window_days_before must not be negative": self.date_window_days_before >= 0,
            "fee_tolerance_pct must lie in [0, 1)": 0 <= self.fee_tolerance_pct < 1,
            "fee_tolerance_abs must not be negative": self.fee_tolerance_abs >= 0,
            "confidence_threshold must lie in [0, 1]": 0 <= self.confidence_threshold <= 1,
            "max_combination_size must be at least 2": self.max_combination_size >= 2,
            "max_combination_candidates must be at least 1": self.max_combination_candidates >= 1,
            "search_node_budget must be at least 1": self.search_node_budget >= 1,
            "max_combinations_returned must be at least 1": self.max_combinations_returned >= 1,
            "fuzzy_ref_threshold must lie in [0, 100]": 0 <= self.fuzzy_ref_threshold <= 100,
            f"tie_break must be one of {TIE_BREAKS}": self.tie_break in TIE_BREAKS,
            f"ambiguity_policy must be one of {AMBIGUITY}": self.ambiguity_policy in AMBIGUITY,
        }
        broken = [said for said, fine in checks.items() if not fine]
        if broken:
            raise ValueError("; ".join(broken))

    @classmethod
    def from_mapping(cls, given: dict[str, Any]) -> Policy:
        """Policy from strings and numbers; unknown keys are refused, floats are read by their digits."""
        kinds = {f.name: f.type for f in fields(cls)}
        if unknown := sorted(set(given) - set(kinds)):
            raise ValueError(f"unknown policy keys: {', '.join(unknown)}")
        values = {k: (None if v is None else Decimal(str(v))) if "Decimal" in kinds[k] else v for k, v in given.items()}
        return replace(cls(), **values)

    @classmethod
    def from_json(cls, text: str) -> Policy:
        return cls.from_mapping(json.loads(text, parse_float=str))

    def tolerance_cents(self, face: int) -> int:
        """Fee tolerance of a balance in cents; halves go to the even cent."""
        value = max(self.fee_tolerance_pct * face, self.fee_tolerance_abs * 100)
        if self.fee_tolerance_cap is not None:
            value = min(value, self.fee_tolerance_cap * 100)
        return int(value.quantize(Decimal(1), rounding=ROUND_HALF_EVEN))

    def widest_total(self, amount: int) -> int:
        """Largest total in cents whose shortfall against amount could still be a fee."""
        most = max(Decimal(amount) / (1 - self.fee_tolerance_pct), amount + self.fee_tolerance_abs * 100)
        if self.fee_tolerance_cap is not None:
            most = min(most, amount + self.fee_tolerance_cap * 100)
        return int(most)  # totals are whole cents

    @property
    def threshold_points(self) -> Decimal:
        return self.confidence_threshold * 10_000


DEFAULT = Policy()

"""Pluggable readers of payment references: rules, chains, and a model behind a client."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from typing import Any, Protocol

from quittance.functions.text import LONGEST_RUN, YEARS, extract_refs


@dataclass(frozen=True)
class ParseOutcome:
    tokens: tuple[tuple[int, int | None], ...]
    source: str
    model_calls: int = 0


class ReferenceParser(Protocol):
    """Anything with a name that turns a reference into (seq, year) tokens; must be picklable."""

    name: str

    def parse(self, text: str) -> ParseOutcome: ...


@dataclass(frozen=True)
class RuleParser:
    name: str = "rules"

    def parse(self, text: str) -> ParseOutcome:
        return ParseOutcome(tuple((s, y) for s, y, _, _ in extract_refs(text)), self.name)


@dataclass(frozen=True)
class ChainParser:
    """The first parser that finds anything wins; model calls of those asked before it count too."""

    parsers: tuple[Any, ...]

    def __post_init__(self) -> None:
        if not self.parsers:
            raise ValueError("a chain needs at least one parser")

    @property
    def name(self) -> str:
        return "+".join(p.name for p in self.parsers)

    def parse(self, text: str) -> ParseOutcome:
        calls, last = 0, ParseOutcome((), self.name)
        for p in self.parsers:
            last = p.parse(text)
            calls += last.model_calls
            if last.tokens:
                break
        return ParseOutcome(last.tokens, last.source, calls)


def sane_tokens(proposed: Sequence[dict[str, Any]]) -> tuple[tuple[int, int | None], ...]:
    """Proposals that could be identifiers: positive, short enough, years in range or dropped, each once."""
    out: dict[tuple[int, int | None], None] = {}
    for p in proposed:
        seq, year = p.get("seq"), p.get("year")
        if isinstance(seq, int) and not isinstance(seq, bool) and 0 < seq < 10**LONGEST_RUN:
            out[seq, year if isinstance(year, int) and year in YEARS else None] = None
    return tuple(out)


class ModelParser:
    """Asks ask(text) for proposals; a failure yields no tokens and costs one call.  Answers are kept per process."""

    def __init__(self, ask: Callable[[str], Sequence[dict[str, Any]]], name: str = "model", kept: int = 1024) -> None:
        self.ask, self.name, self.kept = ask, name, kept
        self._cached: Callable[[str], ParseOutcome] | None = None

    def __getstate__(self) -> dict[str, Any]:
        return {"ask": self.ask, "name": self.name, "kept": self.kept, "_cached": None}

    def __setstate__(self, state: dict[str, Any]) -> None:
        self.__dict__.update(state)

    def parse(self, text: str) -> ParseOutcome:
        text = text.strip()
        if not text:
            return ParseOutcome((), self.name)
        if self._cached is None:
            self._cached = lru_cache(maxsize=self.kept)(self._once)
        return self._cached(text)

    def _once(self, text: str) -> ParseOutcome:
        try:
            return ParseOutcome(sane_tokens(self.ask(text)), self.name, 1)
        except Exception:  # a broken model must not stop a run
            return ParseOutcome((), f"{self.name}:error", 1)


def default_parser(ask: Callable[[str], Sequence[dict[str, Any]]] | None = None) -> ReferenceParser:
    return RuleParser() if ask is None else ChainParser((RuleParser(), ModelParser(ask)))

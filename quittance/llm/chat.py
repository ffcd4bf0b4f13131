"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns of a conversation are streamed in order.  The machine says for each role
whether it may follow; a turn out of order is formatted all the same and flagged
with the transition that broke the rules.  Each turn becomes three segments,
header, body and footer, of which only the body of a trained role carries loss.
Control strings in a text are escaped by a backslash, so reading back is exact.

A conversation is never held as a whole: partitions are sorted and one turn is in
memory at a time, so a conversation with a third of all rows still streams.

Cases: null text is empty; null role is the empty role, which like any unknown
role is formatted and flagged; null turns come first; ties in turn are ordered by
role, then text; repeated rows are turns of their own; a null conv_id is one
conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Names, marks and transitions.  ``follows`` maps a state to the roles that may come next."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    mark: str = "###"
    after_label: str = ": "
    footer: str = "</turn>\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    )

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.mark, self.footer.strip())

    def header(self, role: str) -> str:
        label = self.labels.get(role)
        return f"{self.mark} {label if label is not None else '?' + quote(role, safe='')}{self.after_label}"

    def role_of(self, label: str) -> str:
        return unquote(label[1:]) if label.startswith("?") else next(r for r, x in self.labels.items() if x == label)

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", *self.controls))), lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """(text, loss) in order: header, body, footer."""
        return [(self.header(role), False), (self.escape(text), role in self.trained), (self.footer, False)]

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted stretch."""
        turn = re.compile(
            rf"{re.escape(self.mark)} (?P<label>[^ ]*?){re.escape(self.after_label)}(?P<body>(?:\\.|(?!{re.escape(self.footer.strip())})[^\\])*){re.escape(self.footer)}",
            re.DOTALL,
        )
        out, at = [], 0
        while at < len(formatted):
            m = turn.match(formatted, at)
            if not m:
                raise ValueError(f"not a turn at {at}: {formatted[at : at + 40]!r}")
            out.append((self.role_of(m["label"]), self.unescape(m["body"])))
            at = m.end()
        return out


TEMPLATE = Template()
_TURN = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("formatted", pa.string()),
    ("body_start", pa.int64()), ("body_end", pa.int64()), ("loss", pa.bool_()), ("violation", pa.string()),
])
TURN_SCHEMA = "conv_id long, turn long, seq long, role string, formatted string, body_start long, body_end long, loss boolean, violation string"


def format_turns(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per turn, in order within its partition: its formatted text, where its body stands, loss and violation."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, seq = object(), "", 0
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                if conv != now:
                    now, state, seq = conv, "", 0
                violation = None if role in template.follows.get(state, ()) else f"{state or 'start'}->{role}"
                head, body, foot = template.segments(role, text)
                start = len(head[0])
                rows.append((conv, turn, seq, role, head[0] + body[0] + foot[0], start, start + len(body[0]), body[1], violation))
                state, seq = role, seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_TURN), _TURN, strict=True)], schema=_TURN)

    return turns.mapInArrow(run, TURN_SCHEMA)


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Parse the formatted turns (as format_turns leaves them) and digest each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now = None, object()

        def closed() -> list[tuple]:
            return [(now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])] if state else []

        for b in batches:
            done = []
            for conv, text, lo, hi, loss, bad in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "body_start", "body_end", "loss", "violation")), strict=True):
                if conv != now:
                    done += closed()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                for role, said in template.parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                if loss:
                    trained = template.unescape(text[lo:hi])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(text)
                state[5] &= bad is None
            yield _digests(done)
        yield _digests(closed())

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_()),
])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_DIGEST)
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _DIGEST, strict=True)], schema=_DIGEST)

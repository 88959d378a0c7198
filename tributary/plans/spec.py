"""What a join query consists of: streams, edges, filters, a window and a sampling method."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


class QueryError(ValueError):
    """A query that can't be planned, and why."""


def names(columns: str | tuple[str, ...] | list[str] | None) -> tuple[str, ...]:
    return () if columns is None else (columns,) if isinstance(columns, str) else tuple(columns)


def estimated_bytes(df: DataFrame) -> int:
    """A table's size as the planner estimates it, without a job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class Stream:
    """A table of a query. rid: columns that tell its rows apart; ts: whole-number time; primary_key: for foreign keys."""

    name: str
    frame: DataFrame
    rid: tuple[str, ...] = ()
    ts: str | None = None
    primary_key: tuple[str, ...] = ()


@dataclass(frozen=True)
class Edge:
    """left.left_cols = right.right_cols, or |left - right| <= width. foreign_key: the side that refers to the other's key."""

    left: str
    left_cols: tuple[str, ...]
    right: str
    right_cols: tuple[str, ...]
    width: int | None = None
    foreign_key: str | None = None

    @property
    def is_band(self) -> bool:
        return self.width is not None

    def cols(self, stream: str) -> tuple[str, ...]:
        return self.left_cols if stream == self.left else self.right_cols

    def other(self, stream: str) -> str:
        return self.right if stream == self.left else self.left


@dataclass(frozen=True)
class Filter:
    """kind "equi": column = value; "neq": column <> value; "band": |column - operand| <= value."""

    stream: str
    column: str
    kind: str
    value: object
    operand: object = None


@dataclass(frozen=True)
class WindowSpec:
    """kind "none", "tumbling" or "sliding"; size in units of the time column."""

    kind: str = "none"
    size: int = 0


@dataclass(frozen=True)
class SampleSpec:
    """kind "bernoulli" (amount: probability), "swor" or "swr" (amount: size).

    deterministic: draws from MD5 of the seed and a number, which SQL elsewhere can repeat; else from numpy.
    """

    kind: str
    amount: float
    seed: int = 19950810
    deterministic: bool = False

    def __post_init__(self):
        if self.kind not in ("bernoulli", "swor", "swr"):
            raise QueryError(f"no such sampling: {self.kind}")
        if self.kind == "bernoulli" and not 0 < self.amount < 1:
            raise QueryError("a sampling rate lies between 0 and 1")
        if self.kind != "bernoulli" and (self.amount < 1 or int(self.amount) != self.amount):
            raise QueryError("a sample size is a whole number of 1 or more")


@dataclass
class Spec:
    """All parts of a query, as added."""

    streams: dict[str, Stream] = field(default_factory=dict)
    edges: list[Edge] = field(default_factory=list)
    filters: list[Filter] = field(default_factory=list)
    window: WindowSpec = WindowSpec()
    sampling: SampleSpec | None = None
    key_order: str | None = None
    first_key_wins: bool = False

    def over(self, frames: dict[str, DataFrame], window: WindowSpec | None = None) -> Spec:
        """The same query over other tables, and with another window if one is given."""
        streams = {n: replace(s, frame=frames.get(n, s.frame)) for n, s in self.streams.items()}
        return replace(self, streams=streams, edges=list(self.edges), filters=list(self.filters), window=window or self.window)

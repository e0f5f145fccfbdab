"""Syntax trees of queries; all nodes are immutable and compare by value."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Word:
    """An unquoted literal: a string that may also be a severity name."""

    text: str


Literal = str | int | float | bool | None | Word


@dataclass(frozen=True)
class Compare:
    field: str
    op: str  # == != < <= > >=
    value: Literal


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Contains:
    field: str
    text: str


@dataclass(frozen=True)
class Match:
    field: str
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class Exists:
    field: str


@dataclass(frozen=True)
class And:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Or:
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Not:
    term: Expr


Expr = Compare | In | Contains | Match | Exists | And | Or | Not


@dataclass(frozen=True)
class Func:
    name: str  # count sum avg min max percentile distinct
    field: str | None = None
    p: float | None = None

    @property
    def column(self) -> str:
        """The name of its output column."""
        if self.name == "count":
            return "count"
        if self.name == "sum":
            return self.field
        if self.name == "percentile":
            p = f"{self.p:g}".replace(".", "_")
            return f"p{p}_{self.field}"
        return f"{self.name}_{self.field}"


@dataclass(frozen=True)
class WindowSpec:
    kind: str  # tumbling sliding session
    size_ms: int
    slide_ms: int | None = None


@dataclass(frozen=True)
class Filter:
    where: Expr


@dataclass(frozen=True)
class Show:
    fields: tuple[str, ...] | None  # None: all
    where: Expr | None = None


@dataclass(frozen=True)
class Aggregate:
    funcs: tuple[Func, ...]
    by: tuple[str, ...] = ()
    where: Expr | None = None
    window: WindowSpec | None = None


@dataclass(frozen=True)
class Correlate:
    left: Expr
    right: Expr
    within_ms: int = 100
    on: tuple[tuple[str, str], ...] = ()
    ordered: bool = False  # the right one follows the left one


@dataclass(frozen=True)
class Key:
    """What rows are ordered by: a field or a function's output column."""

    column: str
    descending: bool = False


@dataclass(frozen=True)
class Top:
    n: int
    key: str


@dataclass(frozen=True)
class OrderBy:
    keys: tuple[Key, ...]


@dataclass(frozen=True)
class Limit:
    n: int


Stage = Filter | Show | Aggregate | Correlate | Top | OrderBy | Limit


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]

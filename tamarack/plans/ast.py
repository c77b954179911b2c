"""Syntax tree of a statement."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    kind: str  # null, bool, int, double, text, date
    value: object
    at: int = 0


@dataclass(frozen=True)
class Name:
    parts: tuple[str, ...]
    at: int = 0


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None
    at: int = 0


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object
    at: int = 0


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    at: int = 0


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    at: int = 0


@dataclass(frozen=True)
class InList:
    arg: object
    items: tuple
    negated: bool
    at: int = 0


@dataclass(frozen=True)
class InQuery:
    arg: object
    query: Select
    negated: bool
    at: int = 0


@dataclass(frozen=True)
class Between:
    arg: object
    low: object
    high: object
    negated: bool
    at: int = 0


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool
    at: int = 0


@dataclass(frozen=True)
class Exists:
    query: Select
    at: int = 0


@dataclass(frozen=True)
class Scalar:
    query: Select
    at: int = 0


@dataclass(frozen=True)
class Table:
    name: str
    alias: str | None = None
    at: int = 0


@dataclass(frozen=True)
class Join:
    kind: str  # inner, left, right, cross
    left: object
    right: object
    on: object = None
    at: int = 0


@dataclass(frozen=True)
class Select:
    items: tuple  # of (expression, alias or None)
    source: object
    distinct: bool = False
    top: int | None = None
    percent: bool = False
    where: object = None
    group: tuple = ()
    having: object = None
    order: tuple = ()  # of (expression, descending)
    limit: int | None = None
    offset: int | None = None
    union: Select | None = None
    union_all: bool = False
    params: tuple = field(default=())

"""What a request asks for, whichever front end it came through."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any, Union


@dataclass(frozen=True)
class Field:
    """A column, and steps into its JSON: ('->' or '->>', key or index)."""

    name: str
    path: tuple[tuple[str, str | int], ...] = ()


@dataclass(frozen=True)
class Filter:
    """op on a field. value is text (or a JSON value from GraphQL), a list for `in`."""

    field: Field
    op: str
    value: Any = None
    negated: bool = False
    quantifier: str | None = None
    language: str | None = None


@dataclass(frozen=True)
class Logic:
    """op: 'and' or 'or'."""

    op: str
    children: tuple["Tree", ...]
    negated: bool = False


Tree = Union[Filter, Logic]


@dataclass(frozen=True)
class Pick:
    """A column of the result."""

    field: Field
    cast: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Everything:
    """*"""


@dataclass(frozen=True)
class Aggregate:
    func: str
    field: Field | None = None
    cast: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Embed:
    """A related table's rows: an array or struct column, or with spread its columns themselves."""

    relation: str
    items: tuple["Item", ...]
    alias: str | None = None
    hint: str | None = None
    inner: bool = False
    spread: bool = False

    @property
    def name(self) -> str:
        return self.alias or self.relation


Item = Union[Pick, Everything, Aggregate, Embed]


@dataclass(frozen=True)
class Order:
    """nulls: 'first', 'last' or None for the default: last when ascending, first when descending."""

    field: Field
    desc: bool = False
    nulls: str | None = None
    relation: str | None = None


@dataclass(frozen=True)
class Below:
    """What applies inside an embed."""

    where: tuple[Tree, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Read:
    table: str
    schema: str | None = None
    select: tuple[Item, ...] = ()
    where: tuple[Tree, ...] = ()
    having: tuple[Tree, ...] = ()
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    distinct: bool = False
    below: dict[tuple[str, ...], Below] = field(default_factory=dict)

    def capped(self, most: int | None) -> "Read":
        """Under a ceiling of rows, which holds for children too."""
        if most is None:
            return self
        return replace(self, limit=most if self.limit is None else min(self.limit, most))


@dataclass(frozen=True)
class Prefer:
    resolution: str | None = None
    representation: str | None = None
    count: str | None = None
    transaction: str | None = None
    missing: str | None = None
    handling: str | None = None
    timezone: str | None = None
    max_affected: int | None = None
    params: str | None = None
    applied: tuple[str, ...] = ()


def combine(op: str, trees: tuple[Tree, ...]) -> Tree | None:
    """One tree of several; none of none."""
    trees = tuple(t for t in trees if t is not None)
    return None if not trees else trees[0] if len(trees) == 1 else Logic(op, trees)


def negate(tree: Tree) -> Tree:
    return replace(tree, negated=not tree.negated)

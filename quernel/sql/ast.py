"""Syntax tree of the dialect."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class ColumnRef:
    name: str
    qualifier: str | None = None

    def __str__(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Literal:
    value: int | Decimal | str | bool | datetime.date

    def __str__(self) -> str:
        return str(self.value).lower() if isinstance(self.value, bool) else str(self.value)


@dataclass(frozen=True)
class Aggregate:
    """``argument`` is None for COUNT(*)."""

    function: str
    argument: ColumnRef | None = None

    @property
    def canonical_name(self) -> str:
        return f"{self.function}({self.argument.name if self.argument else '*'})"


Operand = ColumnRef | Literal | Aggregate


@dataclass(frozen=True)
class Comparison:
    """``op`` is one of = != < <= > >=."""

    op: str
    left: Operand
    right: Operand


@dataclass(frozen=True)
class Between:
    value: Operand
    low: Operand
    high: Operand


@dataclass(frozen=True)
class In:
    value: Operand
    items: tuple[Operand, ...]


@dataclass(frozen=True)
class IsNull:
    value: Operand
    negated: bool = False


@dataclass(frozen=True)
class Truth:
    """A BOOL operand as a predicate."""

    value: Operand


@dataclass(frozen=True)
class Not:
    child: Predicate


@dataclass(frozen=True)
class And:
    left: Predicate
    right: Predicate


@dataclass(frozen=True)
class Or:
    left: Predicate
    right: Predicate


Predicate = Comparison | Between | In | IsNull | Truth | Not | And | Or


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    @property
    def effective_name(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    table: TableRef
    left: ColumnRef
    right: ColumnRef


@dataclass(frozen=True)
class SelectItem:
    value: ColumnRef | Aggregate
    alias: str | None = None

    @property
    def output_name(self) -> str:
        if self.alias:
            return self.alias
        return self.value.canonical_name if isinstance(self.value, Aggregate) else self.value.name


@dataclass(frozen=True)
class OrderItem:
    column: ColumnRef
    descending: bool = False


@dataclass(frozen=True)
class Select:
    """``items`` is None for ``*``."""

    items: tuple[SelectItem, ...] | None
    table: TableRef
    joins: tuple[Join, ...] = ()
    where: Predicate | None = None
    group_by: tuple[ColumnRef, ...] = ()
    having: Predicate | None = None
    order_by: tuple[OrderItem, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class CreateIndex:
    """``kind`` is BTREE or HASH."""

    table: str
    column: str
    kind: str = "BTREE"


Statement = Select | CreateIndex


def conjuncts(p: Predicate | None) -> list[Predicate]:
    """The parts of a chain of ANDs, in written order."""
    if p is None:
        return []
    return [*conjuncts(p.left), *conjuncts(p.right)] if isinstance(p, And) else [p]


def operands(p: Predicate | None) -> list[Operand]:
    """Every operand of a predicate, in written order."""
    match p:
        case None:
            return []
        case And(a, b) | Or(a, b):
            return [*operands(a), *operands(b)]
        case Not(a):
            return operands(a)
        case Comparison(_, a, b):
            return [a, b]
        case Between(v, a, b):
            return [v, a, b]
        case In(v, items):
            return [v, *items]
        case IsNull(v, _) | Truth(v):
            return [v]
    raise TypeError(p)

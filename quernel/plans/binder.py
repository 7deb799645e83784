"""Syntax tree to DataFrame.

Every column of every table gets a name of its own for the time of the query, so that qualifiers are honoured, self
joins are plain joins and no name is ambiguous to Spark. All names and types are checked here, before anything runs.
What is left to Catalyst: pushdown, pruning, join order and strategy, partial aggregation, top-k.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.catalog import Catalog, Table
from quernel.errors import AmbiguousColumn, BindError, TypeMismatch, UnknownColumn
from quernel.functions.aggregates import aggregate, result_type
from quernel.functions.types import SqlType, literal_type, sql_type, text_literal_as
from quernel.plans.access_path import AccessPath, choose
from quernel.sql.ast import Aggregate, And, Between, ColumnRef, Comparison, In, IsNull, Literal, Not, Operand, Or, Predicate, Select, SelectItem, TableRef, Truth, conjuncts, operands


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Bound:
    """A column of the query: the name it has inside, its type and where it comes from."""

    inner: str
    kind: T.DataType
    name: str
    table: int = -1

    @property
    def column(self) -> Column:
        return F.col(_quoted(self.inner))


@dataclass
class Scope:
    """The tables of FROM and JOIN, in order."""

    tables: list[Table] = field(default_factory=list)
    names: list[str] = field(default_factory=list)

    def add(self, ref: TableRef, table: Table) -> int:
        if ref.effective_name.lower() in self.names:
            raise BindError(f"two tables are called {ref.effective_name!r}; give one an alias")
        self.tables.append(table)
        self.names.append(ref.effective_name.lower())
        return len(self.tables) - 1

    def columns(self, i: int) -> list[Bound]:
        return [Bound(f"{i}.{f.name}", f.dataType, f.name, i) for f in self.tables[i].frame.schema.fields]

    def find(self, ref: ColumnRef, among: range | None = None) -> Bound:
        among = among if among is not None else range(len(self.tables))
        if ref.qualifier is not None:
            if ref.qualifier.lower() not in self.names:
                raise UnknownColumn(f"{ref}: no table is called {ref.qualifier!r}")
            among = range(i, i + 1) if (i := self.names.index(ref.qualifier.lower())) in among else range(0)
        found = [b for i in among for b in self.columns(i) if b.name.lower() == ref.name.lower()]
        if not found:
            raise UnknownColumn(f"unknown column {str(ref)!r}")
        if len(found) > 1:
            raise AmbiguousColumn(f"column {ref.name!r} is in more than one table; qualify it")
        return found[0]


def _typed(left: tuple[Column, T.DataType | None, Operand], right: tuple[Column, T.DataType | None, Operand]) -> tuple[Column, Column]:
    """Both sides of a comparison, TEXT moved to the other side's type."""

    def kind(side) -> SqlType:
        return literal_type(side[2].value) if isinstance(side[2], Literal) else sql_type(side[1])

    a, b = kind(left), kind(right)
    if SqlType.OTHER in (a, b):
        raise TypeMismatch(f"{left[2]} and {right[2]} cannot be compared")
    if a == b or a.is_number and b.is_number:
        return left[0], right[0]
    for text, other, flip in ((left, right, False), (right, left, True)):
        if kind(text) != SqlType.TEXT:
            continue
        if isinstance(text[2], Literal):
            target = other[1] if other[1] is not None else {SqlType.INT: T.LongType(), SqlType.DECIMAL: T.DecimalType(38, 18), SqlType.BOOL: T.BooleanType()}[kind(other)]
            moved = text_literal_as(text[2].value, target)
        else:
            moved = text[0].cast(other[1] if other[1] is not None else ("boolean" if kind(other) == SqlType.BOOL else "decimal(38,18)"))
        return (other[0], moved) if flip else (moved, other[0])
    raise TypeMismatch(f"{a.value} {left[2]} cannot be compared with {b.value} {right[2]}")


_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


class PredicateBinder:
    """Predicates over whatever ``resolve`` gives for a column or an aggregate."""

    def __init__(self, resolve):
        self.resolve = resolve

    def side(self, o: Operand) -> tuple[Column, T.DataType | None, Operand]:
        if isinstance(o, Literal):
            return F.lit(o.value), None, o
        b = self.resolve(o)
        return b.column, b.kind, o

    def compare(self, op: str, left: Operand, right: Operand) -> Column:
        return _COMPARE[op](*_typed(self.side(left), self.side(right)))

    def bind(self, p: Predicate) -> Column:
        match p:
            case And(a, b):
                return self.bind(a) & self.bind(b)
            case Or(a, b):
                return self.bind(a) | self.bind(b)
            case Not(a):
                return ~self.bind(a)
            case Comparison(op, a, b):
                return self.compare(op, a, b)
            case Between(v, low, high):
                return self.compare(">=", v, low) & self.compare("<=", v, high)
            case In(v, items):
                return self.membership(v, items)
            case IsNull(v, negated):
                c = self.side(v)[0]
                return c.isNotNull() if negated else c.isNull()
            case Truth(v):
                column, kind, _ = self.side(v)
                if (sql_type(kind) if kind is not None else literal_type(v.value)) != SqlType.BOOL:
                    raise TypeMismatch(f"{v} is not a BOOL")
                return column
        raise TypeError(p)

    def membership(self, value: Operand, items: tuple[Operand, ...]) -> Column:
        pairs = [_typed(self.side(value), self.side(i)) for i in items]
        if all(isinstance(i, Literal) for i in items) and not isinstance(value, Literal):
            kinds = {literal_type(i.value) for i in items}
            own = sql_type(self.side(value)[1])
            if len(kinds) == 1 and own != SqlType.TEXT:
                return pairs[0][0].isin(*[b for _, b in pairs])
            if kinds == {SqlType.TEXT}:
                return pairs[0][0].isin(*[i.value for i in items])
        return reduce(lambda a, b: a | b, [a == b for a, b in pairs])


@dataclass
class Query:
    """A bound SELECT. ``paths`` has the access path of each table."""

    select: Select
    scope: Scope
    paths: list[AccessPath]
    frame: DataFrame


class Binder:
    def __init__(self, catalog: Catalog, use_indexes: bool = True):
        self.catalog = catalog
        self.use_indexes = use_indexes

    def bind(self, s: Select) -> Query:
        scope = Scope()
        for ref in (s.table, *(j.table for j in s.joins)):
            scope.add(ref, self.catalog.get_table(ref.name))
        if any(isinstance(o, Aggregate) for o in operands(s.where)):
            raise BindError("WHERE cannot hold an aggregate; use HAVING")
        paths = [self.path(scope, i, s) for i in range(len(scope.tables))]
        used = self.used_columns(s, scope)
        frames = [p.frame(t).selectExpr(*[f"{_quoted(b.name)} AS {_quoted(b.inner)}" for b in scope.columns(i) if used is None or b.inner in used]) for i, (p, t) in enumerate(zip(paths, scope.tables, strict=True))]
        df = frames[0]
        for i, join in enumerate(s.joins, 1):
            left, right = self.join_columns(scope, join.left, join.right, i)
            df = df.join(frames[i], left.column == right.column, "inner")
        if s.where is not None:
            df = df.where(PredicateBinder(scope.find).bind(s.where))
        grouped = bool(s.group_by) or any(isinstance(o, Aggregate) for o in [i.value for i in s.items or ()] + operands(s.having))
        if grouped:
            df = self.aggregate(df, s, scope)
        elif s.having is not None:
            raise BindError("HAVING needs GROUP BY or an aggregate")
        else:
            items = [(b.name, b) for i in range(len(scope.tables)) for b in scope.columns(i)] if s.items is None else [(i.output_name, scope.find(i.value)) for i in s.items]
            df = self.finish(df, s, items, scope.find)
        return Query(s, scope, paths, df)

    def used_columns(self, s: Select, scope: Scope) -> set[str] | None:
        """Inner names of the columns that the query may need (None: all), so that the plan starts small."""
        if s.items is None and not s.group_by:
            return None
        refs = [*s.group_by, *(o.column for o in s.order_by), *(c for j in s.joins for c in (j.left, j.right))]
        for o in [i.value for i in s.items or ()] + operands(s.where) + operands(s.having):
            refs += [o] if isinstance(o, ColumnRef) else [o.argument] if isinstance(o, Aggregate) and o.argument else []
        names = {r.name.lower() for r in refs}
        return {b.inner for i in range(len(scope.tables)) for b in scope.columns(i) if b.name.lower() in names}

    def path(self, scope: Scope, i: int, s: Select) -> AccessPath:
        if not self.use_indexes:
            return AccessPath(0.0, 0.0)

        def belongs(ref: ColumnRef) -> bool:
            return scope.find(ref).table == i

        return choose(self.catalog, scope.tables[i], conjuncts(s.where), belongs)

    def join_columns(self, scope: Scope, a: ColumnRef, b: ColumnRef, joined: int) -> tuple[Bound, Bound]:
        """(column of the tables so far, column of the joined table), in whichever order they are written."""
        before, new = range(joined), range(joined, joined + 1)
        try:
            left, right = scope.find(a, before), scope.find(b, new)
        except UnknownColumn as error:
            try:
                right, left = scope.find(a, new), scope.find(b, before)
            except UnknownColumn:
                raise error from None
        x, y = sql_type(left.kind), sql_type(right.kind)
        if SqlType.OTHER in (x, y) or x != y and not (x.is_number and y.is_number):
            raise TypeMismatch(f"cannot join {x.value} {a} with {y.value} {b}")
        return left, right

    def aggregate(self, df: DataFrame, s: Select, scope: Scope) -> DataFrame:
        keys = {(b := scope.find(c)).inner: b for c in s.group_by}
        aliases: dict[str, list[SelectItem]] = {}
        for item in s.items or ():
            if item.alias:
                aliases.setdefault(item.alias.lower(), []).append(item)
        bound: dict[tuple[str, str | None], tuple[Bound, Column]] = {}

        def computed(a: Aggregate) -> Bound:
            argument = scope.find(a.argument) if a.argument else None
            key = (a.function, argument.inner if argument else None)
            if key not in bound:
                scale = scope.tables[argument.table].double_scale if argument else None
                expression = aggregate(a.function, argument.column if argument else None, argument.kind if argument else None, scale)
                inner = f"agg{len(bound)}"
                bound[key] = (Bound(inner, result_type(a.function, argument.kind if argument else None), a.canonical_name), expression)
            return bound[key][0]

        def key_column(ref: ColumnRef) -> Bound:
            b = scope.find(ref)
            if b.inner not in keys:
                raise BindError(f"{str(ref)!r} is neither grouped nor aggregated")
            return b

        def resolve(o: ColumnRef | Aggregate) -> Bound:
            return computed(o) if isinstance(o, Aggregate) else key_column(o)

        def resolve_having(o: ColumnRef | Aggregate) -> Bound:
            try:
                return resolve(o)
            except BindError:
                named = aliases.get(o.name.lower(), []) if isinstance(o, ColumnRef) and o.qualifier is None else []
                if len(named) != 1:
                    raise
                return resolve(named[0].value)

        having = PredicateBinder(resolve_having).bind(s.having) if s.having is not None else None
        if s.items is None:
            items = [(b.name, b) for b in keys.values()] + [(b.name, b) for b, _ in bound.values()]
        else:
            items = [(i.output_name, resolve(i.value)) for i in s.items]
        grouped = df.groupBy(*[b.column for b in keys.values()])
        if bound:
            df = grouped.agg(*[e.alias(b.inner) for b, e in bound.values()])
        else:
            df = df.select(*[b.column for b in keys.values()]).distinct()
        if having is not None:
            df = df.where(having)
        return self.finish(df, s, items, resolve)

    def finish(self, df: DataFrame, s: Select, items: list[tuple[str, Bound]], resolve) -> DataFrame:
        """ORDER BY (below the projection, so that hidden columns work), projection, LIMIT."""
        order = []
        for o in s.order_by:
            named = [b for i, (_, b) in zip(s.items, items, strict=True) if i.alias and i.alias.lower() == o.column.name.lower()] if s.items is not None and o.column.qualifier is None else []
            if len(named) > 1:
                raise AmbiguousColumn(f"two columns of the result are called {o.column.name!r}")
            column = (named[0] if named else resolve(o.column)).column
            order.append(column.desc_nulls_last() if o.descending else column.asc_nulls_last())
        if order:
            df = df.orderBy(*order)
        df = df.selectExpr(*[f"{_quoted(b.inner)} AS {_quoted(name)}" for name, b in items])
        return df if s.limit is None else df.limit(max(0, min(s.limit, 2**31 - 1)))

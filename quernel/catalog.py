"""Tables, their statistics and their indexes.

An index is a second copy of a table whose files are laid out by one column: BTREE by ranges of the column, sorted, so
that equality and range predicates read few files and row groups; HASH by a hash of it, so that an equality predicate
reads one folder. The copies leave out rows whose key is NULL, which no such predicate keeps.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import BindError, TypeMismatch, UnknownColumn, UnknownTable
from quernel.functions.types import SqlType, literal_type, sql_type, text_literal_as
from quernel.plans.scratch import new_path
from quernel.sources.parquet import read_parquet

_BUCKET = "__bucket"


@dataclass(frozen=True)
class IndexEntry:
    table: str
    column: str
    kind: str
    frame: DataFrame
    buckets: int

    @property
    def supports_range(self) -> bool:
        return self.kind == "BTREE"

    @property
    def key_type(self) -> T.DataType:
        return self.frame.schema[self.column].dataType

    def _key(self, value: object) -> Column:
        if isinstance(value, str):
            return text_literal_as(value, self.key_type)
        own, given = sql_type(self.key_type), literal_type(value)
        if own != given and not (own.is_number and given.is_number):
            raise TypeMismatch(f"{given.value} cannot be compared with {self.column}, which is {own.value}")
        return F.lit(value)

    def lookup(self, value: object) -> DataFrame:
        """Rows whose key equals ``value``."""
        key, column = self._key(value), F.col(f"`{self.column}`")
        rows = self.frame
        if self.kind == "HASH":
            typed = key.try_cast(self.key_type)
            # A value that its type cannot hold (1.5 in an INT column) has no bucket, and no rows.
            rows = rows.where((F.col(_BUCKET) == F.pmod(F.hash(typed), F.lit(self.buckets))) & (typed == key))
        return rows.where(column == key).drop(_BUCKET)

    def range(self, low: object = None, low_inclusive: bool = True, high: object = None, high_inclusive: bool = True) -> DataFrame:
        """Rows whose key lies between the bounds; None is no bound."""
        if not self.supports_range:
            raise BindError(f"the {self.kind} index on {self.table}({self.column}) does not support ranges")
        rows, column = self.frame, F.col(f"`{self.column}`")
        if low is not None:
            rows = rows.where(column >= self._key(low) if low_inclusive else column > self._key(low))
        if high is not None:
            rows = rows.where(column <= self._key(high) if high_inclusive else column < self._key(high))
        return rows


@dataclass
class TableStats:
    """Numbers computed when first asked for and then kept.

    They are exact, or, where ``exact`` is False, distinct counts are estimates that need no shuffle of the values.
    """

    frame: DataFrame
    _rows: int | None = None
    _distinct: dict[str, int] = field(default_factory=dict)
    exact: bool = True

    @property
    def row_count(self) -> int:
        if self._rows is None:
            self._rows = self.frame.count()
        return self._rows

    def distinct_count(self, column: str) -> int:
        """Distinct non-NULL values, 1 at least; the row count for a column that the table lacks."""
        key = column.lower()
        if key not in self._distinct:
            if key not in {c.lower() for c in self.frame.columns}:
                return self.row_count
            values = self.frame.select(F.col(f"`{column}`"))
            distinct = F.count_distinct(values[0]) if self.exact else F.approx_count_distinct(values[0], 0.02)
            rows, n = values.agg(F.count(F.lit(1)), distinct).first()
            self._rows, self._distinct[key] = rows, max(n, 1)
        return self._distinct[key]


@dataclass(frozen=True)
class Table:
    """``double_scale``: places to which SUM and AVG take floating-point columns (None: as they are)."""

    name: str
    frame: DataFrame
    stats: TableStats
    double_scale: int | None = None


class Catalog:
    """Names are case-insensitive. Replacing a table drops its indexes."""

    def __init__(self, spark: SparkSession, exact_statistics: bool = True):
        self.spark = spark
        self.exact_statistics = exact_statistics
        self._tables: dict[str, Table] = {}
        self._indexes: dict[tuple[str, str], IndexEntry] = {}

    def add_table(self, name: str, frame: DataFrame, double_scale: int | None = None) -> Table:
        lowered = [c.lower() for c in frame.columns]
        if len(set(lowered)) != len(lowered):
            raise BindError(f"table {name} has two columns of one name")
        table = Table(name, frame, TableStats(frame, exact=self.exact_statistics), double_scale)
        self._tables[name.lower()] = table
        self._indexes = {k: v for k, v in self._indexes.items() if k[0] != name.lower()}
        return table

    def add_rows(self, name: str, rows: list, schema: T.StructType | str) -> Table:
        return self.add_table(name, self.spark.createDataFrame(rows, schema))

    def add_parquet(self, path: str, name: str | None = None, double_scale: int | None = None) -> Table:
        """Named after the file, if not given a name."""
        name = name or os.path.basename(path.rstrip("/")).split(".")[0]
        return self.add_table(name, read_parquet(self.spark, path), double_scale)

    def get_table(self, name: str) -> Table:
        table = self.try_get_table(name)
        if table is None:
            raise UnknownTable(f"unknown table {name!r}")
        return table

    def try_get_table(self, name: str) -> Table | None:
        return self._tables.get(name.lower())

    @property
    def table_names(self) -> list[str]:
        return [t.name for t in self._tables.values()]

    def create_index(self, table_name: str, column: str, kind: str = "BTREE", partitions: int | None = None) -> IndexEntry:
        """Write the copy; an index that the column has already is replaced."""
        table = self.get_table(table_name)
        name = next((c for c in table.frame.columns if c.lower() == column.lower()), None)
        if name is None:
            raise UnknownColumn(f"table {table.name} has no column {column!r}")
        if sql_type(table.frame.schema[name].dataType) == SqlType.OTHER:
            raise TypeMismatch(f"{column} has a type that cannot be indexed")
        if kind not in ("BTREE", "HASH"):
            raise BindError(f"unknown kind of index {kind!r}")
        n = partitions or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        key = F.col(f"`{name}`")
        rows = table.frame.where(key.isNotNull())
        path = new_path(self.spark, "index")
        if kind == "BTREE":
            rows.repartitionByRange(n, key).sortWithinPartitions(key).write.parquet(path)
        else:
            # The bucket and a few bits of the row's own hash: a bucket with one huge key is written by several tasks.
            salt = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in table.frame.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]), F.lit(4))
            bucketed = rows.withColumn(_BUCKET, F.pmod(F.hash(key), F.lit(n)))
            bucketed.repartition(n, _BUCKET, salt).sortWithinPartitions(_BUCKET, key).write.partitionBy(_BUCKET).parquet(path)
        schema = table.frame.schema if kind == "BTREE" else T.StructType([*table.frame.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        entry = IndexEntry(table.name, name, kind, self.spark.read.schema(schema).parquet(path), n)
        self._indexes[table.name.lower(), name.lower()] = entry
        return entry

    def try_get_index(self, table: str, column: str) -> IndexEntry | None:
        return self._indexes.get((table.lower(), column.lower()))



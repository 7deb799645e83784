"""The engine's operators as functions of DataFrames, for plans built by hand.

Columns are named, not numbered. Strategies differ in the physical plan only, never in the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.aggregates import aggregate

#: (function, column or None for COUNT(*)).
AggregateSpec = tuple[str, str | None]

#: The most estimated bytes of a side that a nested loop broadcasts.
NESTED_LOOP_BYTES = 64 << 20


def seq_scan(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df if columns is None else df.select(*columns)


def filter_(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which ``condition`` is true; false and NULL drop out."""
    return df.where(condition)


def project(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Columns in the given order, repeated ones too; a mapping gives output name to column."""
    if isinstance(columns, Mapping):
        return df.select([F.col(c).alias(n) for n, c in columns.items()])
    return df.select([F.col(c) for c in columns])



def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Inner equi-join; NULL keys match nothing. Left columns, then right ones.

    The engine broadcasts a side that its threshold allows, else both are shuffled and the right one is hashed.
    """
    build = right.alias("r") if _small(right) else right.alias("r").hint("shuffle_hash")
    return left.alias("l").join(build, F.col(f"l.`{left_key}`") == F.col(f"r.`{right_key}`"), "inner")


def _small(df: DataFrame) -> bool:
    return estimated_bytes(df) <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def nested_loop_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The result of ``hash_join`` by comparing every pair of rows, for right sides of a few rows.

    Only a right side of at most NESTED_LOOP_BYTES by estimate is broadcast for that; a larger one is joined by hash.
    """
    if estimated_bytes(right) > NESTED_LOOP_BYTES:
        return hash_join(left, right, left_key, right_key)
    a, b = F.col(f"l.`{left_key}`"), F.col(f"r.`{right_key}`")
    return left.alias("l").join(F.broadcast(right).alias("r"), (a <= b) & (a >= b), "inner")


def hash_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, AggregateSpec], double_scale: int | None = None) -> DataFrame:
    """One row per group (NULL is a group), key columns first. Without keys one row, also over no rows."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = [aggregate(f, F.col(f"`{c}`") if c is not None else None, kinds.get(c), double_scale).alias(n) for n, (f, c) in aggregates.items()]
    return df.groupBy(*keys).agg(*columns) if columns else df.select(*keys).distinct()


def parallel_hash_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Mapping[str, AggregateSpec], degree: int, condition: Column | None = None, double_scale: int | None = None) -> DataFrame:
    """``hash_aggregate`` in exactly ``degree`` partitions: each filters and aggregates its own rows before the shuffle.

    Fewer partitions than the input has are made without moving rows. More are made by moving the columns in use of the
    rows that ``condition`` keeps, so a degree far above that of the scan pays only where the work on a row does.
    """
    if degree < 1:
        raise ValueError("degree must be positive")
    rows = df if condition is None else df.where(condition)
    used = [*keys, *dict.fromkeys(c for _, c in aggregates.values() if c is not None and c not in keys)]
    rows = rows.select([F.col(f"`{c}`") for c in used])
    # By number of the row: spread evenly whatever the values, and without the sort of a round robin.
    rows = rows.repartition(degree, F.monotonically_increasing_id()) if rows._jdf.queryExecution().toRdd().getNumPartitions() < degree else rows.coalesce(degree)
    return hash_aggregate(rows, keys, aggregates, double_scale)


def sort(df: DataFrame, keys: Sequence[str | tuple[str, bool]]) -> DataFrame:
    """By several keys, (name, True) being descending; NULLs last both ways."""
    pairs = [(k, False) if isinstance(k, str) else k for k in keys]
    return df.orderBy(*[F.col(k).desc_nulls_last() if down else F.col(k).asc_nulls_last() for k, down in pairs])


def limit(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows, none for ``n`` <= 0. After ``sort`` this is one top-k operator."""
    return df.limit(max(n, 0))



"""Data-quality profile of tables that arrive in loads.

Constraints are declared once per column (``Rule``) and compiled into the aggregate expressions of one shared scan.
The scan yields *states* per load: rows whose counts simply add up, so the states of loads, partitions or days can be
stored (``KeptStates``), put together later (``merge_frequency_states`` / ``merge_profile_states``) and need never be
computed again for data that has been seen. Two kinds exist:

* frequency states (load, column, value, n): exact, for columns of a small domain such as flags, years or quantities;
  a load holds at most as many of them as the column has distinct values, however many rows it has;
* profile states (load, column, counters, range, HyperLogLog and KLL sketch): of fixed size, for any column.

Metrics follow from states alone. ``with_previous_load`` sets the metrics of a load beside those of the load before
it in the same feed, ``control_limits`` tests them against the mean and deviation of the loads before.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    """What makes a non-NULL value of ``column`` valid: a closed range, a set of values, or a pattern (full match)."""

    column: str
    low: int | float | None = None
    high: int | float | None = None
    allowed: tuple | None = None
    pattern: str | None = None

    def valid(self, value: Column) -> Column:
        """NULL for NULL, else whether the value is valid."""
        tests = [F.lit(True)]
        if self.low is not None:
            tests.append(value >= F.lit(self.low))
        if self.high is not None:
            tests.append(value <= F.lit(self.high))
        if self.allowed is not None:
            tests.append(value.isin(*self.allowed))
        if self.pattern is not None:
            tests.append(value.cast("string").rlike(f"^(?:{self.pattern})$"))
        return F.when(value.isNotNull(), reduce(lambda a, b: a & b, tests))


def frequency_states(df: DataFrame, by: str, rules: Sequence[Rule]) -> DataFrame:
    """Exact states (``by``, column_name, value, n) of integer columns in one scan.

    A column has one rule. NULL is a value of its own, so is a NULL in ``by``. Rows are counted as stored, repeated ones too. An empty table
    has no states. Columns other than ``by`` and those of the rules are not read, whatever their names. Rows are
    counted in each input partition before the shuffle, which is keyed by value too, so a load that holds a large part
    of the table is spread over the tasks.
    """
    if len({r.column for r in rules}) != len(rules):
        raise ValueError("a column has one rule")
    names = [f"_v{i}" for i in range(len(rules))]
    rows = df.select(F.col(by).alias("_by"), *[F.col(r.column).cast("long").alias(n) for n, r in zip(names, rules, strict=True)])
    counted = rows.groupingSets([["_by", n] for n in names], "_by", *names).agg(F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    # A set bit of grouping_id is a column that is not in the set; the first column is the highest bit.
    every = (1 << len(names)) - 1
    of = lambda values: reduce(lambda acc, i: F.when(F.col("_set") == (every ^ 1 << (len(names) - 1 - i)), values[i]).otherwise(acc), range(len(names)), F.lit(None))
    return counted.select(F.col("_by").alias(by), of([F.lit(r.column) for r in rules]).alias("column_name"), of([F.col(n) for n in names]).alias("value"), "n")


def merge_frequency_states(states: Sequence[DataFrame], by: str) -> DataFrame:
    """Put the states of separate scans together, which may have rows of the same load."""
    union = reduce(DataFrame.unionByName, states)
    return union.groupBy(by, "column_name", "value").agg(F.sum("n").alias("n"))


class KeptStates:
    """Frequency states of a table that arrives in loads, kept in a folder and added to load by load.

    A load is taken as complete when its first row is seen: ``update`` computes states for the loads that the folder
    does not hold yet and reads other rows of no column but ``by``. NULL in ``by`` is a load too. Each update is a
    folder of its own, written whole or not at all, so one that failed is simply run again.
    """

    #: Loads that are named in the filter of an update, so that it reaches the files; more are joined.
    NAMED = 1000

    def __init__(self, spark: SparkSession, path: str, by: str, rules: Sequence[Rule]):
        self.spark, self.path, self.by, self.rules = spark, path.rstrip("/"), by, tuple(rules)

    def _updates(self) -> list[str]:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().toString() for s in fs.listStatus(folder) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(jvm_path(f"{n}/_SUCCESS")))

    def states(self) -> DataFrame | None:
        """The states of all updates put together; None before the first."""
        found = self._updates()
        if not found:
            return None
        kept = self.spark.read.parquet(*found)
        return kept if len(found) == 1 else merge_frequency_states([kept], self.by)

    def new_rows(self, df: DataFrame) -> DataFrame:
        """Rows of loads that are not kept yet."""
        found = self._updates()
        if not found:
            return df
        kept = self.spark.read.parquet(*found).select(F.col(self.by).alias("_kept")).distinct()
        new = df.select(F.col(self.by).alias("_new")).distinct().join(kept, F.col("_new").eqNullSafe(F.col("_kept")), "left_anti")
        named = [r[0] for r in new.limit(self.NAMED + 1).collect()]
        if len(named) > self.NAMED:
            return df.join(new, F.col(self.by).eqNullSafe(F.col("_new")), "left_semi")
        values = [v for v in named if v is not None]
        wanted = F.col(self.by).isin(*values) if values else F.lit(False)
        return df.where(wanted | F.col(self.by).isNull() if len(values) < len(named) else wanted)

    def update(self, df: DataFrame) -> None:
        new = self.new_rows(df.select(self.by, *[r.column for r in self.rules if r.column != self.by]))
        frequency_states(new, self.by, self.rules).write.parquet(f"{self.path}/update-{len(self._updates()):08d}-{uuid.uuid4().hex}")


def frequency_metrics(states: DataFrame, by: str, rules: Sequence[Rule]) -> DataFrame:
    """Exact metrics per (``by``, column_name) from frequency states.

    Columns: n_rows, n_nulls, n_invalid, n_valid, n_distinct (non-NULL values), min_value, max_value (over all values),
    valid_sum, valid_mean and valid_median (mean of the middle two; NULL without valid values). The one sort is over
    distinct values of a load, not over rows.
    """
    value, n = F.col("value"), F.col("n")
    valid = F.coalesce(reduce(lambda acc, r: F.when(F.col("column_name") == r.column, r.valid(value)).otherwise(acc), reversed(rules), F.lit(None).cast("boolean")), F.lit(False))
    group = Window.partitionBy(by, "column_name")
    # The median's places are counted over valid values only, which therefore come first.
    upto = group.orderBy(F.col("_valid").desc(), value.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        states.withColumn("_valid", valid)
        .withColumn("_upto", F.sum("n").over(upto))
        .withColumn("_of", F.sum(F.when(F.col("_valid"), n).otherwise(0)).over(group))
    )
    at = lambda place: F.min(F.when(F.col("_valid") & (F.col("_upto") >= place), value))
    out = counted.groupBy(by, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(value.isNull(), n).otherwise(0)).alias("n_nulls"),
        F.sum(F.when(value.isNotNull() & ~F.col("_valid"), n).otherwise(0)).alias("n_invalid"),
        F.sum(F.when(F.col("_valid"), n).otherwise(0)).alias("n_valid"),
        F.count(value).alias("n_distinct"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.sum(F.when(F.col("_valid"), value.cast("decimal(20,0)") * n)).alias("valid_sum"),
        at(F.expr("(_of + 1) div 2")).alias("_low"),
        at(F.expr("_of div 2 + 1")).alias("_high"),
    )
    return out.select(
        by, "column_name", "n_rows", "n_nulls", "n_invalid", "n_valid", "n_distinct", "min_value", "max_value", "valid_sum",
        (F.col("valid_sum").cast("double") / F.when(F.col("n_valid") > 0, F.col("n_valid"))).alias("valid_mean"),
        ((F.col("_low") + F.col("_high")) / F.lit(2.0)).alias("valid_median"),
    )


#: The metrics of a load that are set beside those of the load before.
COMPARED = ("null_share", "valid_mean", "valid_median")


def with_previous_load(metrics: DataFrame, loads: DataFrame) -> DataFrame:
    """Metrics of ``load_id`` with null_share, invalid_share and, as prev_*, the metrics of the load before.

    The load before is the one with the next lower load_no of the same feed in ``loads``. All prev_* are NULL for a
    first load, for a load that ``loads`` does not hold, and where the load before has no rows in the profiled table.
    """
    order = Window.partitionBy("feed").orderBy("load_no")
    place = loads.where(F.col("feed").isNotNull() & F.col("load_no").isNotNull()).select("load_id", "feed", "load_no").withColumn("_before_no", F.lag("load_no").over(order))
    non_null = F.col("n_rows") - F.col("n_nulls")
    own = metrics.withColumns({"null_share": F.col("n_nulls") / F.col("n_rows"), "invalid_share": F.col("n_invalid") / F.when(non_null > 0, non_null)})
    joined = own.join(place, "load_id", "left")
    same_column = Window.partitionBy("column_name", "feed").orderBy("load_no")
    is_before = F.col("feed").isNotNull() & (F.lag("load_no").over(same_column) == F.col("_before_no"))
    return joined.withColumns({f"prev_{m}": F.when(is_before, F.lag(m).over(same_column)) for m in COMPARED}).drop("_before_no")


def control_limits(metrics: DataFrame, tested: str | Sequence[str], history: int = 8, width: float = 3.0, least: int = 4, by: Sequence[str] = ("column_name",)) -> DataFrame:
    """Loads of which a metric leaves mean +/- ``width`` standard deviations of the up to ``history`` loads before.

    ``metrics`` is the result of ``with_previous_load``, ``tested`` one of its columns or several. A history is that of
    one feed, metric and value of the ``by`` columns. Loads with fewer than ``least`` known values before them are never
    flagged; neither are loads that ``loads`` does not place. After equal values (deviation 0) any other value is a
    case; differences of one part in a billion are none.
    """
    names = [tested] if isinstance(tested, str) else list(tested)
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))
    before = Window.partitionBy(*by, "metric", "feed").orderBy("load_no").rowsBetween(-history, -1)
    value = F.col("value")
    return (
        metrics.where(F.col("feed").isNotNull())
        .select(*by, "load_id", "feed", "load_no", rows)
        .withColumns({"_mean": F.avg(value).over(before), "_sd": F.stddev_samp(value).over(before), "_known": F.count(value).over(before)})
        .where((F.col("_known") >= least) & (F.abs(value - F.col("_mean")) > F.lit(width) * F.col("_sd") + F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs("_mean"))))
        .select(*by, "load_id", "metric", "value", F.col("_mean").alias("expected"), F.col("_sd").alias("deviation"))
    )


_SORTABLE = (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def profile_states(df: DataFrame, by: Sequence[str] = (), rules: Sequence[Rule] = ()) -> DataFrame:
    """States of fixed size, one row per group and column, for every column of ``df`` in one aggregate scan.

    Columns: ``by``, column_name, is_number, n_rows, n_nulls, n_invalid, min_value and max_value (as text), distinct_sketch
    (HyperLogLog, NULL if no values), quantile_sketch (KLL over the value as double; NULL for other types and without
    values). Columns of nested types get counts only. Without ``by`` an empty table gives rows with n_rows 0.
    """
    by_column: dict[str, list[Rule]] = {}
    for r in rules:
        by_column.setdefault(r.column, []).append(r)
    aggs, packed = [F.count(F.lit(1)).alias("_rows")], []
    for i, field in enumerate(x for x in df.schema.fields if x.name not in by):
        c, kind = F.col(f"`{field.name}`"), field.dataType
        plain = isinstance(kind, _SORTABLE)
        numeric = isinstance(kind, T.NumericType)
        bad = [~r.valid(c) for r in by_column.get(field.name, [])]
        aggs += [
            F.count(c).alias(f"_c{i}"),
            (F.sum(F.when(reduce(lambda a, b: a | b, bad), 1).otherwise(0)) if bad else F.lit(0).cast("long")).alias(f"_i{i}"),
            (F.min(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"_l{i}"),
            (F.max(c).cast("string") if plain else F.lit(None).cast("string")).alias(f"_h{i}"),
            (F.hll_sketch_agg(c.cast("string")) if plain else F.lit(None).cast("binary")).alias(f"_d{i}"),
            (F.kll_sketch_agg_double(c.cast("double")) if numeric else F.lit(None).cast("binary")).alias(f"_q{i}"),
        ]
        some = F.col(f"_c{i}") > 0
        packed.append(
            F.struct(
                F.lit(field.name).alias("column_name"), F.lit(numeric).alias("is_number"), F.col("_rows").alias("n_rows"), (F.col("_rows") - F.col(f"_c{i}")).alias("n_nulls"),
                F.coalesce(F.col(f"_i{i}"), F.lit(0)).cast("long").alias("n_invalid"), F.col(f"_l{i}").alias("min_value"), F.col(f"_h{i}").alias("max_value"),
                F.when(some, F.col(f"_d{i}")).alias("distinct_sketch"), F.when(some, F.col(f"_q{i}")).alias("quantile_sketch"),
            )
        )
    grouped = df.groupBy(*by).agg(*aggs)
    return grouped.select(*by, F.inline(F.array(*packed)))


def merge_profile_states(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Put profile states of the same column together, to the coarser grouping ``by``.

    The range of a number column is merged by value (compared as double), that of any other column as text, which is
    the order of dates and timestamps too.
    """
    low = F.min_by("min_value", F.expr("try_cast(min_value as double)"))
    high = F.max_by("max_value", F.expr("try_cast(max_value as double)"))
    return (
        states.groupBy(*by, "column_name", "is_number")
        .agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_nulls").alias("n_nulls"),
            F.sum("n_invalid").alias("n_invalid"),
            F.when(F.col("is_number"), low).otherwise(F.min("min_value")).alias("min_value"),
            F.when(F.col("is_number"), high).otherwise(F.max("max_value")).alias("max_value"),
            F.when(F.count("distinct_sketch") > 0, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch"),
            F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch")).alias("quantile_sketch"),
        )
    )


def profile_metrics(states: DataFrame) -> DataFrame:
    """null_share, invalid_share, distinct_estimate and median_estimate from profile states (NULL without values).

    A median is of values other than NaN. Columns of nested types have no estimates.
    """
    non_null = F.col("n_rows") - F.col("n_nulls")
    return states.withColumns(
        {
            "null_share": F.col("n_nulls") / F.when(F.col("n_rows") > 0, F.col("n_rows")),
            "invalid_share": F.col("n_invalid") / F.when(non_null > 0, non_null),
            "distinct_estimate": F.when(non_null > 0, F.hll_sketch_estimate("distinct_sketch")),
            "median_estimate": F.when(F.kll_sketch_get_n_double("quantile_sketch") > 0, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(0.5))),
        }
    ).drop("distinct_sketch", "quantile_sketch")

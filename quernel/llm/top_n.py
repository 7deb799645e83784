"""The top N items of every group, by skipping row groups whose statistics rule them out.

``cluster`` writes the items once, clustered by group: range-partitioned and sorted by (group, score descending, tie
columns), so a group of any size is spread over as many files and row groups as it fills. ``top_n`` reads the files'
footers; a row group whose statistics show one single group is skipped if its highest score is strictly below a score
that the group is known to have N times: first one known from the statistics of all files, then, as row groups are read
in the order of descending highest score, the group's current N-th score in the file. A row group that holds several
groups always holds the first items of one of them and is read. What is left per file is at most N items a group.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.plans.scratch import new_path, open_filesystem


@dataclass(frozen=True)
class Clustered:
    """A written table of items and the index of its footers. ``schema`` has the group columns, the score and the tie columns."""

    path: str
    index: str
    schema: T.StructType
    group: tuple[str, ...]
    score: str
    tie: tuple[str, ...]


def cluster(items: DataFrame, group: Sequence[str], score: str, tie: Sequence[str], path: str | None = None, row_group_rows: int = 100_000) -> Clustered:
    """Write ``items`` clustered by ``group``.

    Items whose score is NULL or NaN are left out. Items are told apart by all of group, score and tie columns: rows
    equal in these count once. NULL is a group, and the lowest value of a tie column. Only these columns are read and
    written. ``row_group_rows`` is the most rows of a row group, the unit of skipping: footers grow as it shrinks.
    """
    columns = [*group, score, *tie]
    if not group or not tie or len(set(columns)) != len(columns):
        raise ValueError("group, score and tie must be different columns, and at least one each")
    kept = items.select(columns).where(F.col(score).isNotNull())
    if isinstance(items.schema[score].dataType, (T.DoubleType, T.FloatType)):
        kept = kept.where(~F.isnan(score))
    order = [*(F.col(c).asc_nulls_first() for c in group), F.col(score).desc(), *(F.col(c).asc_nulls_first() for c in tie)]
    path = path or new_path(items.sparkSession, "clustered")
    # Equal rows are in one range, so dropping repeated ones needs no second shuffle.
    ranged = kept.repartitionByRange(*order).dropDuplicates().sortWithinPartitions(*order)
    ranged.write.option("parquet.block.row.count.limit", row_group_rows).parquet(path)
    table = Clustered(path, f"{path}-footers", kept.schema, tuple(group), score, tuple(tie))
    _footers(items.sparkSession, table).write.parquet(table.index)
    return table


_ROW_GROUP = [T.StructField("_file", T.StringType()), T.StructField("_row_group", T.IntegerType()), T.StructField("_rows", T.LongType()), T.StructField("_single", T.BooleanType())]


def row_groups(spark: SparkSession, table: Clustered) -> DataFrame:
    """A row per row group: _file, _row_group, _rows, _low and _high score, _single and, where that is true, its group.

    Scores are NULL where the footer has no statistics. Read from the index that ``cluster`` wrote.
    """
    return spark.read.schema(_index_schema(table)).parquet(table.index)


def _index_schema(table: Clustered) -> T.StructType:
    score = table.schema[table.score].dataType
    fields = [*_ROW_GROUP, T.StructField("_low", score), T.StructField("_high", score), *(table.schema[g] for g in table.group)]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _footers(spark: SparkSession, table: Clustered) -> DataFrame:
    """``row_groups`` from the files' footers, which are read in parallel; no data is."""
    schema = _index_schema(table)
    arrow_schema = to_arrow_schema(schema)
    n_group = len(table.group)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            rows: list[tuple] = []
            for name in batch.column(0).to_pylist():
                filesystem, at = open_filesystem(name)
                with filesystem.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                for i in range(meta.num_row_groups):
                    rg = meta.row_group(i)
                    values, single = [], True
                    for c in range(n_group):
                        s = rg.column(c).statistics
                        if s is not None and s.has_null_count and s.null_count == rg.num_rows:
                            values.append(None)
                        elif s is not None and s.has_min_max and s.has_null_count and s.null_count == 0 and s.min == s.max:
                            values.append(s.min)
                        else:
                            values.append(None)
                            single = False
                    s = rg.column(n_group).statistics
                    low, high = (s.min, s.max) if s is not None and s.has_min_max else (None, None)
                    rows.append((name, i, rg.num_rows, single, low, high, *values))
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow_schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, arrow_schema, strict=True)], schema=arrow_schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(table.path).select("path")
    return files.mapInArrow(footers, schema)


def needed_row_groups(spark: SparkSession, table: Clustered, n: int) -> DataFrame:
    """``row_groups`` without those that the statistics of all files rule out for the top ``n``.

    A row group of one group with at least n items proves that the group's n-th score is not below its lowest score.
    """
    found = row_groups(spark, table)
    proven = found.where(F.col("_single") & (F.col("_rows") >= n)).groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(table.group)]).agg(F.max("_low").alias("_bound"))
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(table.group)])
    joined = found.join(proven, F.col("_single") & same, "left")
    return joined.where(F.col("_bound").isNull() | F.col("_high").isNull() | (F.col("_high") >= F.col("_bound"))).select(found.columns)


def skipped(spark: SparkSession, table: Clustered, n: int) -> DataFrame:
    """One row: row groups and rows of the table, and those that the statistics of all files rule out for the top ``n``."""
    kept = row_groups(spark, table).select("_rows", F.lit(0).alias("_read")).unionByName(needed_row_groups(spark, table, n).select("_rows", F.lit(1).alias("_read")))
    total = lambda sign, of: F.coalesce(F.sum(F.when(F.col("_read") == 0, of).otherwise(of * sign)), F.lit(0))
    one, rows = F.lit(1), F.col("_rows")
    return kept.agg(total(0, one).alias("row_groups"), total(0, rows).alias("rows"), total(-1, one).alias("skipped_row_groups"), total(-1, rows).alias("skipped_rows"))


def _starts(table: pa.Table, columns: Sequence[str]) -> np.ndarray:
    """The first row of each group of equal neighbours."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for c in columns:
        code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        change[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(change)


def _head(table: pa.Table, columns: Sequence[str], n: int) -> tuple[pa.Table, np.ndarray]:
    """The first ``n`` rows of each group of a sorted table, and where each group starts in these."""
    starts = _starts(table, columns)
    sizes = np.diff(np.append(starts, table.num_rows))
    rank = np.arange(table.num_rows) - np.repeat(starts, sizes)
    taken = np.minimum(sizes, n)
    return table.filter(pa.array(rank < n)), np.cumsum(taken) - taken


def _read_file(name: str, plan: list[dict], group: Sequence[str], score: str, n: int) -> Iterator[pa.Table]:
    """The first ``n`` items per group of the file's row groups in ``plan``, skipping by current n-th scores."""
    import pyarrow.parquet as pq

    filesystem, at = open_filesystem(name)
    key = lambda row: tuple(row[g] for g in group)
    best: dict[tuple, list] = {key(r): [] for r in plan if r["_single"]}
    plan = sorted((r for r in plan if r["_high"] is not None), key=lambda r: r["_high"], reverse=True) + [r for r in plan if r["_high"] is None]
    with filesystem.open_input_file(at) as f:
        parquet = pq.ParquetFile(f)
        for r in plan:
            if r["_single"] and r["_high"] is not None:
                scores = best[key(r)]
                if len(scores) == n and r["_high"] < scores[0]:
                    continue
            head, starts = _head(parquet.read_row_group(r["_row_group"]), group, n)
            # Only the first and the last group of a row group can go on in others.
            for i in {0, len(starts) - 1} if best and len(starts) else ():
                end = starts[i + 1] if i + 1 < len(starts) else head.num_rows
                scores = best.get(key(head.slice(starts[i], 1).to_pylist()[0]))
                if scores is not None:
                    for s in head.column(score).slice(starts[i], end - starts[i]).to_pylist():
                        (heapq.heappush if len(scores) < n else heapq.heappushpop)(scores, s)
            yield head


def candidates(spark: SparkSession, table: Clustered, n: int) -> DataFrame:
    """Rows of the table that hold the top ``n`` of every group: at most ``n`` a group and row group that is read."""
    group, score = table.group, table.score
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in table.schema.fields])
    arrow_schema = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_file: dict[str, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by_file.setdefault(row["_file"], []).append(row)
        for name, plan in by_file.items():
            for head in _read_file(name, plan, group, score, n):
                yield from head.select(arrow_schema.names).cast(arrow_schema).to_batches()

    # A given number of partitions stays: their few bytes say nothing about the work that they stand for.
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return needed_row_groups(spark, table, n).repartition(tasks, "_file").mapInArrow(read, schema)


def top_n(spark: SparkSession, table: Clustered, n: int) -> DataFrame:
    """The first ``n`` items of every group by score descending, then tie columns ascending (NULLs first), with rank.

    Groups with fewer items give all of them; an empty table gives none. Needs ``n`` >= 1.
    """
    if n < 1:
        raise ValueError("n must be positive")
    order = [F.col(table.score).desc(), *(F.col(c).asc_nulls_first() for c in table.tie)]
    rank = F.row_number().over(Window.partitionBy(*table.group).orderBy(*order))
    return candidates(spark, table, n).withColumn("rank", rank).where(F.col("rank") <= n)

"""Per-key work in chunks of equal size, however the rows are spread over the keys.

Keys that fill more than a chunk are *heavy*; there are at most n / ``chunk_rows`` of them. Their rows are counted in
each input partition; the prefix sum of these counts over (key, partition) gives the first position of each partition's
rows of each heavy key; each partition then numbers its own rows, and the positions cut the rows of all heavy keys into
chunks of exactly ``chunk_rows`` rows (the last may be smaller). A chunk is one task's work: a key with a third of all
rows fills a third of the chunks. Only the keys at a chunk's ends go on in its neighbours, and only their states are
merged, in the order of the chunks. All other keys are at most a chunk each and need no positions: hashing spreads them.

What is kept of the counts is a row per (partition, heavy key), never one per (partition, key).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quernel.plans.scratch import materialize, new_path, open_filesystem
from quernel.plans.shape import only_scans

#: Most chunks, and so most heavy keys, which are sent to every task; chunks of more rows are made to keep to it.
MAX_CHUNKS = 100_000
#: Most rows of a written file of offsets.
_FILE_ROWS = 1 << 20


def _stable(df: DataFrame) -> DataFrame:
    """``df`` itself where its partitions are the same in every run; else a written copy."""
    return df if only_scans(df) else materialize(df, "chunk-input")


class KeyOffsets:
    """Heavy keys of ``df`` and the first position of every (input partition, heavy key) in the order of ``keys``.

    ``chunk_rows`` is the size of a chunk; keys of more rows are heavy. With ``every_key`` all are taken as heavy, for
    work that needs all rows in the order of the keys; its offsets are a row per (partition, key).
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], chunk_rows: int = 262_144, every_key: bool = False):
        if not keys:
            raise ValueError("at least one key column is needed")
        if chunk_rows < 1:
            raise ValueError("chunk_rows must be positive")
        spark = df.sparkSession
        self.keys, self.chunk_rows, self.df = list(keys), chunk_rows, _stable(df)
        self._name = "_hash"
        while self._name in df.columns:
            self._name += "_"
        totals = self.df.groupBy(self._hash().alias(self._name)).agg(F.count(F.lit(1)).alias("_n"))
        self.heavy = materialize(totals if every_key else totals.where(F.col("_n") > chunk_rows), "heavy-keys")
        self.every_key = every_key
        self.n_heavy, rows = self._size()
        if not every_key and rows > chunk_rows * MAX_CHUNKS:
            self.chunk_rows = -(-rows // MAX_CHUNKS)
            self.heavy = self.heavy.where(F.col("_n") > self.chunk_rows)
            self.n_heavy, rows = self._size()
        self.n_chunks = -(-rows // self.chunk_rows)
        if not self.n_heavy:
            return
        own = self.rows_of(True, self.keys).withColumn("_pid", F.spark_partition_id())
        counts = own.groupBy("_pid", *self.keys).agg(F.count(F.lit(1)).alias("_n"))
        order = [*(F.col(k).asc_nulls_first() for k in self.keys), F.col("_pid").asc()]
        # Range partitioning makes the total of a partition's prefix sum the base of the next; a base is one number a
        # partition, so all of them fit one task.
        counts = materialize(counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "key-counts")
        totals = counts.groupBy("_part").agg(F.sum("_n").alias("_total"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
        upto = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        first = counts.join(bases, "_part").select("_pid", *self.keys, "_n", (F.col("_base") + F.sum("_n").over(upto) - F.col("_n")).alias("_first"))
        # Files by range of _pid: a task finds its own rows by the files' and row groups' statistics.
        self.path = new_path(spark, "key-offsets")
        first.repartitionByRange("_pid").sortWithinPartitions("_pid").write.options(**{"maxRecordsPerFile": _FILE_ROWS, "parquet.block.row.count.limit": 65_536}).parquet(self.path)

    def _hash(self) -> Column:
        """Keys are picked by a hash, a number: a small key that shares it with a heavy one is numbered too, which does no harm."""
        return F.xxhash64(*self.keys)

    def _size(self) -> tuple[int, int]:
        """Hashes of heavy keys and their rows."""
        return tuple(self.heavy.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first())

    def rows_of(self, heavy: bool, columns: Sequence[str] | None = None) -> DataFrame:
        """The rows of heavy keys, or of all others. Rows stay in their partitions."""
        rows = self.df if columns is None else self.df.select(*columns)
        if not self.n_heavy or self.every_key:
            return rows if heavy == self.every_key else rows.where(F.lit(False))
        # There are MAX_CHUNKS of them at most.
        return rows.join(F.broadcast(self.heavy.select(self._name)), self._hash() == F.col(self._name), "left_semi" if heavy else "left_anti")

    def number(self) -> DataFrame:
        """The rows of heavy keys with _pos, their place from 0 in the order of keys, and _chunk = _pos div chunk_rows.

        The order among rows of one key is that of the input partitions and of the rows in them. Rows stay where they
        are. NULL is a key like any other. Other columns called _pos or _chunk are left out.
        """
        fields = [f for f in self.df.schema.fields if f.name not in ("_pos", "_chunk")]
        schema = T.StructType([*fields, T.StructField("_pos", T.LongType(), False), T.StructField("_chunk", T.IntegerType(), False)])
        if not self.n_heavy:
            return self.df.sparkSession.createDataFrame([], schema)
        arrow_schema = to_arrow_schema(schema)
        keys, path, chunk_rows = self.keys, self.path, self.chunk_rows

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pid = TaskContext.get().partitionId()
            own, following, last = None, None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                if own is None:
                    own, following, last = _own_offsets(path, pid, keys)
                slot = own.slots(batch)
                if (slot < 0).any():
                    raise RuntimeError(f"partition {pid} has other keys than when it was counted")
                counts = np.bincount(slot, minlength=len(following))
                by_key = np.argsort(slot, kind="stable")
                pos = np.empty(batch.num_rows, np.int64)
                pos[by_key] = np.arange(batch.num_rows) + np.repeat(following - (np.cumsum(counts) - counts), counts)
                following += counts
                arrays = [batch.column(f.name) for f in fields] + [pa.array(pos), pa.array(pos // chunk_rows)]
                yield pa.RecordBatch.from_arrays([a.cast(t.type) for a, t in zip(arrays, arrow_schema, strict=True)], schema=arrow_schema)
            if own is not None and (following != last).any():
                raise RuntimeError(f"partition {pid} has other rows than when it was counted")

        return self.rows_of(True, [f.name for f in fields]).mapInArrow(rows, schema)

    def chunks(self) -> DataFrame:
        """``number`` with one chunk per partition: exactly ``chunk_rows`` rows in every partition but the last."""
        return self.number().repartitionById(max(1, self.n_chunks), F.col("_chunk"))


class _Slots:
    """Slots of a partition's own keys, found for whole batches."""

    def __init__(self, table: pa.Table, keys: Sequence[str]):
        self.keys = keys
        self.values = [table.column(k).combine_chunks().unique() for k in keys]
        code = self._codes([table.column(k).combine_chunks() for k in keys])
        self.order = np.argsort(code)
        self.sorted = code[self.order]

    def _codes(self, columns: list[pa.Array]) -> np.ndarray:
        """One number for each row's key; -1 if a value is unknown."""
        out, bad = np.zeros(len(columns[0]), np.int64), np.zeros(len(columns[0]), bool)
        for column, values in zip(columns, self.values, strict=True):
            at = pc.fill_null(pc.index_in(column, values), -1).to_numpy()
            bad |= at < 0
            out = out * len(values) + at
        out[bad] = -1
        return out

    def slots(self, batch: pa.RecordBatch) -> np.ndarray:
        code = self._codes([batch.column(k) for k in self.keys])
        at = np.minimum(np.searchsorted(self.sorted, code), len(self.sorted) - 1)
        return np.where(self.sorted[at] == code, self.order[at], -1)


def _own_offsets(path: str, pid: int, keys: Sequence[str]) -> tuple[_Slots, np.ndarray, np.ndarray]:
    """The keys of partition ``pid``, their first positions and the ends of their positions."""
    import pyarrow.dataset as ds

    filesystem, at = open_filesystem(path)
    own = ds.dataset(at, filesystem=filesystem, format="parquet").to_table(columns=[*keys, "_n", "_first"], filter=ds.field("_pid") == pid)
    if not own.num_rows:
        raise RuntimeError(f"partition {pid} has other keys than when it was counted")
    first = own.column("_first").to_numpy().astype(np.int64)
    return _Slots(own, keys), first.copy(), first + own.column("_n").to_numpy()


def chunked_aggregate(df: DataFrame, keys: Sequence[str], partial: Mapping[str, Column], merge: Mapping[str, Column], chunk_rows: int = 262_144) -> DataFrame:
    """One row per key: ``partial`` aggregates over each chunk's rows of a key, ``merge`` over these states.

    Rows of heavy keys are moved to their chunks, which are worked on one by one; a key inside a chunk is done then, the
    states of those at its ends are merged with its neighbours'. The other keys are one chunk each, called -1. ``merge``
    may use _chunk, as the states of a key come in the order of its chunks (``F.min_by(c, "_chunk")`` is the first
    state's). Columns other than the keys and those used by ``partial`` do not get in the way, whatever their names but
    _chunk and _pos; an empty table gives no rows; a NULL key is a key.
    """
    offsets = KeyOffsets(df, keys, chunk_rows)
    aggregates = [c.alias(n) for n, c in partial.items()]
    light = offsets.rows_of(False).groupBy(*keys).agg(*aggregates).withColumn("_chunk", F.lit(-1))
    merged = [c.alias(n) for n, c in merge.items()]
    done = light.groupBy(*keys).agg(*merged)
    if not offsets.n_heavy:
        return done
    states = offsets.chunks().groupBy("_chunk", *keys).agg(*aggregates)
    return done.unionByName(states.groupBy(*keys).agg(*merged))


def heavy_keys(totals: DataFrame, within: Sequence[str], n: str, hundredths: int) -> DataFrame:
    """Rows of ``totals`` whose ``n`` is at least ``hundredths`` of 100 of the sum of ``n`` of their ``within`` group."""
    sums = totals.groupBy(*within).agg(F.sum(n).alias("_all"))
    return totals.join(sums, list(within)).where(F.col(n) * 100 >= F.col("_all") * hundredths).drop("_all")

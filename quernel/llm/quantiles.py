"""Percentiles per group from mergeable randomized sketches.

A sketch keeps values in levels; a value of level h stands for 2**h values. A level that holds too much is compacted:
its values are sorted and every other one, from a first or second place drawn at random, moves up a level. Levels have
room for k, k*2/3, k*4/9, ... values from the top down, 8 at least. Merging two sketches joins their levels and compacts
again, so sketches of partitions, loads or days can be put together in any order. Up to k values are held exactly.

The error is bounded by what has happened to a sketch. Compacting level h moves the rank of any value by -2**h, 0 or
2**h, with mean 0; ``spent`` adds up the squares, 4**h, of all compactions, also through merges. By the inequality of
Azuma and Hoeffding the rank of an answer is then off by at most sqrt(2 * spent * ln(2 * answers / delta)) for all of
``answers`` answers together, with a probability of 1 - delta (``rank_error``).

A state is a row of the group columns, n, spent, sizes (values per level) and items (the values, level by level, each
level sorted), so it can be written, read and merged like any other row. Coins come from a seeded generator per task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Values held at the top level.
K = 1024
#: Values of a partition that are held back before they are turned into states.
FLUSH_ROWS = 1 << 20

#: Partitions of rows from which their states are merged in two steps.
ONE_STEP = 256


@dataclass
class Sketch:
    """Levels of sorted values and what their compactions have spent."""

    levels: list[np.ndarray]
    spent: float = 0.0


def rank_error(spent: float, n: int, answers: int, delta: float = 0.01) -> float:
    """The share of n by which the rank of an answer is off at most, for ``answers`` answers together, at 1 - ``delta``."""
    return math.sqrt(2 * spent * math.log(2 * max(1, answers) / delta)) / max(1, n)


def capacity(k: int, level: int, levels: int) -> int:
    return max(8, math.ceil(k * (2 / 3) ** (levels - 1 - level)))


def compress(sketch: Sketch, k: int, rng: np.random.Generator) -> Sketch:
    """Compact the lowest level that holds too much until all levels together have room; levels stay sorted."""
    levels, spent = list(sketch.levels), sketch.spent
    while sum(map(len, levels)) > sum(capacity(k, h, len(levels)) for h in range(len(levels))):
        h = next(i for i, x in enumerate(levels) if len(x) > capacity(k, i, len(levels)))
        full = levels[h]
        kept, moved = full[: len(full) % 2], full[len(full) % 2 :]  # an odd value stays
        moved = moved[int(rng.integers(2)) :: 2]
        spent += 4.0**h
        if h + 1 == len(levels):
            levels.append(np.empty(0))
        levels[h] = kept
        levels[h + 1] = np.sort(np.concatenate([levels[h + 1], moved]), kind="stable")
    return Sketch(levels, spent)


def build(values: np.ndarray, k: int, rng: np.random.Generator) -> Sketch:
    return compress(Sketch([np.sort(values)]), k, rng)


def merge(parts: Sequence[Sketch], k: int, rng: np.random.Generator) -> Sketch:
    height = max(len(p.levels) for p in parts)
    joined = [np.sort(np.concatenate([p.levels[h] for p in parts if h < len(p.levels)])) for h in range(height)]
    return compress(Sketch(joined, sum(p.spent for p in parts)), k, rng)


def quantile(sketch: Sketch, n: int, p: float) -> float:
    """The value of rank ceil(p * n), the first for p = 0."""
    values = np.concatenate(sketch.levels)
    weights = np.repeat(2 ** np.arange(len(sketch.levels)), [len(x) for x in sketch.levels])
    order = np.argsort(values, kind="stable")
    at = np.searchsorted(np.cumsum(weights[order]), max(1, math.ceil(p * n)))
    return float(values[order][min(at, len(values) - 1)])


def _quantiles(batch: pa.RecordBatch, ps: Sequence[float]) -> np.ndarray:
    """``quantile`` of each state of a batch and each of ``ps``, all states at once."""
    sizes, n = batch.column("sizes"), batch.column("n").to_numpy()
    levels = np.diff(sizes.offsets.to_numpy())
    per_level = sizes.flatten().to_numpy()
    level = np.arange(len(per_level)) - np.repeat(np.cumsum(levels) - levels, levels)
    state_of_level = np.repeat(np.arange(len(n)), levels)
    state = np.repeat(state_of_level, per_level)
    weight, value = np.repeat(np.int64(1) << level, per_level), batch.column("items").flatten().to_numpy()
    order = np.lexsort((value, state))
    # Weights add up to n in each state, so ranks of one state follow those of the one before.
    upto = np.cumsum(weight[order])
    base = np.cumsum(n) - n
    targets = np.maximum(1, np.ceil(np.array(ps, float)[None, :] * n[:, None]).astype(np.int64)) + base[:, None]
    return value[order][np.searchsorted(upto, targets.ravel())].reshape(len(n), len(ps))


def _schema(df: DataFrame, by: Sequence[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([*(T.StructField(df.schema[c].name, df.schema[c].dataType, True) for c in by), *fields])


_STATE = (T.StructField("n", T.LongType()), T.StructField("spent", T.DoubleType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.DoubleType())))


def _list_array(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _state_batch(groups: list[pa.Array], sketches: list[Sketch], counts: Sequence[int], schema: pa.Schema) -> pa.RecordBatch:
    sizes = [len(x) for s in sketches for x in s.levels]
    items = np.concatenate([x for s in sketches for x in s.levels]) if sketches else np.empty(0)
    arrays = [
        *groups,
        pa.array(counts, pa.int64()),
        pa.array([s.spent for s in sketches], pa.float64()),
        _list_array(np.array([len(s.levels) for s in sketches], np.int64), np.array(sizes, np.int32), pa.int32()),
        _list_array(np.array([sum(map(len, s.levels)) for s in sketches], np.int64), items, pa.float64()),
    ]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)


def _group_codes(table: pa.Table, by: Sequence[str]) -> np.ndarray:
    """Equal numbers for rows of equal groups, NULL being a value."""
    code = np.zeros(table.num_rows, np.int64)
    for c in by:
        d = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    return code


def partial_states(df: DataFrame, by: Sequence[str], value: str, k: int = K, seed: int = 0, part: str | None = None, together: int = 1) -> DataFrame:
    """States of each input partition, without a shuffle; a partition may give several of a group.

    NULL and NaN values are left out, a group with no other values has no state. NULL is a group. Values are taken as
    doubles (integers are exact up to 2**53). ``part`` names a column for the number of the partition div ``together``.
    """
    schema = _schema(df, by, *([T.StructField(part, T.IntegerType())] if part else []), *_STATE)
    arrow_schema = to_arrow_schema(schema)
    keys = [f"_k{i}" for i in range(len(by))]

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rng = np.random.default_rng((seed, 0, pid))
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            code, x = _group_codes(table, keys), table.column("_v").to_numpy()
            order = np.lexsort((x, code))
            code, x = code[order], x[order]
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.append(starts[1:], len(x))
            sketches = [compress(Sketch([x[a:b]]), k, rng) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            groups = [table.column(c).combine_chunks().take(pa.array(order[starts])) for c in keys]
            if part:
                groups.append(pa.array(np.full(len(starts), pid // together)))
            return _state_batch(groups, sketches, ends - starts, arrow_schema)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= FLUSH_ROWS:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    v = F.col(value).cast("double")
    chosen = df.where(v.isNotNull() & ~F.isnan(v)).select(*[F.col(c).alias(a) for c, a in zip(by, keys, strict=True)], v.alias("_v"))
    return chosen.mapInArrow(states, schema)


def _split(batch: pa.RecordBatch) -> tuple[np.ndarray, list[Sketch]]:
    sizes, items = batch.column("sizes"), batch.column("items")
    per_state = np.diff(sizes.offsets.to_numpy())
    flat_sizes, flat = sizes.flatten().to_numpy(), items.flatten().to_numpy()
    cuts = np.concatenate([[0], np.cumsum(flat_sizes, dtype=np.int64)]).tolist()
    out, at = [], 0
    for m, spent in zip(per_state.tolist(), batch.column("spent").to_pylist(), strict=True):
        out.append(Sketch([flat[cuts[at + j] : cuts[at + j + 1]] for j in range(m)], spent))
        at += m
    return batch.column("n").to_numpy(), out


def _merge_round(states: DataFrame, by: Sequence[str], salt: Column, k: int, seed: int, round_no: int) -> DataFrame:
    """One merge by (``by``, ``salt``); each task streams over its states in a fixed order."""
    schema = _schema(states, by, *_STATE)
    arrow_schema = to_arrow_schema(schema)
    keys = [f"_k{i}" for i in range(len(by))]
    keyed = states.select(*[F.col(c).alias(a) for c, a in zip(by, keys, strict=True)], salt.cast("int").alias("_salt"), F.xxhash64("n", "items").alias("_order"), "n", "spent", "sizes", "items")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng((seed, round_no, TaskContext.get().partitionId()))
        open_key, parts, n = None, [], 0
        done_keys: list[tuple] = []
        done: list[Sketch] = []
        counts: list[int] = []

        def close() -> None:
            if parts:
                done_keys.append(open_key)
                done.append(merge(parts, k, rng) if len(parts) > 1 else parts[0])
                counts.append(n)

        def take() -> pa.RecordBatch:
            groups = [pa.array([key[i] for key in done_keys], arrow_schema.field(i).type) for i in range(len(keys))]
            return _state_batch(groups, done, counts, arrow_schema)

        for batch in batches:
            sizes, levels = _split(batch)
            names = list(zip(*(batch.column(c).to_pylist() for c in (*keys, "_salt")), strict=True))
            for key, size, sketch in zip(names, sizes.tolist(), levels, strict=True):
                if key != open_key or not parts:
                    close()
                    open_key, parts, n = key, [], 0
                parts.append(sketch)
                n += size
                if len(parts) == 32:  # what is open stays the size of a few sketches
                    parts = [merge(parts, k, rng)]
            if len(done) >= 4096:
                yield take()
                done_keys, done, counts = [], [], []
        close()
        if done:
            yield take()

    return keyed.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt", "_order").mapInArrow(merged, schema)


def merge_states(states: DataFrame, by: Sequence[str], k: int = K, seed: int = 0, salts: int = 64) -> DataFrame:
    """One state per group of ``by``, which may be coarser than the groups of ``states``.

    States of a group are first merged in ``salts`` parts, then these parts, so a group that has states in every
    partition is not the work of one task. ``salts`` = 1 merges in one step, for many small groups.
    """
    if salts > 1:
        spread = [f.name for f in states.schema.fields if f.name not in {*by, "n", "spent", "sizes", "items"}]
        states = _merge_round(states, by, F.pmod(F.xxhash64(*spread, "n", "items"), F.lit(salts)), k, seed, 1)
    return _merge_round(states, by, F.lit(0), k, seed, 2)


def states_of(df: DataFrame, by: Sequence[str], value: str, k: int = K, seed: int = 0) -> DataFrame:
    """One state per group of the rows of ``df``, merged as a tree over the input partitions.

    States of neighbouring partitions are merged first, so a group with rows in every partition is never the work of
    one task; up to ``ONE_STEP`` partitions are one such neighbourhood.
    """
    partitions = df._jdf.queryExecution().toRdd().getNumPartitions()
    together = partitions if partitions <= ONE_STEP else math.isqrt(partitions)
    part = "_part"
    while part in by:
        part += "_"
    states = _merge_round(partial_states(df, by, value, k, seed, part, max(1, together)), [*by, part], F.lit(0), k, seed, 1)
    return states.drop(part) if partitions <= ONE_STEP else _merge_round(states, by, F.lit(0), k, seed, 2)


def percentiles(states: DataFrame, by: Sequence[str], ps: Sequence[float], answers: int | None = None, delta: float = 0.01) -> DataFrame:
    """(``by``, percentile, estimate, n_values, rank_error) for each state and each of ``ps``.

    All of ``answers`` answers together (None: those of one state) are within their rank_error, a share of n_values, at
    1 - ``delta``.
    """
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles lie between 0 and 1")
    fields = ("percentile", T.DoubleType()), ("estimate", T.DoubleType()), ("n_values", T.LongType()), ("rank_error", T.DoubleType())
    schema = _schema(states, by, *(T.StructField(n, t) for n, t in fields))
    arrow_schema = to_arrow_schema(schema)
    width, together = len(by), answers or len(ps)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = batch.column("n").to_numpy()
            values = _quantiles(batch, ps).ravel()
            errors = np.array([rank_error(s, n, together, delta) for s, n in zip(batch.column("spent").to_pylist(), counts.tolist(), strict=True)])
            rows = pa.array(np.repeat(np.arange(batch.num_rows), len(ps)))
            arrays = [*(batch.column(i).take(rows) for i in range(width)), pa.array(np.tile(np.array(ps, float), batch.num_rows)), pa.array(values, pa.float64()), pa.array(np.repeat(counts, len(ps))), pa.array(np.repeat(errors, len(ps)))]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow_schema, strict=True)], schema=arrow_schema)

    return states.select(*by, "n", "spent", "sizes", "items").mapInArrow(found, schema)

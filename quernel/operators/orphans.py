"""References to records that do not exist, found with bitmaps.

Keys are encoded as integers by a dictionary; a key's high bits name its *range* of 32,768 keys, the low bits its
place in the range. References become one compressed block per (referring table, month, range), parents are marked per
month and range with the keys that the parent table holds on every day of the month. Reference AND-NOT parent leaves
the keys that may be missing on some day of the month; they are decoded, each with the days of that month on which its
parent is there. Rows are held against these days. A reference without a date belongs to a month of its own, in which
every key that the parent table ever held is present.

A block is the shortest of three containers: the sorted 16-bit places, the bits themselves, or the runs of bits.

Size: rows are reduced to distinct (table, month, key) in each input partition before anything is shuffled. A task of
the AND-NOT step holds one range: the blocks of one table and month after the other, of 4 KB at most, and the parents
of 32,768 keys. A key that holds a third of all rows is one bit a month. Rows themselves do not move: what survives is
written, measured, and sent to them if it is below ``BROADCAST_BYTES``; above that, both sides are joined with salted
keys.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.plans.scratch import materialize

#: Keys in a range: the places of a block fit 15 bits.
RANGE_BITS = 15
RANGE_KEYS = 1 << RANGE_BITS
#: The month of references without a date.
ANY_TIME = -1
#: Later than any month or day.
OPEN_END = 2**31 - 1
#: The most bytes of surviving keys that are sent to every task.
BROADCAST_BYTES = 32 << 20
#: Bytes of a surviving row besides its key, as a broadcast holds it.
_ROW_BYTES = 96
#: Parts of a key's rows where the surviving keys are too many to be sent.
SALTS = 16
#: Containers of a block.
PLACES, BITS, RUNS = 0, 1, 2


def _month(date) -> F.Column:
    return (F.year(date) * 12 + F.month(date) - 1).cast("int")


def compress(places: np.ndarray) -> tuple[int, bytes]:
    """(container, bytes) of sorted distinct places below RANGE_KEYS, the shortest of the three."""
    breaks = np.flatnonzero(np.diff(places) != 1)
    firsts, lasts = places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]]
    if 4 * len(firsts) <= min(2 * len(places), RANGE_KEYS // 8):
        return RUNS, np.column_stack([firsts, lasts]).astype("<u2").tobytes()
    if 2 * len(places) <= RANGE_KEYS // 8:
        return PLACES, places.astype("<u2").tobytes()
    return BITS, decompress_to_bits(PLACES, places.astype("<u2").tobytes()).tobytes()


def decompress_to_bits(container: int, block: bytes) -> np.ndarray:
    """The block as RANGE_KEYS / 8 bytes of bits."""
    if container == BITS:
        return np.frombuffer(block, np.uint8)
    at = np.frombuffer(block, "<u2").astype(np.int64)
    bits = np.zeros(RANGE_KEYS + 1, np.int8)
    if container == PLACES:
        bits[at] = 1
    else:
        np.add.at(bits, at[0::2], 1)
        np.add.at(bits, at[1::2] + 1, -1)
        bits = np.cumsum(bits, dtype=np.int8)
    return np.packbits(bits[:RANGE_KEYS].astype(bool), bitorder="little")


_BLOCK = "key_range long, ref string, month int, container byte, block binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block per (key_range, ref, month) of rows sorted by these and by bit; what is open is one block's places."""
    open_key: tuple | None = None
    held: list[np.ndarray] = []
    done: list[tuple] = []

    def close() -> None:
        if held:
            done.append((*open_key, *compress(np.concatenate(held))))

    def take() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int32(), pa.int8(), pa.binary())
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["key_range", "ref", "month", "container", "block"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bits = batch.column(3).to_numpy()
        codes = [batch.column(i).dictionary_encode().indices.to_numpy(zero_copy_only=False) for i in range(3)]
        change = np.zeros(batch.num_rows, bool)
        for code in codes:
            change[1:] |= code[1:] != code[:-1]
        starts = np.r_[0, np.flatnonzero(change)]
        names = batch.take(pa.array(starts))
        for a, b, key in zip(starts, np.r_[starts[1:], batch.num_rows], zip(*(names.column(i).to_pylist() for i in range(3)), strict=True), strict=True):
            if key != open_key:
                close()
                open_key, held = key, []
            held.append(bits[a:b])
        if len(done) >= 4096:
            yield take()
            done = []
    close()
    if done:
        yield take()


_SURVIVOR = "ref string, month int, id long, days long"


def _and_not(blocks: pa.Table, parents: pa.Table) -> pa.Table:
    """The surviving bits of one key range as rows (ref, month, id, days: bit d - 1 is set if the parent is there on day d)."""
    bits, first, last = (parents.column(c).to_numpy() for c in ("bit", "first_day", "last_day"))
    out: list[tuple[np.ndarray, np.ndarray, str, int]] = []
    by_month: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for ref, month, key_range, container, block in zip(*(blocks.column(c).to_pylist() for c in ("ref", "month", "key_range", "container", "block")), strict=True):
        if month not in by_month:
            by_month[month] = _presence(month, bits, first, last)
        full, days = by_month[month]
        left = np.flatnonzero(np.unpackbits(decompress_to_bits(container, block) & ~full, bitorder="little"))
        out.append((left + key_range * RANGE_KEYS, days[left], ref, month))
    counts = [len(ids) for ids, *_ in out]
    return pa.table(
        {
            "ref": pa.array(np.repeat(np.array([r for *_, r, _ in out], object), counts), pa.string()),
            "month": pa.array(np.repeat(np.array([m for *_, m in out], np.int32), counts), pa.int32()),
            "id": pa.array(np.concatenate([ids for ids, *_ in out]) if out else [], pa.int64()),
            "days": pa.array(np.concatenate([d for _, d, *_ in out]) if out else [], pa.int64()),
        }
    )


def _presence(month: int, bits: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of the keys that are there on all days of ``month``, the days of each key as bits). Days count from 1970."""
    days = np.zeros(RANGE_KEYS, np.int64)
    if month == ANY_TIME:
        days[bits] = 1
        whole = 1
    else:
        begin, end = (np.datetime64(f"{m // 12:04d}-{m % 12 + 1:02d}", "D").astype(np.int64) for m in (month, month + 1))
        length = int(end - begin)
        a, b = np.clip(first - begin, 0, length), np.clip(last - begin + 1, 0, length)
        there = a < b
        np.bitwise_or.at(days, bits[there], (np.int64(1) << b[there]) - (np.int64(1) << a[there]))
        whole = (1 << length) - 1
    return np.packbits(days == whole, bitorder="little"), days


def missing_keys(references: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref, month, key, days) of references whose key is not in ``parents`` on every day of the month.

    ``references`` has ref (name of the referring table), key and date, ``parents`` key, valid_from and valid_to (the
    first day it is not there any more, NULL if it still is; a NULL valid_from is on no day). NULL keys are no
    references. Keys compare exactly. Bit d - 1 of days is set if the key is there on day d of the month; days is 0 for
    references without a date. The result is a written table.
    """
    month = F.coalesce(_month(F.col("date")), F.lit(ANY_TIME))
    pairs = references.where(F.col("key").isNotNull()).groupBy("ref", month.alias("month"), "key").agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs.drop("n"), "references")
    # The ids are contiguous in each partition. They are written: a second evaluation could give others.
    dictionary = materialize(pairs.select("key").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary")
    coded = dictionary.select("key", F.shiftright("id", RANGE_BITS).alias("key_range"), F.col("id").bitwiseAND(RANGE_KEYS - 1).cast("int").alias("bit"))
    places = pairs.join(coded, "key").select("key_range", "ref", "month", "bit")
    blocks = places.repartition("key_range").sortWithinPartitions("key_range", "ref", "month", "bit").mapInArrow(_blocks, _BLOCK)
    day = lambda c, otherwise: F.coalesce(F.unix_date(c), F.lit(otherwise))
    held = parents.where(F.col("key").isNotNull()).join(coded, "key")
    # A parent without valid_from is on no day, but it was in the table.
    intervals = held.select(F.col("key_range").alias("parent_range"), "bit", day(F.col("valid_from"), OPEN_END).alias("first_day"), (day(F.col("valid_to"), OPEN_END) - 1).alias("last_day"))
    survivors = blocks.groupBy("key_range").cogroup(intervals.groupBy("parent_range")).applyInArrow(_and_not, _SURVIVOR)
    return materialize(survivors.join(dictionary, "id").select("ref", "month", "key", "days"), "survivors")


def orphan_rows(references: DataFrame, parents: DataFrame, distinct_by: Sequence[str] = ("ref", "row_id", "key", "date")) -> DataFrame:
    """Distinct ``distinct_by`` of references to a key that ``parents`` does not hold on their day.

    ``references`` also has row_id. Where the date is NULL, a key counts as missing if the parent table never held it.
    Empty references give no rows; an empty parent table makes every reference an orphan.
    """
    rows = references.select("ref", "row_id", "key", "date")
    suspects = missing_keys(rows, parents)
    n, key_bytes = suspects.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("ref")), F.lit(0))).first()
    suspects = suspects.select(F.col("ref").alias("_ref"), F.col("month").alias("_month"), F.col("key").alias("_key"), F.col("days").alias("_days"))
    month = F.coalesce(_month(rows["date"]), F.lit(ANY_TIME))
    same = (rows["ref"] == F.col("_ref")) & (rows["key"] == F.col("_key")) & (month == F.col("_month"))
    if n * _ROW_BYTES + key_bytes <= BROADCAST_BYTES:
        near = rows.join(F.broadcast(suspects), same)
    else:
        salted = suspects.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        near = rows.join(salted.hint("shuffle_merge"), same & (F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int") == F.col("_salt")))
    missing = near.where(F.expr("shiftright(_days, coalesce(dayofmonth(date), 1) - 1)").bitwiseAND(F.lit(1)) == 0)
    return missing.select(*distinct_by).distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref, month, n_rows, n_keys): orphan rows and distinct missing keys per table and month (first day; NULL: no date).

    Rows are counted per key first, so that a table and month with most of the rows is not one task's work.
    """
    by_key = orphans.groupBy("ref", F.trunc("date", "month").alias("month"), "key").agg(F.count(F.lit(1)).alias("_n"))
    return by_key.groupBy("ref", "month").agg(F.sum("_n").alias("n_rows"), F.count("key").alias("n_keys"))

"""Rows of delimited text, split from rows that fail to parse.

Every Arrow batch of lines is indexed as one byte buffer: masks of quotes and delimiters, and the parity of the number
of quotes since the start of the line, tell which delimiters separate fields and whether the quoting is right, for all
lines of the batch at once. Counts and types are checked on the resulting offsets; a line is a typed row or has the
first reason against it. One pass, no shuffle, no line is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

QUOTE, COMMA, BLANK = 0x22, 0x2C, 0x20
#: The bytes of U+FFFD.
_REPLACEMENT = b"\xef\xbf\xbd"


@dataclass(frozen=True)
class Field:
    """A field of the record. An empty field is NULL and valid, whatever the type.

    ``kind`` is "text" or "int". An int may have blanks (U+0020) at both ends, a sign and leading zeros, is made of
    ASCII digits and lies in [low, high], which is within 64 bits. With ``name_like`` a text has at least one letter, no
    control character (below U+0020, or U+007F) and no U+FFFD.
    """

    name: str
    kind: str = "text"
    low: int = -(2**63)
    high: int = 2**63 - 1
    name_like: bool = False


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """data[start:end] of each pair as a string array."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if offsets[-1] >= 2**31:
        raise ValueError("more than 2 GB of text in a batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def _any_between(places: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(places, ends) > np.searchsorted(places, starts)


def parse_batch(lines: pa.StringArray, fields: Sequence[Field], delimiter: int = COMMA) -> tuple[pa.StringArray, list[pa.Array]]:
    """(reason or NULL, values of each field; all NULL where there is a reason) of non-NULL lines."""
    n, k = len(lines), len(fields)
    joined = lines.cast(pa.large_string())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + n + 1]
    raw = joined.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and n else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    begin, end = offsets[:-1], offsets[1:]

    quotes = np.flatnonzero(data == QUOTE)
    delimiters = np.flatnonzero(data == delimiter)
    # Parity after each quote, counted from the start of its line.
    before_line = np.searchsorted(quotes, begin)
    quote_line = _line_index(quotes, begin, end)
    inside_after = (np.arange(len(quotes)) - before_line[quote_line] + 1) % 2 == 1
    # Parity at each delimiter: quotes before it in its line.
    delimiter_line = _line_index(delimiters, begin, end)
    inside = (np.searchsorted(quotes, delimiters) - before_line[delimiter_line]) % 2 == 1
    delimiters, delimiter_line = delimiters[~inside], delimiter_line[~inside]

    # An opening quote is the first character of its field or doubles the one before it; after a closing one comes a
    # quote, a delimiter or the end of the line; at the end of the line no quote is open.
    prev = data[np.maximum(quotes - 1, 0)]
    follows = (quotes == begin[quote_line]) | (prev == QUOTE) | (prev == delimiter)
    after = data[np.minimum(quotes + 1, max(len(data) - 1, 0))]
    closes = (quotes + 1 == end[quote_line]) | (after == QUOTE) | (after == delimiter)
    bad_quoting = np.zeros(n, bool)
    bad_quoting[quote_line[np.where(inside_after, ~follows, ~closes)]] = True
    bad_quoting |= (np.searchsorted(quotes, end) - before_line) % 2 == 1

    n_fields = np.bincount(delimiter_line, minlength=n) + 1
    bad_columns = ~bad_quoting & (n_fields != k)
    good = np.flatnonzero(~bad_quoting & ~bad_columns)

    # The k - 1 delimiters of each good line stand together.
    first = np.searchsorted(delimiters, begin[good])
    cuts = [begin[good] - 1, *(delimiters[first + j] for j in range(k - 1)), end[good]]
    bad_value = np.zeros(len(good), bool)
    values = []
    for j, field in enumerate(fields):
        starts, ends = cuts[j] + 1, cuts[j + 1]
        quoted = (ends > starts) & (data[np.minimum(starts, max(len(data) - 1, 0))] == QUOTE) if len(data) else np.zeros(len(good), bool)
        starts, ends = starts + quoted, ends - quoted
        text = _slices(data, starts, ends)
        if quoted.any():
            text = pc.replace_with_mask(text, pa.array(quoted), pc.replace_substring(text.filter(pa.array(quoted)), '""', '"'))
        if field.kind == "int":
            value, bad = _integers(text, field)
        else:
            value = pc.if_else(pc.equal(pc.binary_length(text), 0), pa.scalar(None, pa.string()), text)
            bad = _not_a_name(data, starts, ends, text) if field.name_like else np.zeros(len(good), bool)
        values.append(value)
        bad_value |= bad

    reason = np.full(n, None, object)
    reason[bad_quoting] = "quoting"
    reason[bad_columns] = "columns"
    reason[good[bad_value]] = "value"
    place = np.full(n, -1, np.int64)
    place[good[~bad_value]] = np.flatnonzero(~bad_value)
    take = pa.array(np.maximum(place, 0), mask=place < 0)
    return pa.array(reason, pa.string()), [v.take(take) for v in values]


def _line_index(places: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The line that holds each place; lines without bytes hold none."""
    return np.searchsorted(end, places, "right")


def _integers(text: pa.StringArray, field: Field) -> tuple[pa.Array, np.ndarray]:
    trimmed = pc.ascii_trim(text, " ")
    shaped = pc.match_substring_regex(trimmed, r"^[+-]?[0-9]+$")
    signed = pc.replace_substring_regex(trimmed, r"^(-?)\+?0*([0-9]+)$", r"\1\2")
    none = pa.scalar(None, pa.string())
    # 18 characters are always within 64 bits, 20 at most may be; more digits never are.
    length = pc.binary_length(signed)
    short = pc.and_(shaped, pc.less_equal(length, 18))
    number = pc.if_else(short, signed, none).cast(pa.int64())
    edge = pc.and_(shaped, pc.and_(pc.greater(length, 18), pc.less_equal(length, 20)))
    if pc.any(edge).as_py():
        wide = pc.if_else(edge, signed, none).cast(pa.decimal128(20, 0))
        low, high = (pa.scalar(Decimal(x), pa.decimal128(20, 0)) for x in (-(2**63), 2**63 - 1))
        held = pc.and_(pc.greater_equal(wide, low), pc.less_equal(wide, high))
        number = pc.coalesce(number, pc.if_else(held, wide, pa.scalar(None, wide.type)).cast(pa.int64()))
    fits = pc.fill_null(pc.and_(pc.greater_equal(number, max(field.low, -(2**63))), pc.less_equal(number, min(field.high, 2**63 - 1))), False)
    empty = pc.equal(pc.binary_length(trimmed), 0)
    bad = pc.invert(pc.or_(empty, fits)).to_numpy(zero_copy_only=False)
    return pc.if_else(fits, number, pa.scalar(None, pa.int64())), bad


def _not_a_name(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: pa.StringArray) -> np.ndarray:
    control = np.flatnonzero((data < 0x20) | (data == 0x7F))
    lower = data | 0x20
    ascii_letters = np.flatnonzero((lower >= 0x61) & (lower <= 0x7A))
    high = np.flatnonzero(data >= 0x80)
    has_letter = _any_between(ascii_letters, starts, ends)
    has_high = _any_between(high, starts, ends)
    unsure = np.flatnonzero(~has_letter & has_high)
    if len(unsure):
        has_letter[unsure] = pc.match_substring_regex(text.take(pa.array(unsure)), r"\p{L}").to_numpy(zero_copy_only=False)
    replaced = pc.match_substring(text, _REPLACEMENT.decode()).to_numpy(zero_copy_only=False)
    return (ends > starts) & (~has_letter | _any_between(control, starts, ends) | replaced)


def parse_lines(lines: DataFrame, fields: Sequence[Field], keep: Sequence[str] = ("line_id",), raw: str = "raw", line_no: str | None = "line_no") -> DataFrame:
    """Each record of ``lines`` as ``keep``, reason (NULL for a valid row) and the typed ``fields`` (NULL for a reject).

    Reasons, the first that holds: "quoting", "columns" (not exactly the fields), "value". Lines with ``line_no`` 1
    (the header; None: there is no header) and NULL or zero-length lines are no records. Lines are physical ones: a
    quoted field ends on its line. Only ``keep``, ``raw`` and ``line_no`` are read, so other columns may have any
    name; names in ``keep`` must differ from those of the fields and from "reason".
    """
    kept = [f for name in keep for f in lines.schema.fields if f.name == name]
    taken = {f.name for f in fields} | {"reason"}
    if len(kept) != len(keep) or taken & set(keep):
        raise ValueError(f"keep must name columns of the input other than {sorted(taken)}")
    types = {"text": T.StringType(), "int": T.LongType()}
    schema = T.StructType([*kept, T.StructField("reason", T.StringType()), *(T.StructField(f.name, types[f.kind]) for f in fields)])
    arrow_schema = to_arrow_schema(schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(len(kept))
            reason, values = parse_batch(text.cast(pa.string()), fields)
            arrays = [*batch.columns[: len(kept)], reason, *values]
            yield pa.RecordBatch.from_arrays([a.cast(t.type) for a, t in zip(arrays, arrow_schema, strict=True)], schema=arrow_schema)

    records = lines.where(F.length(raw) > 0)
    if line_no is not None:
        records = records.where(F.col(line_no).isNull() | (F.col(line_no) != 1))
    return records.select(*keep, F.col(raw).alias("_raw")).mapInArrow(rows, schema)

"""CSV files with a header, their column types inferred from all rows.

A column has the first type of INT, DECIMAL, DATE, BOOL, TEXT that fits every value; one without values is TEXT. An
empty field, quoted or not, is NULL. TEXT is kept as it is; other types tolerate white space around the value. The
types are found in one pass over the text, the typed table is a projection of it: nothing is collected but a row of
counters.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import CsvError

_INT = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,2})?\s*$"
_ISO_DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\s*$"
_US_DATE = r"^\s*[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*$"
_WIDEST = "decimal(38,18)"


def _as_int(c: Column) -> Column:
    return F.when(c.rlike(_INT), F.trim(c).try_cast("long"))


def _as_decimal(c: Column, kind: str) -> Column:
    return F.when(c.rlike(_DECIMAL), F.trim(c).try_cast(kind))


def _as_date(c: Column) -> Column:
    iso = F.regexp_extract(c, r"([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})", 1).try_cast("date")
    us = F.regexp_replace(F.trim(c), r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2").try_cast("date")
    return F.when(c.rlike(_ISO_DATE), iso).when(c.rlike(_US_DATE), us)


def _as_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "false"), t == "true")


def _digits(c: Column) -> tuple[Column, Column]:
    """Digits before and after the point of a decimal in plain notation."""
    plain = F.regexp_replace(F.trim(c), r"^[+-]?0*", "")
    return F.length(F.regexp_extract(plain, r"^([0-9]*)", 1)), F.length(F.regexp_extract(plain, r"\.([0-9]*)$", 1))


def _counters(name: str, i: int) -> list[Column]:
    c = F.nullif(F.col(f"`{name}`"), F.lit(""))
    fits = {"int": _as_int(c), "decimal": _as_decimal(c, _WIDEST), "date": _as_date(c), "bool": _as_bool(c)}
    whole, places = _digits(c)
    is_decimal = c.rlike(_DECIMAL)
    plain = is_decimal & ~c.rlike("[eE]")
    return [
        F.count(c).alias(f"n{i}"),
        *(F.count(v).alias(f"{k}{i}") for k, v in fits.items()),
        F.sum(F.when(is_decimal, 1).otherwise(0)).alias(f"numeric{i}"),
        F.max(F.when(plain, whole)).alias(f"whole{i}"),
        F.max(F.when(plain, places)).alias(f"places{i}"),
        F.sum(F.when(is_decimal & c.rlike("[eE]"), 1).otherwise(0)).alias(f"exp{i}"),
    ]


def _choose(counts: dict, i: int) -> str:
    n = counts[f"n{i}"]
    if n == 0:
        return "string"
    if counts[f"int{i}"] == n:
        return "bigint"
    if counts[f"numeric{i}"] == n:
        whole, places = counts[f"whole{i}"] or 0, counts[f"places{i}"] or 0
        if counts[f"exp{i}"] == 0 and whole + places <= 38:
            return f"decimal({max(whole + places, 1)},{places})"
        if counts[f"exp{i}"] and counts[f"decimal{i}"] == n:
            return _WIDEST
    if counts[f"date{i}"] == n:
        return "date"
    return "boolean" if counts[f"bool{i}"] == n else "string"


def _typed(name: str, kind: str) -> Column:
    c = F.nullif(F.col(f"`{name}`"), F.lit(""))
    if kind == "bigint":
        c = _as_int(c)
    elif kind.startswith("decimal"):
        c = _as_decimal(c, kind)
    elif kind == "date":
        c = _as_date(c)
    elif kind == "boolean":
        c = _as_bool(c)
    return c.alias(name)


def read_header(spark: SparkSession, path: str) -> list[str]:
    """Column names: the first line of the file (of the first file, for a folder)."""
    first = spark.read.option("header", False).option("escape", '"').csv(path).limit(1).collect()
    if not first:
        raise CsvError(f"{path} is empty")
    names = [("" if v is None else v).removeprefix("\ufeff") for v in first[0]]
    lowered = [n.lower() for n in names]
    if len(set(lowered)) != len(lowered):
        raise CsvError(f"{path} has two columns of one name")
    return names


def load_csv(spark: SparkSession, path: str, infer: bool = True) -> DataFrame:
    """The typed table of a CSV file or folder.

    Lines of length zero are skipped. A record is one physical line; inside a quoted field ``""`` is a quote. Surplus
    fields are ignored; a row with too few is an error when it is read. With ``infer`` False all columns are TEXT.
    """
    names = read_header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    broken = "__broken"
    while broken in names:
        broken += "_"
    lines = spark.read.schema(T.StructType([*schema.fields, T.StructField(broken, T.StringType())]))
    raw = lines.options(header=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=broken, enforceSchema=True).csv(path)
    # A row with too few fields lacks its last one though it is not empty there; surplus ones are only recorded.
    commas = F.regexp_count(F.regexp_replace(F.col(broken), F.lit('"(?:[^"]|"")*"'), F.lit("")), F.lit(","))
    short = F.col(broken).isNotNull() & (commas < len(names) - 1)
    checked = raw.select([F.when(short, F.raise_error(F.concat(F.lit(f"{path}: a row has fewer than {len(names)} fields: "), F.col(broken)))).otherwise(F.col(f"`{n}`")).alias(n) for n in names])
    if not infer:
        return checked.select([_typed(n, "string") for n in names])
    counts = checked.agg(*[c for i, n in enumerate(names) for c in _counters(n, i)]).first().asDict()
    kinds = [_choose(counts, i) for i in range(len(names))]
    return checked.select([_typed(n, k) for n, k in zip(names, kinds, strict=True)])


def table_name(path: str) -> str:
    """The file's name without its ending."""
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]

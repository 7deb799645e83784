"""The dialect's five types over Spark's, and the conversion of literals."""

from __future__ import annotations

import datetime
import re
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import TypeMismatch


class SqlType(Enum):
    INT = "INT"
    DECIMAL = "DECIMAL"
    TEXT = "TEXT"
    DATE = "DATE"
    BOOL = "BOOL"
    OTHER = "OTHER"

    @property
    def is_number(self) -> bool:
        return self in (SqlType.INT, SqlType.DECIMAL)


def sql_type(kind: T.DataType) -> SqlType:
    """OTHER: a nested or binary column, which can be projected only."""
    if isinstance(kind, T.IntegralType):
        return SqlType.INT
    if isinstance(kind, (T.DecimalType, T.FractionalType)):
        return SqlType.DECIMAL
    if isinstance(kind, T.StringType):
        return SqlType.TEXT
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return SqlType.DATE
    return SqlType.BOOL if isinstance(kind, T.BooleanType) else SqlType.OTHER


def literal_type(value: object) -> SqlType:
    for python, kind in ((bool, SqlType.BOOL), (int, SqlType.INT), (Decimal, SqlType.DECIMAL), (datetime.date, SqlType.DATE)):
        if isinstance(value, python):
            return kind
    return SqlType.TEXT


_ISO = re.compile(r"\s*([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?:[T ]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,6}))?)?)?\s*")
_US = re.compile(r"\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\s*")


def text_to_moment(text: str) -> datetime.datetime | None:
    """A date as yyyy-M-d, perhaps with a time, or M/d/yyyy; None for anything else."""
    if m := _ISO.fullmatch(text):
        y, mo, d, h, mi, s = (int(x or 0) for x in m.groups()[:6])
        micro = int((m[7] or "").ljust(6, "0") or 0)
    elif m := _US.fullmatch(text):
        (mo, d, y), h, mi, s, micro = map(int, m.groups()), 0, 0, 0, 0
    else:
        return None
    try:
        return datetime.datetime(y, mo, d, h, mi, s, micro)
    except ValueError:
        return None



def text_literal_as(text: str, kind: T.DataType) -> Column:
    """A TEXT literal as a value of the other side's type, or TypeMismatch. A DATE loses its time of day."""
    wanted = sql_type(kind)
    if wanted == SqlType.TEXT:
        return F.lit(text)
    if wanted == SqlType.INT and re.fullmatch(r"\s*[+-]?[0-9]+\s*", text) and -(2**63) <= int(text) < 2**63:
        return F.lit(int(text))
    if wanted.is_number and re.fullmatch(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]{1,2})?\s*", text, re.IGNORECASE):
        return F.lit(Decimal(format(Decimal(text.strip()), "f")))
    if wanted == SqlType.BOOL and text.strip().lower() in ("true", "false"):
        return F.lit(text.strip().lower() == "true")
    if wanted == SqlType.DATE and (moment := text_to_moment(text)) is not None:
        if isinstance(kind, T.DateType):
            return F.lit(moment.date())
        return F.lit(moment.isoformat(" ")).cast(kind)
    raise TypeMismatch(f"{text!r} is not a value of type {wanted.value}")

"""The five aggregates with the dialect's result types.

SUM and AVG are exact decimals, also over INT: SUM(INT) is DECIMAL(29,0), AVG(INT) DECIMAL(38,9). SUM and AVG of a
DECIMAL column keep at least its scale. A floating-point column, which the dialect itself does not have, is summed as
DECIMAL of ``double_scale`` places, each value rounded to them, where the table declares one, and else as it is (the
last digits then depend on the order of the rows). All ignore NULLs; SUM, AVG, MIN and MAX over no values are NULL,
COUNT is 0.

Sums run in 64-bit integers: a value, or the digits of a decimal, is cut into three parts of 21 bits, whose sums hold
2**42 rows of any values, and the decimal is put together once per group. Decimals of more than 18 digits are summed
as they are.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.errors import TypeMismatch
from quernel.functions.types import SqlType, sql_type

#: Bits of the two lower parts of a summed value.
_PART = 21
#: Most digits of a decimal that is held as a 64-bit integer.
_LONG_DIGITS = 18


def _of_digits(name: str, column: Column, *arguments: int) -> Column:
    """``UnscaledValue`` (the digits of a decimal as an integer) or ``MakeDecimal`` (its inverse) of Catalyst."""
    from pyspark.sql.classic.column import Column as ClassicColumn

    sql = SparkContext._active_spark_context._jvm.org.apache.spark.sql
    expressions = sql.classic.ExpressionUtils
    return ClassicColumn(expressions.column(getattr(sql.catalyst.expressions, name)(expressions.expression(column._jc), *arguments)))


def _exact_sum(value: Column, scale: int, result: T.DecimalType) -> Column:
    """The sum of 64-bit integers that stand for decimals of ``scale`` places."""
    low_bits = F.lit((1 << _PART) - 1).cast("long")
    parts = ((F.shiftright(value, 2 * _PART), 2 * _PART), (F.shiftright(value, _PART).bitwiseAND(low_bits), _PART), (value.bitwiseAND(low_bits), 0))
    total = None
    for part, shift in parts:
        term = _of_digits("MakeDecimal", F.sum(part), 19, scale) * F.lit(Decimal(1 << shift))
        total = term if total is None else total + term
    return total.cast(result)


def _sum(column: Column, kind: T.DataType, double_scale: int | None) -> Column:
    if isinstance(kind, T.IntegralType):
        return _exact_sum(column.cast("long"), 0, T.DecimalType(29, 0))
    if isinstance(kind, T.DecimalType) and kind.precision <= _LONG_DIGITS:
        return _exact_sum(_of_digits("UnscaledValue", column), kind.scale, T.DecimalType(kind.precision + 10, kind.scale))
    if isinstance(kind, (T.DoubleType, T.FloatType)) and double_scale is not None:
        digits = F.rint(column.cast("double") * F.lit(float(10**double_scale))).cast("long")
        return _exact_sum(digits, double_scale, T.DecimalType(28, double_scale))
    return F.sum(column)


def aggregate(function: str, column: Column | None, kind: T.DataType | None, double_scale: int | None = None) -> Column:
    """``column`` None counts rows."""
    if column is None:
        return F.count(F.lit(1))
    if function == "COUNT":
        return F.count(column)
    type_ = sql_type(kind)
    if function in ("MIN", "MAX"):
        if type_ == SqlType.OTHER:
            raise TypeMismatch(f"{function} needs a value that can be ordered")
        return F.min(column) if function == "MIN" else F.max(column)
    if not type_.is_number:
        raise TypeMismatch(f"{function} needs a number, not {type_.value}")
    total = _sum(column, kind, double_scale)
    # The quotient keeps more places than the built-in average of decimals.
    return total if function == "SUM" else total / F.when(F.count(column) > 0, F.count(column))


def result_type(function: str, kind: T.DataType | None) -> T.DataType:
    """The type of an aggregate's result as comparisons need it; decimals without their exact places."""
    if function == "COUNT" or kind is None:
        return T.LongType()
    return kind if function in ("MIN", "MAX") else T.DecimalType(38, 9)

"""Numeric helpers.

Rounding is specified as SQL rounding (half away from zero) on the decimal
value.  Doubles are first fixed to 9 decimals so that the order in which a
distributed sum was added up cannot flip a tie (x.xxx5) either way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column, digits: int) -> Column:
    return F.round(c.cast("decimal(38,9)"), digits).cast("double")


def safe_rate(num: Column, den: Column, digits: int = 4) -> Column:
    """``round(num / den, digits)``; 0.0 when the denominator is 0."""
    return F.coalesce(round_half_up(F.try_divide(num.cast("double"), den.cast("double")), digits), F.lit(0.0))


def sql_round(expr: str, digits: int) -> str:
    """The same rounding rule as SQL text, for oracle queries."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"

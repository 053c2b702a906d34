"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(expr: Column, body: Callable[[Column], Column]) -> Column:
    """``body(expr)`` with ``expr`` evaluated once per row, however often the
    body uses it (it is bound as a lambda variable)."""
    return F.get(F.transform(F.array(expr), body), F.lit(0))

"""Column-expression helpers for text that must behave like Python strings.

Spark/DuckDB ``trim`` removes only spaces; Python ``str.strip`` removes every
Unicode whitespace character, including the separators U+001C..U+001F.  Java
regexes need ``(?U)`` for Unicode ``\\s``/``\\w`` and ``(?d)`` so that ``.``
stops only at ``\\n`` as in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set as plain characters, generated from Python's own
# rule; the character-set ``trim`` is a simple scan, much cheaper than a regex.
PY_WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def col_or_null(df_columns, name: str | None) -> Column:
    """The named column when present, else a NULL literal (dynamic schemas)."""
    if name and name in df_columns:
        return F.col(name)
    return F.lit(None)


def py_strip(c: Column) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.trim(c, F.lit(PY_WS_CHARS))


def py_rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(PY_WS_CHARS))


def is_blank(c: Column) -> Column:
    """NULL, empty or whitespace-only (Python: ``not s or not s.strip()``)."""
    return py_strip(F.coalesce(c, F.lit(""))) == ""


def truthy_chain(*cols: Column) -> Column:
    """``a or b or c or ''``: empty strings and NULLs both fall through."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))

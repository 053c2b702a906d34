"""Python-regex rules evaluated by Spark's Java regex engine.

Rules are written for Python ``re.match``: anchored at the start, ``.``
stops only at ``\\n``, ``\\w``/``\\s``/``\\d`` are Unicode, IGNORECASE is
Unicode case folding.  ``java_match_pattern`` turns such a rule into an
equivalent Java pattern for ``rlike`` (which searches, hence ``^(?:…)``).

Rule lists are configuration (small and fixed per job); they are validated
once on the driver.  A rule that does not compile is skipped, as the
reference does.
"""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Python re.escape special characters (Python 3.7+), the fixed escape set.
_PY_ESCAPED = "()[]{}?*+-|^$\\.&~# \t\n\r\v\f"


def py_escape(c: Column) -> Column:
    """``re.escape`` of a column value, as a column expression."""
    cls = "".join("\\" + ch if ch in "[]\\^-" else ch for ch in _PY_ESCAPED)
    cls = cls.replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r").replace("\v", "\\x0B").replace(
        "\f", "\\f")
    # in a Java replacement string "\\" is one literal backslash
    return F.regexp_replace(c, f"([{cls}])", r"\\$1")


def _translate(p: str) -> str:
    p = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", p)
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return p.replace(r"\Z", r"\z")


def java_match_pattern(p: str, ignore_case: bool = False) -> str:
    flags = "dU" + ("iu" if ignore_case else "")
    return f"(?{flags})^(?:{_translate(p)})"


def _java_ok(pattern: str) -> bool:
    try:
        from pyspark import SparkContext

        sc = SparkContext._active_spark_context
        if sc is None:
            return True
        sc._jvm.java.util.regex.Pattern.compile(pattern)
        return True
    except Exception:  # noqa: BLE001
        return False


def valid_rules(patterns: list[str], ignore_case: bool = False) -> list[str]:
    """Rules that compile in Python and, translated, in Java (order kept)."""
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            log.warning("skipping invalid rule %r", p)
            continue
        if not _java_ok(java_match_pattern(p, ignore_case)):
            log.warning("skipping rule %r: not expressible as a Java regex", p)
            continue
        out.append(p)
    return out


def matches_any(value: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    """``any(re.match(p, value) for p in patterns)`` as one compiled regex.

    The valid rules are combined into one alternation literal, so the JVM
    compiles it once per task instead of once per row.  Rules with
    back-references keep their own ``rlike`` (numbering would shift).
    """
    rules = valid_rules(patterns, ignore_case)
    if not rules:
        return F.lit(False)
    plain = [p for p in rules if not re.search(r"\\[1-9]|\(\?P=", p)]
    special = [p for p in rules if p not in plain]
    conds = []
    if plain:
        combined = java_match_pattern("|".join(f"(?:{_translate(p)})" for p in plain), ignore_case)
        if _java_ok(combined):
            conds.append(value.rlike(combined))
        else:
            conds.extend(value.rlike(java_match_pattern(p, ignore_case)) for p in plain)
    conds.extend(value.rlike(java_match_pattern(p, ignore_case)) for p in special)
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))

"""Malformed-row counters exposed through ``DataFrame.observe``.

A job that tolerates bad input (an error column instead of a failed job)
can report how many rows were malformed without a second pass: the count is
collected by the same job that produces the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observe_malformed(df: DataFrame, malformed: Column, observation: Observation | None) -> DataFrame:
    """Attach ``rows`` / ``malformed`` counters to ``observation`` (if given).
    Read them with ``observation.get`` after an action on the result."""
    if observation is None:
        return df
    return df.observe(observation, F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.coalesce(malformed, F.lit(False))).alias("malformed"))

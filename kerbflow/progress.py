"""Callbacks on a running plan: metrics ride along with the rows and are handed over when the action that reads them ends, without a
job of their own."""

from __future__ import annotations

from collections.abc import Callable
from threading import Thread

from pyspark.sql import Column, DataFrame, Observation, functions as F


def watched(df: DataFrame, callback: Callable[[dict], None], **metrics: Column) -> DataFrame:
    """df, which must be used in place of the original; after its first action ``callback`` gets the metrics (rows by
    default) once, from a thread of its own. Metrics are aggregates over all rows that pass this point of the plan."""
    seen = Observation()
    out = df.observe(seen, *(c.alias(n) for n, c in (metrics or {"rows": F.count(F.lit(1))}).items()))
    Thread(target=lambda: callback(dict(seen.get)), daemon=True).start()
    return out

"""Streaming twins: overstays as a stream-stream interval join, counts per window with late data bounded by watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as S
from ..operators.spatial import near_cells, with_cells


def overstay_stream(first: DataFrame, second: DataFrame, gate: float = 2.5, min_gap: str = "20 minutes", max_gap: str = "4 hours", reach_m: float = 25.0, late: str = "10 minutes") -> DataFrame:
    """Pairs within the gate of equal look, min_gap to max_gap apart, as both passes arrive.

    reach_m bounds gate times the larger sigma of the second side. Watermarks and the gap bound the state of either side. Mutual nearest choice needs a closed log: run ``match`` over
    the pairs that this appends.
    """
    a = with_cells(first.withWatermark("time", late), reach_m).select("_row", "_col", "cls", "color", *(F.col(c).alias(f"a_{c}") for c in ("id", "lat", "lon", "heading", "sa", "sc", "time")))
    b = near_cells(second.withWatermark("time", late), reach_m).select("_row", "_col", "cls", "color", *(F.col(c).alias(f"b_{c}") for c in ("id", "lat", "lon", "heading", "sa", "sc", "time")))
    gap = F.expr(f"b_time between a_time + interval {min_gap} and a_time + interval {max_gap}")
    joined = a.join(b, (a._row == b._row) & (a._col == b._col) & (a.cls == b.cls) & (a.color == b.color) & gap)
    dot = lambda text: text.replace("a.", "a_").replace("b.", "b_")
    cost = f"greatest({dot(S.mahalanobis('a', 'b.lat', 'b.lon'))}, {dot(S.mahalanobis('b', 'a.lat', 'a.lon'))})"
    return joined.withColumn("cost", F.expr(cost)).where(F.col("cost") <= gate).select("a_id", "b_id", "cost", "a_time", "b_time")


def presence_counts(log: DataFrame, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sightings per window, colour and class."""
    return log.withWatermark("time", late).groupBy(F.window("time", window), "color", "cls").agg(F.count("*").alias("n"))

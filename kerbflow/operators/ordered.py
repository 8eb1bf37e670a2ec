"""Ordered operators: moving sums, prefix sums, gap filling, arc length, islands, as-of and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def moving_average(value: str, key: str, order: str, taps: int) -> Column:
    """Centred window divided by its full width even at the ends, as a zero-padded convolution."""
    half = taps // 2
    return F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-half, half)) / F.lit(float(taps))


def prefix(value: str, key: str, order: str, inclusive: bool = False) -> Column:
    """Running sum before each row (or up to it)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def fill(value: str, key: str, order: str) -> Column:
    """Nulls interpolated over the row order, held at the ends; 0 where a series has no value at all."""
    # a frame that ends at the last row is worked out anew for each row, so looking ahead is looking back in the opposite sort
    back = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).alias("y")))
    a, b = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
    lerp = a["y"] + (b["y"] - a["y"]) * (F.col(order) - a["x"]) / F.nullif(b["x"] - a["x"], F.lit(0.0))
    return F.coalesce(F.col(value), lerp, a["y"], b["y"], F.lit(0.0))


def bracket(track: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Track points with their successor: half-open intervals [order, order_2)."""
    w = Window.partitionBy(key).orderBy(order)
    return track.withColumns({f"{c}_2": F.lead(c).over(w) for c in [order, *fields]})


def asof(queries: DataFrame, track: DataFrame, key: str, at: str, order: str, fields: list[str]) -> DataFrame:
    """Each query row with the track interval it falls in; before the first and after the last, that end's interval.

    Union and one sort per key, no range join: track rows carry their interval, queries take the last one before them
    or, before the first, the first one.
    """
    w = Window.partitionBy(key).orderBy(order)
    spans = track.withColumns({f"{c}_2": F.lead(c).over(w) for c in [order, *fields]} | {f"{c}_0": F.lag(c).over(w) for c in [order, *fields]})
    last = F.col(f"{order}_2").isNull() & F.col(f"{order}_0").isNotNull()  # the end point continues the last interval
    seg = F.struct(*[F.when(last, F.col(f"{c}_0")).otherwise(F.col(c)).alias(c) for c in [order, *fields]], *[F.when(last, F.col(c)).otherwise(F.col(f"{c}_2")).alias(f"{c}_2") for c in [order, *fields]])
    marks = spans.select(key, F.col(order).cast("double").alias("_at"), F.lit(0).alias("_kind"), seg.alias("_seg"), *[F.lit(None).cast(t).alias(c) for c, t in queries.dtypes if c != key])
    asks = queries.select(key, F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(marks.schema["_seg"].dataType).alias("_seg"), *[c for c in queries.columns if c != key])
    all_rows = marks.unionByName(asks)
    order_w = Window.partitionBy(key).orderBy("_at", "_kind")
    # before the first point its interval holds: the last one of the opposite sort
    ahead = Window.partitionBy(key).orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = F.coalesce(F.last("_seg", ignorenulls=True).over(order_w.rowsBetween(Window.unboundedPreceding, 0)), F.last("_seg", ignorenulls=True).over(ahead))
    return all_rows.withColumn("_found", found).where("_kind = 1").select(*queries.columns, "_found.*")


def islands(series: DataFrame, key: str, order: str, hot: Column) -> DataFrame:
    """Rows where ``hot`` holds, with ``island``: equal for adjacent ones."""
    w = Window.partitionBy(key).orderBy(order)
    marked = series.withColumn("_new", (hot & ~F.coalesce(F.lag(hot).over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w))
    return marked.where(hot).drop("_new")


def nearest_on_line(points: DataFrame, others: DataFrame, keys: list[str], at: str, other_at: str, other_id: str, fields: list[str]) -> DataFrame:
    """points with ``other``, a struct (other_at, other_id, fields) of the nearest of ``others`` with the same keys, the smaller
    id of equals; null where a key has none or the point no position.

    One union and one shuffle by key: a point's neighbour to the left is the last one before it in a sort, that to the right
    the last one before it in the opposite sort, so no pair of points is ever made. Null keys are equal. Others
    without a position are left out.
    """
    mark = F.struct(F.col(other_at).cast("double").alias("at"), F.col(other_id).alias("id"), F.struct(other_at, other_id, *fields).alias("other"))
    marks = others.where(F.col(other_at).isNotNull()).select(*keys, F.col(other_at).cast("double").alias("_at"), mark.alias("_mark"))
    rows = points.select(*keys, F.col(at).cast("double").alias("_at"), F.struct("*").alias("_row"))
    both = marks.unionByName(rows, allowMissingColumns=True)
    near = [F.last("_mark", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(side, F.col("_row").isNotNull(), F.desc("_mark.id")).rowsBetween(Window.unboundedPreceding, 0)) for side in (F.asc("_at"), F.desc("_at"))]
    both = both.withColumns({"_left": near[0], "_right": near[1]}).where("_row is not null")
    gap = lambda side: F.struct(F.abs(F.col(f"{side}.at") - F.col("_at")), F.col(f"{side}.id"))
    left = F.col("_right").isNull() | (F.col("_left").isNotNull() & (gap("_left") <= gap("_right")))
    return both.select("_row.*", F.when(F.col("_at").isNotNull(), F.when(left, F.col("_left.other")).otherwise(F.col("_right.other"))).alias("other"))


def outside_intervals(rows: DataFrame, at: str, intervals: DataFrame, cell: float, keys: list[str] | None = None) -> DataFrame:
    """Rows whose ``at`` lies in none of intervals(keys, lo, hi), both ends included: an anti join without a range join.

    Rows and interval starts meet in one sort per key and cell of the axis, where the running maximum of the ends decides; the
    maximum that earlier cells leave is found over one row a cell (without keys, in one task). Work is spread by (key, cell), so an axis without
    keys needs no single task, and a long interval costs one row. Rows without a position, or with a null key, stay;
    empty intervals (hi < lo) and intervals without an end cover nothing.
    """
    keys = keys or []
    spot = F.floor(F.col("_at") / F.lit(float(cell)))
    marks = intervals.where("lo <= hi").select(*keys, F.col("lo").cast("double").alias("_at"), F.col("hi").cast("double").alias("_hi"))
    asked = rows.select(*keys, F.col(at).cast("double").alias("_at"), F.struct("*").alias("_row"))
    known = F.col("_at").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    marks, free, asked = marks.where(known), asked.where(~known), asked.where(known)
    cells = marks.groupBy(*keys, spot.alias("_cell")).agg(F.max("_hi").alias("_reach"))
    # cells that hold rows learn how far the intervals of earlier cells reach
    used = asked.select(*keys, spot.alias("_cell")).distinct().withColumn("_reach", F.lit(None).cast("double"))
    line = Window.partitionBy(*keys).orderBy("_cell") if keys else Window.partitionBy(F.lit(0)).orderBy("_cell")
    carried = cells.unionByName(used).groupBy(*keys, "_cell").agg(F.max("_reach").alias("_reach"))
    carried = carried.withColumn("_before", F.max("_reach").over(line.rowsBetween(Window.unboundedPreceding, -1))).where("_before is not null")
    start = carried.select(*keys, "_cell", F.lit(None).cast("double").alias("_at"), F.col("_before").alias("_hi"))  # sorts first
    both = marks.withColumn("_cell", spot).unionByName(start).unionByName(asked.withColumn("_cell", spot), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_cell").orderBy("_at", F.col("_row").isNotNull())
    reach = F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = both.withColumn("_reach", reach).where("_row is not null and (_reach is null or _reach < _at)").select("_row.*")
    return kept.unionByName(free.select("_row.*"))

"""Robust estimators as grouped SQL rounds: aggregate, join the statistic back on the group key, re-aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def triangulate(views: DataFrame, keys: list[str], lateral_m: float = 7.0, floor_deg: float = 30.0) -> DataFrame:
    """Along-street position from bearings: (keys, s, sigma, n_dets) of tracks that have views past the floor and stand.

    Each view implies s_cam + lateral / tan|bearing|, weighted by sin^4. A track of three views or more over 10 m whose
    implied position climbs by over 0.75 per metre is moving and dropped. Two rounds keep views within three scaled
    median deviations; sigma is the weighted spread over the root of the effective count, held to 1.5 to 10.
    """
    b = F.radians(F.abs("bearing"))
    sin = F.sin(b)
    d = views.where(F.abs("bearing") >= floor_deg).select(*keys, "s_cam", (F.col("s_cam") + lateral_m / F.tan(b)).alias("p"), (sin * sin * sin * sin).alias("w"))
    g = Window.partitionBy(*keys)
    d = d.withColumns({"n": F.count("*").over(g), "ext": F.max("s_cam").over(g) - F.min("s_cam").over(g), "slope": F.regr_slope("p", "s_cam").over(g)})
    d = d.where("n < 3 or ext <= 10 or coalesce(abs(slope), 0) <= 0.75").withColumn("keep", F.lit(True))
    d = d.withColumn("mu", F.sum(F.col("w") * F.col("p")).over(g) / F.sum("w").over(g))
    for _ in range(2):
        d = d.withColumn("res", F.abs(F.col("p") - F.col("mu")))
        d = d.withColumn("keep", F.col("res") < 3 * (1.4826 * F.median("res").over(g) + 1e-6))
        kept = F.sum(F.when(F.col("keep"), F.col("w"))).over(g)
        d = d.withColumn("mu", F.coalesce(F.sum(F.when(F.col("keep"), F.col("w") * F.col("p"))).over(g) / kept, F.col("mu")))
    k = d.where("keep").groupBy(*keys).agg(
        F.first("mu").alias("s"), F.count("*").alias("n_dets"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"),
        F.sum(F.col("w") * (F.col("p") - F.col("mu")) * (F.col("p") - F.col("mu"))).alias("sv"))
    spread = F.when(F.col("n_dets") > 1, F.sqrt(F.col("sv") / F.col("sw"))).otherwise(3.0)
    sigma = F.least(F.greatest(spread / F.sqrt(F.greatest(F.col("sw") * F.col("sw") / F.col("sww"), F.lit(1.0))), F.lit(1.5)), F.lit(10.0))
    return k.select(*keys, "s", sigma.alias("sigma"), "n_dets")


def ground_fit(points: DataFrame, key: str, least: int = 12, rounds: int = 3) -> DataFrame:
    """dy = c x, x the squared row below the horizon: (key, c, n_inlier), by median start and rounds of deviation gates.

    points(key, x, dy) past the horizon filter. Groups of fewer than ``least`` points give a null slope and 0; a round
    that keeps fewer leaves the slope as it was and ends the group's rounds, with its count reported.
    """
    g = Window.partitionBy(key)
    d = points.withColumns({"n": F.count("*").over(g), "c": F.median(F.col("dy") / F.col("x")).over(g)})
    d = d.withColumns({"going": F.col("n") >= least, "inl": F.col("n")})
    for _ in range(rounds):
        d = d.withColumn("res", F.col("dy") - F.col("c") * F.col("x"))
        d = d.withColumn("dev", F.abs(F.col("res") - F.median("res").over(g)))
        d = d.withColumn("ok", F.abs("res") < 2.5 * (1.4826 * F.median("dev").over(g) + 1e-9))
        d = d.withColumn("inl", F.when(F.col("going"), F.sum(F.col("ok").cast("long")).over(g)).otherwise(F.col("inl")))
        d = d.withColumn("going", F.col("going") & (F.col("inl") >= least))
        fit = F.sum(F.when(F.col("ok"), F.col("dy") * F.col("x"))).over(g) / F.sum(F.when(F.col("ok"), F.col("x") * F.col("x"))).over(g)
        d = d.withColumn("c", F.when(F.col("going"), fit).otherwise(F.col("c")))
    return d.groupBy(key).agg(F.first(F.when(F.col("n") >= least, F.col("c"))).alias("c"), F.first(F.when(F.col("n") >= least, F.col("inl")).otherwise(0)).alias("n_inlier"))

"""Places of cars beside a camera's trajectory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalar as S
from . import ordered

SPOT = "(lat + (lat_2 - lat) * (q - t) / nullif(t_2 - t, 0))", "(lon + (lon_2 - lon) * (q - t) / nullif(t_2 - t, 0))"


def position_at(asked: DataFrame, track: DataFrame, key: str, at: str) -> DataFrame:
    """asked with at_lat, at_lon and heading of track(key, t, lat, lon) at the time in column ``at``.

    Positions are linear in time within and beyond the track's ends; a track of one point, or none, places nothing.
    """
    found = ordered.asof(asked.withColumn("q", F.col(at).cast("double")), track.select(key, "t", "lat", "lon"), key, "q", "t", ["lat", "lon"]).where("t_2 is not null")
    return found.select(*asked.columns, F.expr(SPOT[0]).alias("at_lat"), F.expr(SPOT[1]).alias("at_lon"), F.expr(S.heading("lat", "lon", "lat_2", "lon_2")).alias("heading"))


def beside(lat: Column, lon: Column, heading: Column, left_m: Column) -> tuple[Column, Column]:
    """Latitude and longitude left_m to the left of a course; to the right where it is negative."""
    unit = F.lit(6378137.0) * F.pi() / 180
    turn = F.radians(heading)
    return lat + left_m * F.sin(turn) / unit, lon - left_m * F.cos(turn) / (unit * F.cos(F.radians(lat)))


def geolocate(cars: DataFrame, track: DataFrame, key: str = "segment", lateral_m: float = 7.0, sigma_cross_m: float = 1.8, epoch: str | None = None, mirrored: bool = False) -> DataFrame:
    """Cars of track_parked with lat, lon, heading and, with an epoch, the wall-clock time of their most abeam view.

    Left cars lie to the left of the course; mirrored=True puts them to the right. Cars without a track are left out.
    """
    at = position_at(cars, track, key, "abeam_t")
    off = F.when((F.col("side") == "left") != F.lit(mirrored), F.lit(lateral_m)).otherwise(F.lit(-lateral_m))
    lat, lon = beside(F.col("at_lat"), F.col("at_lon"), F.col("heading"), off)
    out = at.withColumns({"lat": lat, "lon": lon, "sigma_cross_m": F.lit(sigma_cross_m)})
    if epoch is not None:
        out = out.withColumn("timestamp", F.timestamp_micros((F.unix_micros(F.to_timestamp(F.lit(epoch))) + F.round(F.col("abeam_t") * 1e6)).cast("long")))
    return out.drop("at_lat", "at_lon")


def arc_lengths(track: DataFrame, key: str) -> DataFrame:
    """track(key, t, lat, lon) with ``arc``, the metres travelled up to each point."""
    w = Window.partitionBy(key).orderBy("t")
    step = track.withColumns({"_lat": F.lag("lat").over(w), "_lon": F.lag("lon").over(w)}).withColumn("_d", F.expr(S.metres("_lat", "_lon", "lat", "lon")))
    return step.withColumn("arc", F.coalesce(F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))).drop("_lat", "_lon", "_d")


def position_at_arc(asked: DataFrame, track: DataFrame, key: str, arc: str, left_m: float = 0.0) -> DataFrame:
    """asked with at_lat, at_lon and heading at the metres of travel in column ``arc``, left_m to the left of the course."""
    along = arc_lengths(track, key).select(key, F.col("arc").alias("t"), "lat", "lon")
    at = position_at(asked, along, key, arc)
    lat, lon = beside(F.col("at_lat"), F.col("at_lon"), F.col("heading"), F.lit(left_m))
    return at.withColumns({"at_lat": lat, "at_lon": lon})


def gps_track(fixes: DataFrame, key: str, time: str = "time") -> DataFrame:
    """fixes(key, time as timestamp, lat, lon) as track(key, t, lat, lon, epoch): seconds since the key's first fix."""
    first = fixes.groupBy(key).agg(F.min(time).alias("epoch"))
    seconds = (F.unix_micros(time) - F.unix_micros("epoch")) / F.lit(1e6)
    return fixes.join(first, key).select(key, seconds.alias("t"), "lat", "lon", "epoch")


#: Radius of the frame that block faces are measured in, metres lost at each corner, shortest face.
EARTH_M, CORNER_M, SHORTEST_M = 6378137.0, 7.6, 20.0


def junctions(vertices: DataFrame) -> DataFrame:
    """Nodes of several ways, or of several places of one, and the ends of every way."""
    ends = F.sum(F.when(F.col("idx").isin(0) | (F.col("idx") == F.col("last_idx")), 1).otherwise(0))
    return vertices.groupBy("node").agg((F.count("*") + ends).alias("n")).where("n > 1").select("node")


def block_faces(vertices: DataFrame, lane_offset_m: float = 4.6, lane_width_m: float = 2.6) -> DataFrame:
    """Both sides of every block: ways that may have kerbside parking, cut at junctions, of 20 m and more.

    vertices(way, idx, last_idx, node, lat, lon, street, highway, lanes) -> (way, piece, side, street, from_node, to_node, len_m,
    length_m, spaces, centre, ring). A face is a rectangle as long as the block's line, around the middle of its chord, lane_offset_m beside it;
    ring is closed. Blocks that end where they begin have no chord and no face. One window per way, no pairs of ways.
    """
    ok = vertices.where(S.plausible("highway", "lanes"))
    w = Window.partitionBy("way").orderBy("idx")
    scale = F.cos(F.radians(F.col("lat0"))) * EARTH_M
    e = ok.join(junctions(ok).withColumn("_j", F.lit(1)), "node", "left").withColumn("lat0", F.first("lat").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumns({"_x": F.radians("lon") * scale, "_y": F.radians("lat") * EARTH_M})
    e = e.withColumns({"_x2": F.lead("_x").over(w), "_y2": F.lead("_y").over(w), "_node2": F.lead("node").over(w), "piece": F.sum(F.coalesce("_j", F.lit(0))).over(w)})
    e = e.where("_x2 is not null").withColumn("_d", F.sqrt((F.col("_x2") - F.col("_x")) ** 2 + (F.col("_y2") - F.col("_y")) ** 2))
    f = e.groupBy("way", "piece").agg(
        F.first("street").alias("street"), F.first("lat0").alias("lat0"), F.sum("_d").alias("len_m"), F.min_by("node", "idx").alias("from_node"), F.max_by("_node2", "idx").alias("to_node"),
        *(F.min_by(c, "idx").alias(f"a{c}") for c in ("_x", "_y")), *(F.max_by(f"{c}2", "idx").alias(f"b{c}") for c in ("_x", "_y")))
    f = f.withColumns({"_dx": F.col("b_x") - F.col("a_x"), "_dy": F.col("b_y") - F.col("a_y")}).withColumn("_norm", F.sqrt(F.col("_dx") ** 2 + F.col("_dy") ** 2))
    f = f.where((F.col("len_m") >= SHORTEST_M) & (F.col("_norm") >= 1e-6)).withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    ux, uy = F.col("_dx") / F.col("_norm"), F.col("_dy") / F.col("_norm")
    off = F.when(F.col("side") == "left", lane_offset_m).otherwise(-lane_offset_m)
    cx, cy = (F.col("a_x") + F.col("b_x")) / 2 - uy * off, (F.col("a_y") + F.col("b_y")) / 2 + ux * off

    def spot(along: int, across: int) -> Column:
        x = cx + ux * (F.col("len_m") / 2 * along) - uy * (lane_width_m / 2 * across)
        y = cy + uy * (F.col("len_m") / 2 * along) + ux * (lane_width_m / 2 * across)
        return F.struct(F.degrees(x / scale).alias("lon"), F.degrees(y / EARTH_M).alias("lat"))

    ring = F.array(*(spot(*c) for c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))
    usable = f"greatest(len_m - {2 * CORNER_M}, 0e0)"
    return f.select("way", "piece", "side", "street", "from_node", "to_node", "len_m", F.round("len_m", 1).alias("length_m"), F.expr(S.spaces(usable)).alias("spaces"), spot(0, 0).alias("centre"), ring.alias("ring"))

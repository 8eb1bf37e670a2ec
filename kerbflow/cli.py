"""Command line over the operators: python -m kerbflow.cli {count,zone,survey,confidence} --help."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, Window, functions as F


def zone_out(anchors, a) -> None:
    """Extent of each zone, its character by the streets beside it, its anchors as KML."""
    from .operators import spatial
    from .sources import documents, sinks
    from .sources.files import read_streets

    spatial.zone_extents(anchors.withColumn("zone", F.col("signage_code")), "zone", "zone_type").orderBy("zone").show(50, False)
    if a.streets:
        w = Window.partitionBy("way").orderBy("idx")
        v = read_streets(anchors.sparkSession, a.streets).withColumns({"blat": F.lead("lat").over(w), "blon": F.lead("lon").over(w)}).where("blat is not null")
        near = spatial.nearest_segment(anchors.withColumn("anchor", F.concat_ws("#", "signage_code", "point_index")), v.withColumnRenamed("lat", "alat").withColumnRenamed("lon", "alon"), "anchor")
        home = F.avg((F.coalesce("highway", F.lit("")) == "residential").cast("int"))
        near.groupBy(F.substring_index("anchor", "#", 1).alias("zone")).agg(F.round(home, 3).alias("residential"), (home >= 0.55).alias("likely_permit")).orderBy("zone").show(50, False)
    if a.kml:
        name = F.concat(F.coalesce("signage_code", F.lit("")), F.lit(" #"), F.col("point_index"))
        documents.write_kml(anchors, sinks.point_placemark(name, F.col("lon"), F.col("lat")), ["signage_code", "point_index"], a.kml, "zone anchors")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="kerbflow")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("count", "parked cars of a detections table"), ("confidence", "count by minimum of detections"), ("survey", "hot kerb segments of a samples table"), ("zone", "anchors of zone files")):
        s = sub.add_parser(name, help=text)
        s.add_argument("input")
        s.add_argument("--out")
        s.add_argument("--min-frames", type=int, default=3)
        s.add_argument("--code", help="zone: signage code to show")
        s.add_argument("--streets", help="zone: street-network files, for the share of each street class near its anchors")
        s.add_argument("--kml", help="zone: one KML document of the anchors")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from .operators import ordered, tracking
    from .sources.files import read_zones

    if a.command == "count":
        out = tracking.track_parked(spark.read.parquet(a.input), min_frames=a.min_frames).orderBy("segment", "side", "along_m")
    elif a.command == "confidence":
        out = tracking.bootstrap_interval(spark.read.parquet(a.input), (2, 3, 4, 5, 6)).orderBy("min_frames")
    elif a.command == "survey":
        near = spark.read.parquet(a.input).withColumn("near", ordered.moving_average("kerb", "vid", "sample", 3))
        runs = ordered.islands(near, "vid", "sample", F.col("near") >= 3).groupBy("vid", "island")
        out = runs.agg(F.min("sample").alias("first"), F.max("sample").alias("last"), F.avg("kerb").alias("mean")).orderBy("vid", "first")
    else:
        out = read_zones(spark, a.input)
        if a.code:
            out = out.where(F.col("signage_code") == a.code)
        zone_out(out, a)
    if a.out:
        out.write.mode("overwrite").option("header", True).csv(a.out)
    else:
        out.show(50, False)


if __name__ == "__main__":
    main()

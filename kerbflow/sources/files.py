"""Readers with explicit schemas, never inferred: zones, street networks, detection dumps, tracks, frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ZONES = """array<struct<id: string, signageCode: string, internalZoneCode: string, supplierId: string, name: string, type: string,
 isZoneRestricted: boolean, geometry: array<struct<latitude: double, longitude: double>>>>"""
STREETS = "elements array<struct<type: string, id: long, nodes: array<long>, geometry: array<struct<lat: double, lon: double>>, tags: map<string, string>>>"


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zone files to anchors, one row a point; missing points, and points at the null island, are left out."""
    text = spark.read.text(path, wholetext=True)
    z = text.select(F.explode(F.from_json("value", ZONES)).alias("z")).select("z.*")
    p = z.select(F.coalesce("signageCode", "id").alias("signage_code"), "internalZoneCode", "supplierId", "name", F.col("type").alias("zone_type"), F.coalesce("isZoneRestricted", F.lit(False)).alias("restricted"), F.posexplode("geometry").alias("point_index", "g"))
    p = p.select(*[c for c in p.columns if c != "g"], F.col("g.longitude").alias("lon"), F.col("g.latitude").alias("lat"))
    return p.where("lat is not null and lon is not null and (abs(lat) > 1e-6 or abs(lon) > 1e-6)")


def read_streets(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """Street-network files to vertices: (way, idx, last_idx, node, lat, lon, street, highway, lanes)."""
    w = spark.read.schema(STREETS).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*").where("type = 'way' or type is null")
    if name:
        w = w.where(F.col("tags")["name"] == name)
    v = w.select(F.col("id").alias("way"), "nodes", "tags", (F.size("geometry") - 1).alias("last_idx"), F.posexplode("geometry").alias("idx", "g"))
    return v.select("way", "idx", "last_idx", F.get("nodes", F.col("idx")).alias("node"), "g.lat", "g.lon", F.coalesce(F.col("tags")["name"], F.concat(F.lit("way/"), F.col("way"))).alias("street"), F.col("tags")["highway"].alias("highway"), F.col("tags")["lanes"].alias("lanes"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Track, sighting and car lists with a header."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames extracted beforehand, as (path, content): the input of a detector."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def detect(frames: DataFrame, detector, schema: str) -> DataFrame:
    """Runs a user's detector: a factory called once a worker, giving a function from (path, content) to rows."""

    def run(batches):
        import pandas as pd

        find = detector()
        for b in batches:
            rows = [r for path, content in zip(b["path"], b["content"]) for r in find(path, content)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return frames.mapInPandas(run, schema)


#: Side of a detector tile in pixels, share that tiles overlap, least score, least side of a box, most overlap.
TILE, OVERLAP, LEAST_SCORE, LEAST_SIDE, MOST_IOU = 320, 0.25, 0.30, 2, 0.55


def tile_starts(size: int, tile: int = TILE, overlap: float = OVERLAP) -> list[int]:
    """Where tiles begin along a side: at even steps, and one flush with the far end if these leave a rest."""
    step = max(1, int(tile * (1 - overlap)))
    starts = list(range(0, max(size - tile, 0) + 1, step))
    return starts if starts[-1] + tile >= size else [*starts, size - tile]


def tile_boxes(frames: DataFrame, detector, tile: int = TILE, overlap: float = OVERLAP) -> DataFrame:
    """(image, ord, x1, y1, x2, y2, score, class_id) of all that a detector finds in overlapping tiles of frames(frame as long, width,
    height, content), raw RGB rows, in pixels of the whole frame.

    ``detector`` is a factory called once a worker; it gives a function from an array (height, width, 3) to rows
    (x1, y1, x2, y2, class_id, score). ord numbers the finds of a frame. A tile is no larger than the frame's shorter side.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        find = detector()
        for b in batches:
            rows = []
            for frame, width, height, content in zip(b["frame"], b["width"], b["height"], b["content"]):
                pixels = np.frombuffer(content, np.uint8).reshape(height, width, 3)
                side, n = min(tile, width, height), 0
                for y in tile_starts(height, side, overlap):
                    for x in tile_starts(width, side, overlap):
                        for x1, y1, x2, y2, kind, score in find(pixels[y : y + side, x : x + side]):
                            rows.append((frame, n, float(x1 + x), float(y1 + y), float(x2 + x), float(y2 + y), float(score), int(kind)))
                            n += 1
            yield pd.DataFrame(rows, columns=["image", "ord", "x1", "y1", "x2", "y2", "score", "class_id"])

    return frames.select("frame", "width", "height", "content").mapInPandas(run, "image long, ord long, x1 double, y1 double, x2 double, y2 double, score double, class_id int")


def vehicles(boxes: DataFrame, least_score: float = LEAST_SCORE, most_iou: float = MOST_IOU) -> DataFrame:
    """The vehicles of tile_boxes, each once, with ``cls``: other classes, low scores and boxes of under two pixels go, and of those that
    overlapping tiles show several times the surest stays."""
    from ..functions import scalar as S
    from ..operators.tracking import box_nms

    named = boxes.withColumn("cls", F.expr(S.lookup("class_id", S.VEHICLES)))
    some = named.where(F.col("cls").isNotNull() & (F.col("score") >= least_score) & (F.col("x2") - F.col("x1") >= LEAST_SIDE) & (F.col("y2") - F.col("y1") >= LEAST_SIDE))
    return box_nms(some, most_iou)


def labels(boxes: DataFrame) -> DataFrame:
    """(label, n) of every class a detector found, vehicle or not: the first thing to look at when it finds none."""
    from ..functions import scalar as S

    return boxes.groupBy(F.coalesce(F.expr(S.lookup("class_id", S.VEHICLES)), F.concat(F.lit("id"), F.col("class_id"))).alias("label")).agg(F.count("*").alias("n"))


def straight_track(spark: SparkSession, lat: float, lon: float, heading: float, speed: float, seconds: float) -> DataFrame:
    """Constant-velocity trajectory as its two end points."""
    return spark.sql(f"select t, {lat} + t * {speed} * cos(radians({heading})) / (6378137e0 * pi() / 180) lat, {lon} + t * {speed} * sin(radians({heading})) / (6378137e0 * pi() / 180 * cos(radians({lat}))) lon from values (0e0), ({float(seconds)}e0) as v(t)")

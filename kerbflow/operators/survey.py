"""Overhead survey: work cells over zone boxes, detections of a user's detector on each cell's mosaic, a place and a verdict for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as S
from . import spatial

#: Half a cell in degrees of longitude, the share of it in latitude, zoom, pixels of a tile, most tiles of a mosaic.
PAD, PAD_LAT, ZOOM, TILE_PX, MOST_TILES = 0.0004, 0.8, 20, 256, 400


def tiles_of(west: str, south: str, east: str, north: str, zoom: int) -> dict[str, Column]:
    """Columns x0, y0, x1, y1, the whole tiles over an extent, and west, north, east, south, the extent they really cover. A plan that
    meets an extent of over MOST_TILES tiles fails: the zoom is too high for it."""
    edge = lambda text: F.floor(F.expr(text)).cast("long")
    x0, y0, x1, y1 = edge(S.tile_x(west, zoom)), edge(S.tile_y(north, zoom)), edge(S.tile_x(east, zoom)), edge(S.tile_y(south, zoom))
    n = (x1 - x0 + 1) * (y1 - y0 + 1)
    wide = F.raise_error(F.concat(n.cast("string"), F.lit(f" tiles requested, {MOST_TILES} is the most; lower the zoom or shrink the extent")))
    return {"x0": F.when(n <= MOST_TILES, x0).otherwise(wide.cast("long")), "y0": y0, "x1": x1, "y1": y1}


def work_cells(boxes: DataFrame, pad: float = PAD, zoom: int = ZOOM) -> DataFrame:
    """(cell_x, cell_y, lon, lat, x0, y0, x1, y1, width, height, west, north, east, south): each cell that holds the centre of a box of
    spatial.box_rings, once, around the centre of its first box by (way, idx, side).

    Cells are truncated towards zero. x0 to y1 are the tiles of the cell's mosaic, width and height its pixels, the rest
    the extent of the whole tiles, a little more than was asked for.
    """
    mean = lambda axis: F.aggregate(F.slice("ring", 1, 4), F.lit(0.0), lambda s, p: s + p[axis]) / 4
    c = boxes.select("way", "idx", "side", mean("lon").alias("lon"), mean("lat").alias("lat"))
    cell = lambda axis: (F.col(axis) / F.lit(pad)).cast("long")
    first = F.min(F.struct("way", "idx", "side", "lon", "lat")).alias("f")
    c = c.groupBy(cell("lon").alias("cell_x"), cell("lat").alias("cell_y")).agg(first).select("cell_x", "cell_y", "f.lon", "f.lat")
    c = c.select("*", *(v.alias(k) for k, v in tiles_of(f"(lon - {pad}e0)", f"(lat - {pad * PAD_LAT}e0)", f"(lon + {pad}e0)", f"(lat + {pad * PAD_LAT}e0)", zoom).items()))
    size = lambda a, b: ((F.col(b) - F.col(a) + 1) * TILE_PX).alias
    actual = {"west": S.tile_lon("x0", zoom), "north": S.tile_lat("y0", zoom), "east": S.tile_lon("(x1 + 1)", zoom), "south": S.tile_lat("(y1 + 1)", zoom)}
    return c.select("*", size("x0", "x1")("width"), size("y0", "y1")("height"), *(F.expr(v).alias(k) for k, v in actual.items()))


def located(detections: DataFrame, cells: DataFrame, zoom: int = ZOOM) -> DataFrame:
    """detections(cell_x, cell_y, px, py, ...) with lat and lon, by tile coordinates: tiles are even in Mercator northing, not in latitude."""
    both = detections.join(cells.select("cell_x", "cell_y", "x0", "y0"), ["cell_x", "cell_y"])
    lon = F.expr(S.tile_lon(f"(x0 + px / {TILE_PX}e0)", zoom))
    return both.withColumns({"lon": lon, "lat": F.expr(S.tile_lat(f"(y0 + py / {TILE_PX}e0)", zoom))}).drop("x0", "y0")


def survey(boxes: DataFrame, detections: DataFrame, key: str, sigma_m: float = 1.0, pad: float = PAD, zoom: int = ZOOM) -> DataFrame:
    """Every detection (cell_x, cell_y, px, py, key, ...) on the mosaics of work_cells, placed and judged against all boxes: the detection's
    columns, lat, lon, verdict, margin, zone and box. ``boxes`` come from spatial.box_rings."""
    seen = located(detections, work_cells(boxes, pad, zoom), zoom)
    return seen.join(spatial.judge(seen.select(key, "lat", "lon"), boxes, key, sigma_m), key)

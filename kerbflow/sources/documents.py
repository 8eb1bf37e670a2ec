"""Whole documents from distributed rows: every section is sorted and written by all tasks as text parts, and the document is
their concatenation with the text before, between and after them.

Parts are joined by streaming them through one file handle (no part is ever held in memory); ``parts_only`` leaves the folder
as it is, and its parts in order of name are then the sections' lines.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scratch import Workspace
from . import sinks


class Section(NamedTuple):
    """Text before, lines(value) in the order of ``order``, text between two lines, text after. No lines: text alone."""

    head: str
    lines: DataFrame | None = None
    order: tuple = ()
    between: str = ""
    foot: str = ""


def _copy(spark: SparkSession, folder: str, out, skip: int) -> None:
    """All parts of a folder to an open stream; the first ``skip`` bytes are left out."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in sorted((s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName()):
        source = fs.open(part)
        try:
            source.seek(skip)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
        finally:
            source.close()
        skip = 0


def write_document(spark: SparkSession, path: str, sections: list[Section]) -> str:
    """One file at ``path``, in any store Spark can write to; it appears under its name only when it is complete."""
    work = Workspace(spark, "document")
    for k, s in enumerate(sections):
        if s.lines is not None:
            # every line brings the text between it and the one before; the very first one's is passed over when parts are joined
            lines = s.lines.orderBy(*s.order) if s.order else s.lines
            lines.select(F.concat(F.lit(s.between), F.col("value"))).write.option("compression", "none").text(f"{work.path}/{k:04d}")
    jvm = spark.sparkContext._jvm
    target, draft = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.part")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(draft, True)
    try:
        for k, s in enumerate(sections):
            out.write(bytearray(s.head.encode()))
            if s.lines is not None:
                _copy(spark, f"{work.path}/{k:04d}", out, len(s.between.encode()))
            out.write(bytearray(s.foot.encode()))
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{draft} could not be renamed to {target}")
    work.drop()
    return path


# --- GeoJSON
def write_geojson(features: DataFrame, line: Column, order: list[str], path: str) -> str:
    """A FeatureCollection; ``line`` gives each row's feature (sinks.point_feature, sinks.polygon_feature)."""
    return write_document(features.sparkSession, path, [Section('{"type":"FeatureCollection","features":[\n', features.select(line.alias("value"), *order), tuple(order), ",", "]}\n")])


def write_json(rows: DataFrame, order: list[str], path: str) -> str:
    """All rows as one JSON array of objects, nulls included; times in ISO form."""
    value = F.to_json(F.struct("*"), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"})
    return write_document(rows.sparkSession, path, [Section("[\n", rows.select(value.alias("value"), *order), tuple(order), ",", "]\n")])


# --- CSV
def csv_line(*columns: Column) -> Column:
    """One CSV record: fields with a comma, a quote or a line break are quoted, quotes doubled, nulls empty."""
    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(field, columns))


def write_csv(rows: DataFrame, columns: dict[str, Column], order: list[str], path: str) -> str:
    head = ",".join(columns) + "\n"
    return write_document(rows.sparkSession, path, [Section(head, rows.select(csv_line(*columns.values()).alias("value"), *order), tuple(order))])


def write_polygons_csv(features: DataFrame, name: Column, ring: Column, properties: dict[str, Column], order: list[str], path: str) -> str:
    """Named latitude and longitude (mean of the first four corners), WKT, then the properties."""
    mean = lambda axis: F.format_string("%.7f", F.aggregate(F.slice(ring, 1, 4), F.lit(0.0), lambda s, p: s + p[axis]) / 4)
    return write_csv(features, {"name": name, "latitude": mean("lat"), "longitude": mean("lon"), "wkt": sinks.polygon_wkt(ring), **properties}, order, path)


# --- KML
def kml_head(name: str) -> str:
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n<name>{sinks.escaped(name)}</name>\n'


KML_FOOT = "</Document>\n</kml>\n"


def polygon_style(name: str, rgb: str) -> str:
    """A shared style: opaque outline of width 2, translucent filling."""
    return f'<Style id="{name}"><LineStyle><color>{sinks.abgr(rgb, "ff")}</color><width>2</width></LineStyle><PolyStyle><color>{sinks.abgr(rgb, "66")}</color></PolyStyle></Style>\n'


def write_kml(features: DataFrame, line: Column, order: list[str], path: str, name: str = "kerbflow", styles: str = "") -> str:
    """A document of placemarks; ``line`` gives each row's (sinks.polygon_placemark, sinks.point_placemark)."""
    return write_document(features.sparkSession, path, [Section(kml_head(name) + styles, features.select(line.alias("value"), *order), tuple(order), "", KML_FOOT)])


def write_boxes(boxes: DataFrame, stem: str, name: str = "parking lanes", colour: str = "#4ec9b0") -> dict[str, str]:
    """Zone boxes (spatial.box_rings) as KML, CSV and GeoJSON beside each other; order is by street segment and side. Boxes are
    worked out once, not for every sort and document."""
    work = Workspace(boxes.sparkSession, "boxes")
    boxes = work.table(boxes, "boxes")
    order = ["way", "idx", "side"]
    title = F.concat_ws("", F.lit("zone "), "zone", F.lit(" · "), "street", F.lit(" ("), "side", F.lit(")"))
    shown = {"zone": F.col("zone"), "street": F.col("street"), "side": F.col("side"), "length_m": F.round("len_m", 1), "est_spaces": F.col("spaces"), "ambiguous_band_m": F.round(F.col("width_m") / 2, 2)}
    tagged = {"box_id": F.concat_ws(":", "way", "idx", "side"), **{k: v for k, v in shown.items() if k != "ambiguous_band_m"}, "width_m": F.col("width_m"), "ambiguous_band_m": shown["ambiguous_band_m"]}
    out = {
        "kml": write_kml(boxes, sinks.polygon_placemark(title, F.col("ring"), shown, "box"), order, f"{stem}.kml", name, polygon_style("box", colour)),
        "csv": write_polygons_csv(boxes, title, F.col("ring"), shown, order, f"{stem}.csv"),
        "geojson": write_geojson(boxes, sinks.polygon_feature(F.col("ring"), **tagged), order, f"{stem}.geojson"),
    }
    work.drop()
    return out


def write_faces(faces: DataFrame, geojson: str, csv: str) -> None:
    """Block faces (place.face_rings) as a FeatureCollection and as CSV."""
    order = ["way", "piece", "side"]
    lat, lon, usable = F.round("centre.lat", 7), F.round("centre.lon", 7), F.round(F.greatest(F.col("length_m") - 15.2, F.lit(0.0)), 1)
    face = F.concat_ws(":", "way", "from_node", "to_node", "side")
    write_geojson(faces, sinks.polygon_feature(F.col("ring"), face_id=face, street=F.col("street"), side=F.col("side"), length_m=F.col("length_m"), usable_m=usable, est_spaces=F.col("spaces"), lat=lat, lon=lon, zone=F.lit("")), order, geojson)
    write_csv(faces, {"face_id": face, "street": F.col("street"), "side": F.col("side"), "lat": lat, "lon": lon, "length_m": F.col("length_m"), "usable_m": usable, "est_spaces": F.col("spaces"), "zone": F.lit("")}, order, csv)


def write_overlay(cars: DataFrame, track: DataFrame, anchors: DataFrame, path: str, name: str, swatch: dict[str, str]) -> str:
    """Three folders: cars(id, t, lat, lon, color, cls, n_dets, n_tracklets, sa, sc) in their colours, the track(t, lat, lon)
    as one line, a coordinate a row, and anchors(label, lat, lon)."""
    icon = lambda i, c, scale, shape: f'<Style id="{i}"><IconStyle><color>{c}</color><scale>{scale}</scale><Icon><href>http://maps.google.com/mapfiles/kml/shapes/{shape}.png</href></Icon></IconStyle></Style>\n'
    styles = "".join(icon(f"c_{k}", sinks.abgr(v, "ff"), 1.1, "placemark_circle") for k, v in swatch.items()) + icon("anchor", "ff66d1ff", 1.4, "star")
    styles += '<Style id="trk"><LineStyle><color>ffffd166</color><width>3</width></LineStyle></Style>\n'
    folder = lambda title: f"<Folder><name>{sinks.escaped(title)}</name>\n"
    facts = {"id": F.col("id"), "class": F.col("cls"), "colour": F.col("color"), "tracked across": F.concat_ws(" ", "n_dets", F.lit("frames")), "tracklets": F.concat_ws("", "n_tracklets", F.when(F.col("n_tracklets") > 1, " (occlusion-split)")), "along-track sigma": F.concat_ws(" ", "sa", F.lit("m")), "cross-track sigma": F.concat_ws(" ", "sc", F.lit("m"))}
    car = sinks.point_placemark(F.concat_ws(" ", "id", F.lit("·"), "color", "cls"), F.col("lon"), F.col("lat"), facts, F.concat(F.lit("c_"), F.col("color")))
    return write_document(cars.sparkSession, path, [
        Section(kml_head(name) + styles + folder(f"Parked cars ({cars.count()})"), cars.select(car.alias("value"), "t", "id"), ("t", "id"), "", "</Folder>\n"),
        Section(folder("Camera track") + "<Placemark><name>track</name><styleUrl>#trk</styleUrl><LineString><tessellate>1</tessellate><coordinates>\n", track.select(sinks.coordinate(F.col("lon"), F.col("lat")).alias("value"), "t"), ("t",), "", "</coordinates></LineString></Placemark></Folder>\n"),
        Section(folder("Anchors"), anchors.select(sinks.point_placemark(F.col("label"), F.col("lon"), F.col("lat"), {}, F.lit("anchor")).alias("value"), "label"), ("label",), "", "</Folder>\n" + KML_FOOT),
    ])


def write_sightings_csv(log: DataFrame, path: str, order: list[str] | None = None) -> str:
    """A sighting log by time: ISO times, coordinates at 7 places, a zone that is missing or empty as UNKNOWN."""
    time = lambda c: F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    show = {c: time(c) if kind.startswith("timestamp") else F.format_string("%.7f", c) if c in ("lat", "lon") else F.coalesce(F.nullif(c, F.lit("")), F.lit("UNKNOWN")) if c == "zone" else F.col(c) for c, kind in log.dtypes}
    return write_csv(log, show, order or ["ts", *(c for c in ("id", "sighting_id") if c in log.columns)], path)

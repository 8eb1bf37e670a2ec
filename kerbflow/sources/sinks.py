"""Text forms of features as columns: GeoJSON, KML placemarks and WKT, and writers of sighting logs. One row is one line, so
writing is parallel; ``documents`` makes whole files of them."""

from __future__ import annotations

from xml.sax.saxutils import escape as escaped

from pyspark.sql import Column, DataFrame, functions as F


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def abgr(rgb: str, alpha: str = "80") -> str:
    """#RRGGBB to aabbggrr."""
    r, g, b = (rgb.lstrip("#")[k : k + 2] for k in (0, 2, 4))
    return f"{alpha}{b}{g}{r}".lower()


def kml_colour(rgb: Column, alpha: str = "ff") -> Column:
    """#RRGGBB to aabbggrr."""
    return F.concat(F.lit(alpha), F.substring(rgb, 6, 2), F.substring(rgb, 4, 2), F.substring(rgb, 2, 2))


def _feature(kind: str, coordinates: Column, properties: dict[str, Column]) -> Column:
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties")), {"ignoreNullFields": "false"})


def point_feature(lon: Column, lat: Column, **properties: Column) -> Column:
    return _feature("Point", F.array(lon, lat), properties)


def polygon_feature(ring: Column, **properties: Column) -> Column:
    """ring: array of (lon, lat) structs, closed."""
    return _feature("Polygon", F.array(F.transform(ring, lambda p: F.array(p.lon, p.lat))), properties)


def wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p.lon, p.lat)), ", "), F.lit("))"))


def polygon_wkt(ring: Column) -> Column:
    """The form of the CSV export: seven places, whatever the numbers."""
    return F.concat(F.lit("POLYGON(("), F.array_join(F.transform(ring, lambda p: F.format_string("%.7f %.7f", p.lon, p.lat)), ", "), F.lit("))"))


def coordinate(lon: Column, lat: Column) -> Column:
    return F.format_string("%.7f,%.7f,0", lon, lat)


def _placemark(name: Column, properties: dict[str, Column], style: str | Column | None, shape: Column) -> Column:
    shown = [F.concat(F.lit(f"<b>{escaped(k)}</b>: "), escape(F.coalesce(v.cast("string"), F.lit("")))) for k, v in properties.items()]
    description = F.concat(F.lit("<description><![CDATA["), F.concat_ws("<br/>", *shown), F.lit("]]></description>")) if shown else F.lit("")
    url = F.lit("") if style is None else F.concat(F.lit("<styleUrl>#"), F.lit(style) if isinstance(style, str) else style, F.lit("</styleUrl>"))
    return F.concat(F.lit("<Placemark><name>"), escape(F.coalesce(name.cast("string"), F.lit(""))), F.lit("</name>"), description, url, shape, F.lit("</Placemark>"))


def polygon_placemark(name: Column, ring: Column, properties: dict[str, Column] | None = None, style: str | Column | None = None) -> Column:
    path = F.array_join(F.transform(ring, lambda p: coordinate(p.lon, p.lat)), " ")
    return _placemark(name, properties or {}, style, F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), path, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>")))


def placemark(name: Column, ring: Column, colour: Column) -> Column:
    """A polygon that carries its own filling instead of a shared style."""
    path = F.array_join(F.transform(ring, lambda p: F.concat_ws(",", p.lon, p.lat, F.lit("0"))), " ")
    style = F.concat(F.lit("<Style><PolyStyle><color>"), kml_colour(colour), F.lit("</color></PolyStyle></Style>"))
    return _placemark(name, {}, None, F.concat(style, F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), path, F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>")))


def point_placemark(name: Column, lon: Column, lat: Column, properties: dict[str, Column] | None = None, style: str | Column | None = None) -> Column:
    return _placemark(name, properties or {}, style, F.concat(F.lit("<Point><coordinates>"), coordinate(lon, lat), F.lit("</coordinates></Point>")))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_log_csv(log: DataFrame, path: str) -> None:
    """Sighting log by time: coordinates at 7 places, null zones as UNKNOWN."""
    out = log.withColumns({"lat": F.format_string("%.7f", "lat"), "lon": F.format_string("%.7f", "lon")})
    if "zone" in log.columns:
        out = out.withColumn("zone", F.coalesce("zone", F.lit("UNKNOWN")))
    out.orderBy("ts").write.mode("overwrite").option("header", True).csv(path)


def write_log_json(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)

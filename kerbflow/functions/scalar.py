"""Scalar definitions, as expressions that both Spark and ANSI engines read. Powers are products, so that engines agree."""

from __future__ import annotations

EARTH = "6378137e0"


def bearing(cx: str, width: float = 1920, focal: float = 687) -> str:
    """Degrees off the optical axis of image column cx."""
    return f"degrees(atan(({cx} - {width / 2}e0) / {focal}e0))"


#: Hue, saturation and value thresholds; fixed values.
def colour(r: str, g: str, b: str) -> str:
    """Name of a body colour: neutrals by brightness below a saturation of 0.33, else by hue."""
    v, m = f"(greatest({r}, {g}, {b}) / 255e0)", f"(least({r}, {g}, {b}) / 255e0)"
    s = f"(case when {v} = 0 then 0e0 else ({v} - {m}) / {v} end)"
    d = f"nullif({v} - {m}, 0)"
    R, G, B = (f"({c} / 255e0)" for c in (r, g, b))
    hue = f"(case when {v} = {m} then 0e0 when {R} = {v} then (({G} - {B}) / {d} * 60 + 360) % 360 when {G} = {v} then ({B} - {R}) / {d} * 60 + 120 else ({R} - {G}) / {d} * 60 + 240 end)"
    return (
        f"case when {s} < 0.33e0 then (case when {v} < 0.25e0 then 'black' when {v} < 0.52e0 then 'grey' when {v} < 0.75e0 then 'silver' else 'white' end) "
        f"when {hue} < 15 or {hue} >= 345 then 'red' when {hue} < 45 then (case when {v} < 0.6e0 then 'tan' else 'orange' end) "
        f"when {hue} < 65 then 'tan' when {hue} < 170 then 'green' when {hue} < 260 then 'blue' else 'purple' end"
    )


#: The eight reference body colours, the display swatches and the detector's vehicle ids.
PALETTE = {"black": (25, 25, 28), "white": (232, 232, 232), "silver": (170, 172, 175), "grey": (110, 112, 115), "red": (150, 40, 40), "blue": (45, 65, 130), "green": (45, 95, 60), "tan": (170, 150, 115)}
SWATCH = {"black": "#3a3a40", "grey": "#8b8f98", "silver": "#c3c6cc", "white": "#eef0f2", "red": "#e8574d", "orange": "#e08a3c", "tan": "#cbb083", "green": "#54c47d", "blue": "#5f84e0", "purple": "#a87ad8"}
VEHICLES = {3: "car", 4: "motorcycle", 6: "bus", 8: "truck"}


def palette(r: str, g: str, b: str) -> str:
    """Nearest reference colour; the first of equals."""
    d = {n: f"(({r} - {p}) * ({r} - {p}) + ({g} - {q}) * ({g} - {q}) + ({b} - {z}) * ({b} - {z}))" for n, (p, q, z) in PALETTE.items()}
    least = f"least({', '.join(d.values())})"
    return "case " + " ".join(f"when {x} = {least} then '{n}'" for n, x in d.items()) + " end"


def lookup(key: str, table: dict, other: str = "null") -> str:
    quote = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return f"case {key} " + " ".join(f"when {quote(k)} then '{v}'" for k, v in table.items()) + f" else {other} end"


def iou(a: str, b: str) -> str:
    """Intersection over union of boxes a and b (columns x1, y1, x2, y2 of two relations)."""
    w = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0e0)"
    h = f"greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0e0)"
    area = lambda k: f"({k}.x2 - {k}.x1) * ({k}.y2 - {k}.y1)"
    return f"{w} * {h} / greatest({area(a)} + {area(b)} - {w} * {h}, 0.000000001e0)"


def heading(alat: str, alon: str, blat: str, blon: str) -> str:
    """Compass course from a to b, 0 to 360."""
    deg = f"degrees(atan2(({blon} - {alon}) * cos(radians(({alat} + {blat}) / 2)), {blat} - {alat}))"
    return f"(({deg} + 360e0) % 360)"


def along(s: str, lat: str, lon: str) -> str:
    """Metres ahead of sighting s, in its own heading; latitude scale of the sighting."""
    n, e = f"(({lat} - {s}.lat) * 110540e0)", f"(({lon} - {s}.lon) * 111320e0 * cos(radians({s}.lat)))"
    return f"({n} * cos(radians({s}.heading)) + {e} * sin(radians({s}.heading)))"


def across(s: str, lat: str, lon: str) -> str:
    n, e = f"(({lat} - {s}.lat) * 110540e0)", f"(({lon} - {s}.lon) * 111320e0 * cos(radians({s}.lat)))"
    return f"({e} * cos(radians({s}.heading)) - {n} * sin(radians({s}.heading)))"


def mahalanobis(s: str, lat: str, lon: str) -> str:
    a = f"({along(s, lat, lon)} / greatest({s}.sa, 0.000001e0))"
    c = f"({across(s, lat, lon)} / greatest({s}.sc, 0.000001e0))"
    return f"sqrt({a} * {a} + {c} * {c})"


def tile_x(lon: str, zoom: int) -> str:
    return f"(({lon} + 180e0) / 360e0 * {1 << zoom})"


def tile_y(lat: str, zoom: int) -> str:
    clamped = f"radians(greatest(least({lat}, 85.05112878e0), -85.05112878e0))"
    return f"((1e0 - ln(tan({clamped}) + 1e0 / cos({clamped})) / pi()) / 2e0 * {1 << zoom})"


def tile_lon(x: str, zoom: int) -> str:
    return f"({x} / {1 << zoom}e0 * 360e0 - 180e0)"


def tile_lat(y: str, zoom: int) -> str:
    z = f"(pi() * (1e0 - 2e0 * {y} / {1 << zoom}e0))"
    return f"degrees(atan((exp({z}) - exp(-{z})) / 2e0))"


def segment_distance(plat: str, plon: str, lat0: str = "25.75e0") -> str:
    """Metres from a point to the segment (alat, alon)-(blat, blon), projection clamped to its ends."""
    mx = f"(111320e0 * cos(radians({lat0})))"
    px, py = f"(({plon} - alon) * {mx})", f"(({plat} - alat) * 110540e0)"
    bx, by = f"((blon - alon) * {mx})", "((blat - alat) * 110540e0)"
    t = f"greatest(least(({px} * {bx} + {py} * {by}) / greatest({bx} * {bx} + {by} * {by}, 0.000000001e0), 1e0), 0e0)"
    dx, dy = f"({px} - {t} * {bx})", f"({py} - {t} * {by})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def confidence(n: str) -> str:
    return f"round(1e0 - exp(({n} - 1) * ln(0.6e0)), 2)"


def spaces(usable: str) -> str:
    return f"cast(floor({usable} / 6.7e0) as bigint)"


def plausible(highway: str, lanes: str) -> str:
    """Could kerbside parking exist: four street classes, or a secondary road whose first lanes value is at most 2."""
    first = f"case when {lanes} is null then 9 else try_cast(split_part({lanes}, ';', 1) as int) end"
    return f"case when {highway} in ('residential', 'unclassified', 'living_street', 'tertiary') then true when {highway} = 'secondary' then coalesce(({first}) <= 2, false) else false end"


def metres(alat: str, alon: str, blat: str, blon: str) -> str:
    """Distance by the flat frame of the first point."""
    n, e = f"(({blat} - {alat}) * 110540e0)", f"(({blon} - {alon}) * 111320e0 * cos(radians({alat})))"
    return f"sqrt({n} * {n} + {e} * {e})"


def signed_margin(corners: list[tuple[str, str]], x: str, y: str, ccw_only: bool = False) -> str:
    """Distance to the edges of a convex ring, positive inside. Either winding counts as inside unless ccw_only."""
    left, dist = [], []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        ex, ey = f"({bx} - {ax})", f"({by} - {ay})"
        px, py = f"({x} - {ax})", f"({y} - {ay})"
        left.append(f"({ex} * {py} - {ey} * {px})")
        t = f"greatest(least(({px} * {ex} + {py} * {ey}) / greatest({ex} * {ex} + {ey} * {ey}, 0.000000001e0), 1e0), 0e0)"
        dx, dy = f"({px} - {t} * {ex})", f"({py} - {t} * {ey})"
        dist.append(f"sqrt({dx} * {dx} + {dy} * {dy})")
    inside = f"least({', '.join(left)}) >= 0" + ("" if ccw_only else f" or greatest({', '.join(left)}) <= 0")
    return f"case when {inside} then least({', '.join(dist)}) else -least({', '.join(dist)}) end"


def verdict(margin: str, sigma: str) -> str:
    return f"case when abs({margin}) <= {sigma} then 'ambiguous' when {margin} > 0 then 'inside' else 'outside' end"


def dead_reckon(lat: str, lon: str, speed: str, course: str, seconds: str) -> tuple[str, str]:
    """Latitude and longitude after so many seconds at a constant speed and course."""
    n, e = f"{speed} * cos(radians({course})) * {seconds}", f"{speed} * sin(radians({course})) * {seconds}"
    return f"({lat} + {n} / ({EARTH} * pi() / 180))", f"({lon} + {e} / ({EARTH} * pi() / 180 * cos(radians({lat}))))"


def glance(bearing: str, lateral_m: float = 7.0) -> str:
    """Metres ahead of the camera at which a car lies that a single view shows at ``bearing`` degrees to the left (negative), lateral_m
    beside the course."""
    return f"({float(lateral_m):g}e0 / tan(radians(-({bearing}))))"


def glance_place(lat: str, lon: str, course: str, along: str, lateral_m: float = 7.0) -> tuple[str, str]:
    """Latitude and longitude of such a car: ``along`` metres ahead, then lateral_m to the left, in the flat frame of the camera."""
    n = f"({along} * cos(radians({course})) + {float(lateral_m):g}e0 * cos(radians({course} - 90)))"
    e = f"({along} * sin(radians({course})) + {float(lateral_m):g}e0 * sin(radians({course} - 90)))"
    return f"({lat} + {n} / 110540e0)", f"({lon} + {e} / (111320e0 * cos(radians({lat}))))"


def forward(alat: str, alon: str, blat: str, blon: str, lat0: str) -> tuple[str, str]:
    """East and north part of the unit vector from a to b, in the flat frame of latitude lat0; its left is (-north, east). Null where both
    coincide."""
    e, n = f"(({blon} - {alon}) * 111320e0 * cos(radians({lat0})))", f"(({blat} - {alat}) * 110540e0)"
    size = f"nullif(sqrt({e} * {e} + {n} * {n}), 0)"
    return f"({e} / {size})", f"({n} / {size})"


def compass(east: str, north: str) -> str:
    """Course of a vector, 0 to 360."""
    return f"((degrees(atan2({east}, {north})) + 360e0) % 360)"


def both_sigmas(along: str, across: str) -> str:
    """One number for an ellipse's two sigmas."""
    return f"sqrt({along} * {along} + {across} * {across})"


def on_street(kind: str) -> str:
    return f"(lower({kind}) = 'onstreet')"


def span_m(south: str, north: str, west: str, east: str) -> tuple[str, str]:
    """Metres from west to east, at the middle latitude, and from south to north."""
    return f"(({east} - {west}) * 111320e0 * cos(radians(({south} + {north}) / 2)))", f"(({north} - {south}) * 110540e0)"

"""Synthetic second pass over a street: who stays, who is replaced, and position noise, from counters hashed with a seed, so
every run and every engine with MD5 draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

M_LAT, M_LON = 110_540.0, 111_320.0
#: Colours of replaced cars, in the order of the draw.
COLOURS = ("black", "white", "red", "silver", "blue")


def uniform(key: Column, seed: int, draw: int) -> Column:
    """A number in (0, 1) for a key and the number of the draw: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(draw)))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def normal(key: Column, seed: int, draw: int) -> Column:
    """Standard normal by Box and Muller from draws number 2 * draw and 2 * draw + 1."""
    return F.sqrt(F.lit(-2.0) * F.log(uniform(key, seed, 2 * draw))) * F.cos(F.lit(2.0) * F.pi() * uniform(key, seed, 2 * draw + 1))


def second_pass(sightings: DataFrame, gap_s: float = 2400.0, turnover: float = 0.4, jitter_m: float = 1.2, spread_m: float = 30.0, seed: int = 7) -> DataFrame:
    """sightings (id, lat, lon, ts, color, ...) seen again gap_s later, with ``stayed``.

    A share ``turnover`` of the cars, by draw, has left: another car stands up to spread_m to the north or south, its colour
    drawn anew. Every position gets normal noise of jitter_m. Ids and other columns stay, so a pair with equal ids and
    ``stayed`` is a true one.
    """
    key = F.col("id")
    stayed = uniform(key, seed, 100) > turnover
    moved = F.when(stayed, F.lit(0.0)).otherwise((uniform(key, seed, 101) * 2 - 1) * spread_m)
    colour = F.element_at(F.array(*map(F.lit, COLOURS)), (F.floor(uniform(key, seed, 102) * len(COLOURS)) + 1).cast("int"))
    return sightings.withColumns({
        "stayed": stayed, "color": F.when(stayed, F.col("color")).otherwise(colour), "ts": F.col("ts") + gap_s,
        "lat": F.col("lat") + (moved + normal(key, seed, 0) * jitter_m) / M_LAT,
        "lon": F.col("lon") + normal(key, seed, 1) * jitter_m / (F.cos(F.radians("lat")) * M_LON),
    })

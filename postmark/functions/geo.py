"""Distances, boxes, grid cells and open location codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000
#: The 20 digits of open location codes (public specification).
DIGITS = "23456789CFGHJMPQRVWX"


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bounds(lat: Column, lng: Column, half_m: float) -> Column:
    """(south, west, north, east) of a square of twice ``half_m`` metres around a point; the width is bounded near the poles."""
    d = F.lit(half_m / 111_320.0)
    w = d / F.greatest(F.lit(0.2), F.cos(F.radians(lat)))
    return F.struct((lat - d).alias("south"), (lng - w).alias("west"), (lat + d).alias("north"), (lng + w).alias("east"))


def town_radius(population: Column) -> Column:
    """Metres within which a place counts as in town: 8 km at 1,000 people, 4 km more for each factor of ten, at most 30 km."""
    return F.least(F.lit(30_000.0), F.greatest(F.lit(8_000.0), 8_000 + 4_000 * F.log10(F.greatest(population, F.lit(1)) / 1000)))


def cell(lat: Column, lng: Column, size: float) -> Column:
    return F.struct(F.floor(lat / size).alias("y"), F.floor(lng / size).alias("x"))


def neighbours(c: Column, reach: Column | int = 1) -> Column:
    """The cells of the rows above, below and its own, up to ``reach`` to both sides of a cell."""
    reach = F.lit(reach) if isinstance(reach, int) else reach
    aside = F.sequence(-reach, reach)
    return F.flatten(F.transform(F.array(*(F.lit(dy) for dy in (-1, 0, 1))), lambda dy: F.transform(aside, lambda dx: F.struct((c.y + dy).alias("y"), (c.x + dx).alias("x")))))


def encode_plus_code(lat: Column, lng: Column) -> Column:
    """The ten-digit open location code of a point."""
    y = F.least(F.greatest(F.floor((lat + 90) * 8000), F.lit(0)), F.lit(180 * 8000 - 1))
    x = F.pmod(F.floor((lng + 180) * 8000), F.lit(360 * 8000))
    pair = [F.concat(F.substring(F.lit(DIGITS), (F.floor(y / 20**k) % 20 + 1).cast("int"), F.lit(1)), F.substring(F.lit(DIGITS), (F.floor(x / 20**k) % 20 + 1).cast("int"), F.lit(1))) for k in (4, 3, 2, 1, 0)]
    return F.concat(*pair[:4], F.lit("+"), pair[4])


def decode_plus_code(code: Column) -> Column:
    """(lat, lng) of the centre of a ten-digit code's cell; null for anything else."""
    plain = F.replace(F.upper(code), F.lit("+"), F.lit(""))
    value = lambda first: sum(((F.position(F.substring(plain, first + 2 * k, 1), F.lit(DIGITS)) - 1) * 20 ** (4 - k) for k in range(5)), F.lit(0))
    point = F.struct(((value(1) + 0.5) / 8000 - 90).alias("lat"), ((value(2) + 0.5) / 8000 - 180).alias("lng"))
    return F.when(F.upper(code).rlike(f"^[{DIGITS}]{{8}}\\+[{DIGITS}]{{2}}$"), point)


def recover_plus_code(short: Column, lat: Column, lng: Column) -> Column:
    """The full code nearest to a reference point that a code without its first four digits stands for; a full code stays, anything else is null."""
    code = F.upper(F.trim(short))
    own = encode_plus_code(lat, lng)
    near = F.concat(F.substring(own, 1, 4), code)
    point = decode_plus_code(near)
    moved = lambda at, ref, limit: at + F.when((ref - at > 0.5) & (at + 1 <= limit), 1.0).when((ref - at < -0.5) & (at - 1 >= -limit), -1.0).otherwise(0.0)
    found = encode_plus_code(moved(point.lat, lat, 90.0), moved(point.lng, lng, 180.0))
    return F.when(code.rlike(f"^[{DIGITS}]{{8}}\\+[{DIGITS}]{{2}}$"), code).when(code.rlike(f"^[{DIGITS}]{{4}}\\+[{DIGITS}]{{2}}$"), found)

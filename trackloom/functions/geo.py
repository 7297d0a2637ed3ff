"""Geodesy, camera projection and solar position as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6_371.0
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
FEET = 0.3048


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), a))) * (2 * EARTH_KM)


def bounding_box(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    """A box around the radius as comparisons with literals, which scans can take over."""
    import math

    dlat = radius_km / 111.0
    dlon = radius_km / (111.0 * max(0.01, math.cos(math.radians(lat0))))
    return lat.between(lat0 - dlat, lat0 + dlat) & lon.between(lon0 - dlon, lon0 + dlon)


def altitude(gnss: Column, baro: Column, policy: str, most_apart: float = 200.0) -> Column:
    """struct(alt, source) by policy gnss, barometric or auto; both null if neither exists."""
    pick = lambda c, name: F.struct(c.alias("alt"), F.lit(name).alias("source"))
    none = F.struct(F.lit(None).cast("double").alias("alt"), F.lit(None).cast("string").alias("source"))
    g, b = pick(gnss, "gnss"), pick(baro, "barometric")
    if policy == "gnss":
        return F.when(gnss.isNotNull(), g).when(baro.isNotNull(), b).otherwise(none)
    if policy == "barometric":
        return F.when(baro.isNotNull(), b).when(gnss.isNotNull(), g).otherwise(none)
    if policy != "auto":
        raise ValueError(f"unknown altitude policy: {policy}")
    apart = F.abs(gnss - baro) > most_apart
    return F.when(gnss.isNull() & baro.isNull(), none).when(gnss.isNull() | F.coalesce(apart, F.lit(False)), b).otherwise(g)


def ecef(lat: Column, lon: Column, h: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    la, lo = F.radians(lat), F.radians(lon)
    n = F.lit(WGS84_A) / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - e2) + h) * F.sin(la)


def enu(lat: Column, lon: Column, h: Column, lat0: float, lon0: float, h0: float) -> tuple[Column, Column, Column]:
    """East, north and up in metres from a site."""
    x, y, z = ecef(lat, lon, h)
    x0, y0, z0 = ecef(F.lit(lat0), F.lit(lon0), F.lit(h0))
    dx, dy, dz = x - x0, y - y0, z - z0
    la, lo = F.radians(F.lit(lat0)), F.radians(F.lit(lon0))
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    up = F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz
    return east, north, up


def pinhole(x: Column, y: Column, z: Column, f: float, cx: float, cy: float, k1: float = 0.0, k2: float = 0.0) -> tuple[Column, Column]:
    """Pixel of a camera-frame point with radial distortion; null behind the camera."""
    u, v = F.when(z > 0, x / z), F.when(z > 0, y / z)
    r2 = u * u + v * v
    d = 1 + k1 * r2 + k2 * r2 * r2
    return u * d * f + cx, v * d * f + cy


def turned(p: tuple[Column, Column, Column], rotation: tuple) -> tuple[Column, ...]:
    """A point or direction turned by a matrix of three rows."""
    return tuple(sum((c * r for c, r in zip(p[1:], row[1:])), p[0] * row[0]) for row in rotation)


def _distorted(u: Column, v: Column, k: tuple) -> tuple[Column, Column]:
    k1, k2, p1, p2, k3 = k
    r2 = u * u + v * v
    radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
    return u * radial + 2 * p1 * u * v + p2 * (r2 + 2 * u * u), v * radial + p1 * (r2 + 2 * v * v) + 2 * p2 * u * v


def camera(p: tuple[Column, Column, Column], rotation: tuple, fx: float, fy: float, cx: float, cy: float, k: tuple = (0.0, 0.0, 0.0, 0.0, 0.0)) -> tuple[Column, Column]:
    """Pixel of a point (east, north, up) seen by a turned camera with radial (k1, k2, k3) and tangential (p1, p2) distortion.

    k is (k1, k2, p1, p2, k3); rotation takes the point's frame to the camera's. Null behind the camera.
    """
    x, y, z = turned(p, rotation)
    u, v = _distorted(F.when(z > 0, x / z), F.when(z > 0, y / z), k)
    return u * fx + cx, v * fy + cy


def camera_ray(px: Column, py: Column, rotation: tuple, fx: float, fy: float, cx: float, cy: float, k: tuple = (0.0, 0.0, 0.0, 0.0, 0.0), rounds: int = 40) -> tuple[Column, ...]:
    """The direction (east, north, up), with depth 1 in the camera's frame, that a pixel sees: camera() undone by fixed-point rounds.

    Each round takes off the tangential shift at the last guess and divides by the radial factor there.
    """
    k1, k2, p1, p2, k3 = k
    u0, v0 = (px - cx) / fx, (py - cy) / fy

    def step(s: Column, _: Column) -> Column:
        u, v, r2 = s["u"], s["v"], s["u"] * s["u"] + s["v"] * s["v"]
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        return F.struct(((u0 - 2 * p1 * u * v - p2 * (r2 + 2 * u * u)) / radial).alias("u"), ((v0 - p1 * (r2 + 2 * v * v) - 2 * p2 * u * v) / radial).alias("v"))

    s = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(u0.alias("u"), v0.alias("v")), step)
    back = tuple(zip(*rotation))  # the inverse of a rotation
    return turned((s["u"], s["v"], F.lit(1.0)), back)


def clip_box(x0: Column, y0: Column, x1: Column, y1: Column, w: int, h: int) -> Column:
    """Axis-aligned box in whole pixels inside a w by h image."""
    left, top = F.greatest(F.floor(x0), F.lit(0)), F.greatest(F.floor(y0), F.lit(0))
    right, bottom = F.least(F.ceil(x1), F.lit(w - 1)), F.least(F.ceil(y1), F.lit(h - 1))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"))


def angle_mod_180(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def acute(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def solar_elevation(day_of_year: Column, hour_utc: Column, lat: float, lon: float) -> Column:
    """Degrees above the horizon by the short NOAA series."""
    g = F.lit(2 * 3.141592653589793 / 365.0) * (day_of_year - 1 + (hour_utc - 12) / 24)
    eq = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    dec = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    ha = F.radians((hour_utc * 60 + eq + 4 * lon) / 4 - 180)
    la = F.radians(F.lit(lat))
    c = F.sin(la) * F.sin(dec) + F.cos(la) * F.cos(dec) * F.cos(ha)
    return 90 - F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def feet_to_metres(feet: Column, geoid: float = 0.0) -> Column:
    """Metres, moved by the geoid's height; null stays null."""
    return feet * FEET + geoid


def roi_halves(along: Column, cross: Column, padding: float) -> tuple[Column, Column]:
    """Half lengths along and across: of the full sizes if both are given and not 0, else three paddings and one."""
    given = F.coalesce((along != 0) & (cross != 0), F.lit(False))
    return F.when(given, along / 2).otherwise(3 * padding), F.when(given, cross / 2).otherwise(padding)


def rotated_box(cx: Column, cy: Column, vx: Column, vy: Column, along: Column, cross: Column) -> Column:
    """Four corners (x, y) of the rectangle around a centre with its long side along the unit vector, in turning order."""

    def corner(a: int, c: int) -> Column:
        return F.struct((cx + a * along * vx - c * cross * vy).alias("x"), (cy + a * along * vy + c * cross * vx).alias("y"))

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def crop_origin(edge: Column, padding: int) -> Column:
    """Where a padded crop begins in its frame, clipped at 0."""
    return F.greatest(edge - padding, F.lit(0))


def pixel_metres(pixels: Column, e: Column, n: Column, u: Column, fx: float, fy: float) -> Column:
    """Metres that a length in pixels spans at the slant range; 0 without a length, a position or a distance."""
    slant = F.sqrt(e * e + n * n + u * u)
    return F.when((pixels > 0) & (slant >= 1), slant * pixels / (fx * fy) ** 0.5).otherwise(0.0)


def along_span(lines: DataFrame, keys: list[str], vx: float, vy: float) -> DataFrame:
    """Extent along a unit vector of the ends (x1, y1) and (x2, y2) of all lines of a key."""
    p, q = F.col("x1") * vx + F.col("y1") * vy, F.col("x2") * vx + F.col("y2") * vy
    return lines.groupBy(*keys).agg((F.max(F.greatest(p, q)) - F.min(F.least(p, q))).alias("span"))

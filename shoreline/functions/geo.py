"""Geography: longitudes, affine rasters, distances on the sphere and inverse transverse Mercator."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Sphere radius in metres, metres and kilometres of a degree.
RADIUS_M, DEGREE_M, DEGREE_KM = 6_371_000.0, 111_320.0, 111.0


def normalize_longitude(lon: Column, to_360: bool = True) -> Column:
    """[0, 360), or [-180, 180)."""
    return F.pmod(lon, F.lit(360.0)) if to_360 else F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def valid_coordinate(lon: Column, lat: Column) -> Column:
    return finite(lon) & finite(lat) & lat.between(-90.0, 90.0)


def chunk_key(lon: Column, lat: Column, degrees: float = 5.0) -> Column:
    return (F.floor(lon / degrees) * 1000 + F.floor((lat + 90.0) / degrees)).cast("long")


def pixel_center(row: Column, col: Column, a, b, c, d, e, f) -> tuple[Column, Column]:
    x, y = col + 0.5, row + 0.5
    return F.lit(a) * x + F.lit(b) * y + F.lit(c), F.lit(d) * x + F.lit(e) * y + F.lit(f)


def inverse_affine(x: Column, y: Column, a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[Column, Column]:
    """Fractional (col, row) of a point."""
    det = a * e - b * d
    return ((x - c) * e - (y - f) * b) / det, ((y - f) * a - (x - c) * d) / det


def not_nodata(v: Column, nodata) -> Column:
    """Finite, and not within relative 1e-5 and absolute 1e-8 of the nodata value."""
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return finite if nodata is None else finite & (F.abs(v - nodata) > 1e-8 + 1e-5 * abs(nodata))


def chord(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    """Metres from the centre of the sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return RADIUS_M * F.cos(la) * F.cos(lo), RADIUS_M * F.cos(la) * F.sin(lo), RADIUS_M * F.sin(la)


def planar_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx = (lon1 - lon2) * DEGREE_KM * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat1 - lat2) * DEGREE_KM
    return F.sqrt(dx * dx + dy * dy)


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    along = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def barycentric(px, py, ax, ay, bx, by, cx, cy) -> tuple[Column, Column, Column]:
    det = F.nullif((by - cy) * (ax - cx) + (cx - bx) * (ay - cy), F.lit(0.0))
    u = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
    v = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
    return u, v, 1.0 - u - v


def bilinear_weights(u: Column, v: Column) -> tuple[Column, Column, Column, Column]:
    """Weights of the corners (0,0), (1,0), (0,1), (1,1); u and v are clipped to [0, 1]."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    u, v = clip(u), clip(v)
    return (1.0 - u) * (1.0 - v), u * (1.0 - v), (1.0 - u) * v, u * v


def circular_span(df: DataFrame, lon: str, *keys: str) -> DataFrame:
    """keys, span, start, end of the shortest arc that holds all longitudes of a group; the first largest gap wins (to 9 places)."""
    pts = df.where(F.col(lon).isNotNull()).select(*keys, normalize_longitude(F.col(lon)).alias("_l")).distinct()
    w = Window.partitionBy(*keys)
    o = w.orderBy("_l")
    nxt = F.coalesce(F.lead("_l").over(o), F.min("_l").over(w) + 360.0)
    gaps = pts.withColumn("_next", nxt).withColumn("_gap", F.round(F.col("_next") - F.col("_l"), 9))
    best = gaps.groupBy(*keys).agg(F.max(F.struct(F.col("_gap"), (-F.col("_l")).alias("_m"), F.col("_next"))).alias("g"))
    start = F.pmod(F.col("g._next"), F.lit(360.0))
    return best.select(*keys, (360.0 - F.col("g._gap")).alias("span"), start.alias("start"), (start + (360.0 - F.col("g._gap"))).alias("end"))


def boxes(lon_min: float, lon_max: float) -> list[tuple[float, float]]:
    """A range of longitudes as one or two ranges within [0, 360]."""
    if lon_max - lon_min >= 360:
        return [(0.0, 360.0)]
    a, b = lon_min % 360.0, lon_max % 360.0
    return [(a, b)] if a <= b else [(a, 360.0), (0.0, b)]


def in_boxes(lon: Column, lon_min: float, lon_max: float, tolerance: float = 1e-6) -> Column:
    """A filter that reaches the scan: one or two closed ranges of normalised longitude."""
    out = F.lit(False)
    for a, b in boxes(lon_min, lon_max):
        out = out | lon.between(a - tolerance, b + tolerance)
    return out


def support_window(lat: float, cutoff_m: float) -> tuple[float, float]:
    """Padding in degrees of latitude and longitude that holds all support within the cutoff."""
    pad = math.degrees(cutoff_m / RADIUS_M) + 0.5
    return pad, min(180.0, pad / max(math.cos(math.radians(max(-89.9, min(89.9, lat)))), 0.05))


def utm_to_lonlat(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres on WGS84: inverse transverse Mercator by the sixth-order series in the
    third flattening."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360 - 81 * n**5 / 512,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440 + 46 * n**5 / 105,
        17 * n**3 / 480 - 37 * n**4 / 840 - 209 * n**5 / 4480,
        4397 * n**4 / 161280 - 11 * n**5 / 504,
        4583 * n**5 / 161280,
    )
    xi = (y - (0.0 if north else 1e7)) / (k0 * rect)
    eta = (x - 5e5) / (k0 * rect)
    xp, ep = xi, eta
    for j, b in enumerate(beta, 1):
        xp = xp - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        ep = ep - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xp) / F.cosh(ep))
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(ep), F.cos(xp))) + (zone * 6 - 183)
    return lon, F.degrees(lat)

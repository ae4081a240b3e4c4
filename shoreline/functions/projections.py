"""Map projections of the ellipsoid as column expressions, forward and back: Lambert conformal conic, polar stereographic, transverse Mercator
and web Mercator. Coordinates are metres and degrees; a place that a projection can't show gives null or NaN."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shoreline.functions import geo

#: Axis in metres and inverse flattening.
WGS84, GRS80 = (6_378_137.0, 298.257223563), (6_378_137.0, 298.257222101)


def _e(ellipsoid: tuple[float, float]) -> float:
    f = 1 / ellipsoid[1]
    return math.sqrt(f * (2 - f))


def _narrowed(sin_lat: Column, e: float) -> Column:
    """((1 - e s) / (1 + e s)) ** (e / 2), naming s once, so that rounds of it don't double the expression."""
    return F.exp(-e * F.atanh(e * sin_lat))


def conformal(lat: Column, e: float) -> Column:
    """The tangent of half the conformal distance from the north pole; lat in radians."""
    return F.tan(math.pi / 4 - lat / 2) / _narrowed(F.sin(lat), e)


def _conformal(lat: float, e: float) -> float:
    s = e * math.sin(lat)
    return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)


def _radius(lat: float, e: float) -> float:
    return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)


def latitude(t: Column, e: float, rounds: int = 5) -> Column:
    """Radians of the latitude that conformal() gives t for: each round is 150 times nearer."""
    lat = math.pi / 2 - 2 * F.atan(t)
    for _ in range(rounds):
        lat = math.pi / 2 - 2 * F.atan(t * _narrowed(F.sin(lat), e))
    return lat


@dataclass(frozen=True)
class Lambert:
    """Lambert conformal conic with two standard parallels."""

    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east: float = 0.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _cone(self) -> tuple[float, float, float, float]:
        e = _e(self.ellipsoid)
        a, b, o = (math.radians(x) for x in (self.lat1, self.lat2, self.lat0))
        n = math.sin(a) if self.lat1 == self.lat2 else math.log(_radius(a, e) / _radius(b, e)) / math.log(_conformal(a, e) / _conformal(b, e))
        scale = self.ellipsoid[0] * _radius(a, e) / (n * _conformal(a, e) ** n)
        return e, n, scale, scale * _conformal(o, e) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, scale, top = self._cone()
        r = scale * F.pow(conformal(F.radians(lat), e), F.lit(n))
        angle = n * F.radians(geo.normalize_longitude(lon - self.lon0, False))
        return self.east + r * F.sin(angle), self.north + top - r * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, n, scale, top = self._cone()
        sign = math.copysign(1.0, n)
        dx, dy = sign * (x - self.east), sign * (top - (y - self.north))
        lat = latitude(F.pow(F.hypot(dx, dy) / (sign * scale), F.lit(1 / n)), e)
        return geo.normalize_longitude(F.degrees(F.atan2(dx, dy)) / n + self.lon0, False), F.degrees(lat)


@dataclass(frozen=True)
class PolarStereographic:
    """True to scale at a parallel, whose sign says which pole."""

    true_lat: float
    lon0: float
    east: float = 0.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _scale(self) -> tuple[float, float, float]:
        e, at = _e(self.ellipsoid), math.radians(abs(self.true_lat))
        k = 2 / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e)) if abs(self.true_lat) == 90 else _radius(at, e) / _conformal(at, e)
        return e, math.copysign(1.0, self.true_lat), self.ellipsoid[0] * k

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, sign, scale = self._scale()
        r, angle = scale * conformal(sign * F.radians(lat), e), F.radians(lon - self.lon0)
        return self.east + r * F.sin(angle), self.north - sign * r * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, sign, scale = self._scale()
        dx, dy = x - self.east, -sign * (y - self.north)
        lat = sign * F.degrees(latitude(F.hypot(dx, dy) / scale, e))
        return geo.normalize_longitude(F.degrees(F.atan2(dx, dy)) + self.lon0, False), lat


@dataclass(frozen=True)
class TransverseMercator:
    """By series of the third flattening to its fourth power, good to micrometres within some 30 degrees of the meridian."""

    lon0: float
    scale: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: tuple[float, float] = WGS84

    def _series(self):
        f = 1 / self.ellipsoid[1]
        n = f / (2 - f)
        radius = self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        there = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
        back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
        return _e(self.ellipsoid), radius, there, back

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, radius, there, _ = self._series()
        s, d = F.sin(F.radians(lat)), F.radians(geo.normalize_longitude(lon - self.lon0, False))
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        u, v = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = v, u
        for k, a in enumerate(there, 1):
            x, y = x + a * F.cos(2 * k * u) * F.sinh(2 * k * v), y + a * F.sin(2 * k * u) * F.cosh(2 * k * v)
        return self.east + radius * x, self.north + radius * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        e, radius, _, back = self._series()
        u0, v0 = (y - self.north) / radius, (x - self.east) / radius
        u, v = u0, v0
        for k, b in enumerate(back, 1):
            u, v = u - b * F.sin(2 * k * u0) * F.cosh(2 * k * v0), v - b * F.cos(2 * k * u0) * F.sinh(2 * k * v0)
        lat = latitude(F.tan(math.pi / 4 - F.asin(F.sin(u) / F.cosh(v)) / 2), e)
        return geo.normalize_longitude(self.lon0 + F.degrees(F.atan2(F.sinh(v), F.cos(u))), False), F.degrees(lat)


@dataclass(frozen=True)
class WebMercator:
    """The sphere of web maps."""

    radius: float = WGS84[0]

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return self.radius * F.radians(lon), self.radius * F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        return F.degrees(x / self.radius), F.degrees(2 * F.atan(F.exp(y / self.radius)) - math.pi / 2)


#: Systems by their numbers; UTM zones are in projection_of().
SYSTEMS = {
    2154: Lambert(49.0, 44.0, 46.5, 3.0, 700_000.0, 6_600_000.0, GRS80), 3034: Lambert(35.0, 65.0, 52.0, 10.0, 4_000_000.0, 2_800_000.0, GRS80), 3413: PolarStereographic(70.0, -45.0),
    3995: PolarStereographic(71.0, 0.0), 3031: PolarStereographic(-71.0, 0.0), 3857: WebMercator(),
}


def projection_of(code: int):
    """The projection of an EPSG number: UTM zones of WGS 84 and those in SYSTEMS."""
    if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
        return TransverseMercator(code % 100 * 6 - 183.0, north=0.0 if code // 100 == 326 else 10_000_000.0)
    if code not in SYSTEMS:
        raise ValueError(f"EPSG:{code} isn't one of the projections that are known")
    return SYSTEMS[code]

"""Rasters as tables: headers (one row each), their checks, inventories and synthetic terrain.

A raster is a header row and pixels (raster_id, row, col, z). headers: raster_id, path, width, height, bands, crs ("EPSG:n"), unit ("degree", "metre",
"foot", "US survey foot"), a, b, c, d, e, f (x = a (col + 1/2) + b (row + 1/2) + c, y = d (col + 1/2) + e (row + 1/2) + f), nodata, dtype, bytes, modified.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions import geo, projections

#: Metres of a unit; a degree has none.
UNITS = {"metre": 1.0, "foot": 0.3048, "US survey foot": 1200 / 3937}


@dataclass(frozen=True)
class Frame:
    """The geometry of one axis-parallel raster: outer corner of pixel (0, 0), steps, size and unit."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    crs: str = "EPSG:4326"
    unit: str = "degree"
    nodata: float | None = None

    @property
    def projected(self) -> bool:
        return self.unit != "degree"

    @property
    def factor(self) -> float:
        return UNITS.get(self.unit, 1.0)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """west, south, east, north."""
        x, y = (self.x0, self.x0 + self.dx * self.width), (self.y0, self.y0 + self.dy * self.height)
        return min(x), min(y), max(x), max(y)

    def pixel_m(self) -> float:
        """The shorter side of a pixel in metres."""
        if self.projected:
            return min(abs(self.dx), abs(self.dy)) * self.factor
        return min(abs(self.dx) * geo.DEGREE_M * self._cos(), abs(self.dy) * geo.DEGREE_M)

    def _cos(self) -> float:
        return max(0.01, math.cos(math.radians((self.bounds[1] + self.bounds[3]) / 2)))

    def steps(self, spacing_m: float) -> tuple[float, float]:
        """A spacing along x and y in the raster's unit."""
        if self.projected:
            return spacing_m / self.factor, spacing_m / self.factor
        return spacing_m / (geo.DEGREE_M * self._cos()), spacing_m / geo.DEGREE_M

    def lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Geographic coordinates of a point; projected ones must be a UTM zone (EPSG 326zz or 327zz) or one of functions.projections, in any unit."""
        if not self.projected:
            return geo.normalize_longitude(x, False), y
        code = int(self.crs.rsplit(":", 1)[-1])
        if code // 100 not in (326, 327):
            return projections.projection_of(code).inverse(x * self.factor, y * self.factor)
        return geo.utm_to_lonlat(x * self.factor, y * self.factor, code % 100, code // 100 == 326)

    def xy(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Coordinates of a place in the raster's system and unit; longitudes of a geographic raster are brought within a turn from its west."""
        if not self.projected:
            west = self.bounds[0]
            return F.pmod(lon - west, F.lit(360.0)) + west, lat
        x, y = projections.projection_of(int(self.crs.rsplit(":", 1)[-1])).forward(lon, lat)
        return x / self.factor, y / self.factor

    def centers(self, pixels: DataFrame) -> DataFrame:
        """pixels with x and y of their centres."""
        x, y = geo.pixel_center(F.col("row"), F.col("col"), self.dx, 0.0, self.x0, 0.0, self.dy, self.y0)
        return pixels.withColumns({"x": x, "y": y})

    def tags(self) -> dict:
        """What a cache and a product say of the raster they belong to."""
        t = {"width": self.width, "height": self.height, "crs": self.crs}
        return t | {f"transform_{n}": v for n, v in zip("abcdef", (self.dx, 0.0, self.x0, 0.0, self.dy, self.y0), strict=True)}


def frame_of(header) -> Frame:
    """The geometry of a header row; a row without CRS, a turned raster and an empty one are errors."""
    if (header["crs"] or "").strip().lower() in ("", "unknown", "none"):
        raise ValueError(f"{header['path']}: no coordinate reference system")
    if header["b"] or header["d"]:
        raise ValueError(f"{header['path']}: the raster is turned")
    if header["width"] <= 0 or header["height"] <= 0 or header["bands"] < 1:
        raise ValueError(f"{header['path']}: no pixels")
    return Frame(header["c"], header["f"], header["a"], header["e"], header["width"], header["height"], header["crs"], header["unit"], header["nodata"])


def checked(headers: DataFrame) -> DataFrame:
    """headers with valid and error: what lacks a CRS or a size can't be worked on."""
    crs = F.lower(F.trim(F.coalesce("crs", F.lit(""))))
    error = F.when(crs.isin("", "unknown", "none"), "no coordinate reference system").when((F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("bands") < 1), F.format_string("no pixels (%dx%d, %d bands)", "width", "height", "bands"))
    return headers.withColumn("error", F.coalesce(error, F.lit(""))).withColumn("valid", F.col("error") == "")


def inspected(headers: DataFrame, pixels: DataFrame | None = None) -> DataFrame:
    """Sound headers with projected, unit_factor, res_x, res_y, west, south, east, north, total_pixels and, with pixels, valid_pixels."""
    h = checked(headers).where("valid").drop("valid", "error")
    factor = F.create_map(*(F.lit(x) for kv in UNITS.items() for x in kv))
    x1, y1 = F.col("c") + F.col("a") * F.col("width"), F.col("f") + F.col("e") * F.col("height")
    h = h.withColumns({"projected": F.col("unit") != "degree", "unit_factor": F.coalesce(F.try_element_at(factor, F.col("unit")), F.lit(1.0)), "res_x": F.abs("a"), "res_y": F.abs("e")})
    h = h.withColumns({"west": F.least("c", x1), "south": F.least("f", y1), "east": F.greatest("c", x1), "north": F.greatest("f", y1), "total_pixels": F.col("width").cast("long") * F.col("height")})
    if pixels is None:
        return h
    ok = pixels.join(F.broadcast(headers.select("raster_id", "nodata")), "raster_id").where(geo.not_nodata(F.col("z"), None) & ~F.coalesce(F.abs(F.col("z") - F.col("nodata")) <= 1e-8 + 1e-5 * F.abs("nodata"), F.lit(False)))
    return h.join(ok.groupBy("raster_id").agg(F.count("*").alias("valid_pixels")), "raster_id", "left").withColumn("valid_pixels", F.coalesce("valid_pixels", F.lit(0)))


def inventory(headers: DataFrame) -> DataFrame:
    """by ("all", "valid", "crs", "resolution"), name and number of rasters."""
    h = checked(headers).withColumn("resolution", F.format_string("%.6fx%.6f", F.abs("a"), F.abs("e")))
    count = lambda by, name, rows: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(by).alias("by"), "name", "n")
    sound = h.where("valid")
    return count("all", F.lit("all"), h).unionByName(count("valid", F.col("valid").cast("string"), h)).unionByName(count("crs", F.col("crs"), sound)).unionByName(count("resolution", F.col("resolution"), sound))


def formatted_resolution(h: DataFrame) -> Column:
    """The pixel size of an inspected() header as text: degrees with metres at the middle latitude, or metres, kilometres or feet."""
    x, y = F.col("res_x"), F.col("res_y")
    least, most = F.least(x, y), F.greatest(x, y)
    pair = lambda form, a, b: F.format_string(form, a, b)
    degrees = F.when(least < 0.001, pair("%.6f° × %.6f°", x, y)).when(least < 0.01, pair("%.5f° × %.5f°", x, y)).otherwise(pair("%.4f° × %.4f°", x, y))
    cos = F.greatest(F.lit(0.001), F.cos(F.radians((F.col("south") + F.col("north")) / 2)))
    far = lambda m: F.when(m >= 1000, F.format_string("%.2f km", m / 1000)).when(m >= 10, F.format_string("%.1f m", m)).otherwise(F.format_string("%.2f m", m))
    geographic = F.concat(degrees, F.lit(" (about "), far(x * geo.DEGREE_M * cos), F.lit(" × "), far(y * geo.DEGREE_M), F.lit(")"))
    feet = F.format_string("%.2f ft × %.2f ft (about %.2f m × %.2f m)", x, y, x * F.col("unit_factor"), y * F.col("unit_factor"))
    metres = F.when(most >= 1000, pair("%.2f km × %.2f km", x / 1000, y / 1000)).when(least < 1, pair("%.3f m × %.3f m", x, y)).otherwise(pair("%.2f m × %.2f m", x, y))
    return F.when(~F.col("projected"), geographic).when(F.col("unit").contains("foot"), feet).otherwise(metres)


def output_nodata(nodata: float | None) -> float:
    """What a percentage product writes where it has no value: the terrain's nodata if it is finite and no percentage, else NaN."""
    ok = nodata is not None and math.isfinite(nodata) and not 0 <= nodata <= 100
    return float(nodata) if ok else math.nan


def masked_pixels(pixels: DataFrame, nodata: float | None) -> DataFrame:
    """pixels whose nodata heights are null."""
    return pixels.withColumn("z", F.when(geo.not_nodata(F.col("z"), nodata), F.col("z")))


#: The terrain patterns.
PATTERNS = ("coast", "ramp", "beach", "flat")


def terrain(spark: SparkSession, pattern: str, width: int, height: int, barrier: tuple[int, int] | None = None) -> DataFrame:
    """row, col, z of a synthetic raster: a slope with creeks and a corner of land, a ramp down the rows, a beach along the columns, or
    level ground; a barrier of columns has no height."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}")
    p = spark.range(width * height).select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    land = (F.col("row") < height * 0.15) & (F.col("col") < width * 0.15)
    z = {
        "coast": F.when(~land, -2.5 + 6.0 * (c / width) - 1.5 * (r / height) + 0.6 * F.sin(r / 25.0) * F.cos(c / 30.0)),
        "ramp": -3.0 + 6.0 * (r / max(1, height - 1)),
        "beach": -2.5 + 5.0 * (c / max(1, width - 1)),
        "flat": F.lit(0.0),
    }[pattern]
    if barrier:
        z = F.when(~((F.col("col") >= barrier[0]) & (F.col("col") < barrier[1])), z)
    return p.select("row", "col", z.cast("float").cast("double").alias("z"))

"""The difference of two geoid models as a raster: what the datum chain adds between their heights."""

from __future__ import annotations

import math
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.operators import gridcells, sampling
from shoreline.sources.geotiff import Header, read_grid, write_raster
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import freed, stored


def axes(h: Header) -> tuple[gridcells.Axis, gridcells.Axis]:
    """The lines of pixel centres of a grid."""
    return gridcells.Axis(h.c + h.a / 2, h.a, h.width), gridcells.Axis(h.f + h.e / 2, h.e, h.height)


def frame_of_grid(h: Header) -> Frame:
    return Frame(h.c, h.f, h.a, h.e, h.width, h.height, h.crs, h.unit, h.nodata)


def same_lines(a: Header, b: Header) -> bool:
    return all(getattr(a, k) == getattr(b, k) for k in ("width", "height", "crs", *"abcdef"))


def reprojected(grid: DataFrame, source: Frame, target: Frame) -> DataFrame:
    """i, j, val of a raster (i, j, val) at the pixel centres of another, in any system: bilinear from four neighbours that all have a value, null elsewhere. Each
    pixel of the target finds its neighbours by an equi-join; the target is as large as its frame says."""
    n = F.col("id")
    pixels = grid.sparkSession.range(target.width * target.height).select(n, F.call_function("div", n, F.lit(target.width)).cast("int").alias("row"), (n % target.width).cast("int").alias("col"))
    p = target.centers(pixels)
    x, y = source.xy(*target.lonlat(F.col("x"), F.col("y")))
    at = p.select("id", "row", "col", ((x - source.x0) / source.dx - 0.5).alias("fx"), ((y - source.y0) / source.dy - 0.5).alias("fy"))
    found = sampling.bilinear(at, grid, "id", "fx", "fy")
    return found.select((n % target.width).alias("i"), F.call_function("div", n, F.lit(target.width)).alias("j"), F.col("value").alias("val"))


def geoid_difference(reference: tuple[DataFrame, Header], target: tuple[DataFrame, Header]) -> DataFrame:
    """i, j, val on the lines of the reference: its undulation less the target's, in float32. A target on other lines, or in another system, is
    interpolated bilinearly from four neighbours that all have a value."""
    (a, ha), (b, hb) = reference, target
    if ha.crs != hb.crs:
        b = reprojected(b, frame_of_grid(hb), frame_of_grid(ha))
    elif not same_lines(ha, hb):
        b = gridcells.resampled(b, *axes(hb), a.select("i", "j"), *axes(ha))
    single = lambda g: g.select("i", "j", F.col("val").cast("float").alias("val"))
    return gridcells.difference(single(a), single(b)).where("val is not null")


def write_geoid_difference(spark: SparkSession, reference: str, target: str, output: str, reference_name: str, target_name: str, overwrite: bool = False, block: int = 2048, tile: int = 256) -> dict:
    """Reads two GeoTIFF geoids, writes their difference with the tags of its provenance, and returns how many pixels have one and their least, greatest
    and mean value and spread. Geoids without a common pixel are an error, and nothing is written."""
    one, two = read_grid(spark, reference), read_grid(spark, target)
    found = stored(geoid_difference(one, two), "geoid-difference")
    stats = found.agg(F.count("val").alias("n"), F.min("val").alias("low"), F.max("val").alias("high"), F.avg(F.col("val").cast("double")).alias("mean"), F.stddev_pop(F.col("val").cast("double")).alias("spread")).first()
    if not stats["n"]:
        raise ValueError("the geoids have no pixel in common")
    tags = {
        "REF_MODEL": reference_name, "TARGET_MODEL": target_name, "CREATED_AT": datetime.now(UTC).isoformat(), "FORMULA": f"H_{target_name} = Tide_MSL + MDT + (N_{reference_name} - N_{target_name})",
        "DELTA_N_DEF": f"N_{reference_name} - N_{target_name}", "VALID": stats["n"],
    }
    pixels = found.select(F.col("j").alias("row"), F.col("i").alias("col"), F.col("val").alias("z"))
    write_raster(pixels, frame_of_grid(one[1]), output, "z", "float32", math.nan, tags, block, tile, overwrite)
    freed(found)
    return stats.asDict()

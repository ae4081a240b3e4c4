"""Terrain to mean sea level: topography and geoid difference at every pixel, with counts of what was native and what extrapolated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.operators import datum, sampling


def convert(pixels: DataFrame, mdt_grid: DataFrame, dn_grid: DataFrame, support: DataFrame, key: str, cutoff_m: float = 100_000.0) -> DataFrame:
    """key, z_msl, qc. pixels: key, z, lon, lat, mx, my (fractional indices in the topography grid), dx, dy (in the other grid).
    support: sid, lon, lat, v, the topography's own nodes, for pixels outside its grid."""
    native = sampling.bilinear(pixels, mdt_grid, key, "mx", "my").withColumnRenamed("value", "own")
    p = pixels.join(native, key)
    mdt = sampling.idw(p, support, key, "sid", "v", cutoff_m=cutoff_m, native="own").select(key, F.col("value").alias("mdt"), F.col("quality").alias("q"))
    dn = sampling.bilinear(pixels, dn_grid, key, "dx", "dy").withColumnRenamed("value", "dn")
    z, q = datum.to_msl(F.col("z"), F.col("mdt"), F.col("dn"), F.col("q"))
    return pixels.select(key, "z").join(mdt, key).join(dn, key).select(key, z.alias("z_msl"), q.alias("qc"))


def counts(converted: DataFrame) -> DataFrame:
    """total, native, extrapolated, nodata."""
    c = converted.agg(F.count("*").alias("total"), F.count_if(F.col("qc") == 0).alias("native"), F.count_if(F.col("qc") == 1).alias("extrapolated"))
    return c.withColumn("nodata", F.col("total") - F.col("native") - F.col("extrapolated"))

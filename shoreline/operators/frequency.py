"""How often the water is above a height: count(h > z) / count(h), equality not counted; null where there is no level or z."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def inundated(h: Column, z: Column) -> Column:
    return h > z


def frequency(series: DataFrame, thresholds: DataFrame, key: str = "node_id", level: str = "level", percent: bool = True, at_least: bool = False) -> DataFrame:
    """series (key, level) against thresholds (key, z): key, z, n, frequency. One aggregation after an equi-join; at_least
    counts h >= z instead. Levels are compared as float32, as in the packed form; those that aren't finite don't count."""
    series = series.select(key, finite(F.col(level).cast("float")).alias(level))
    h = F.col(level)
    hit = (h >= F.col("z")) if at_least else (h > F.col("z"))
    joined = thresholds.select(key, "z").join(series.where(h.isNotNull()).select(key, level), key, "left")
    out = joined.groupBy(key, "z").agg(F.count(level).alias("n"), F.count_if(hit).alias("_up"))
    share = F.when(F.col("z").isNotNull(), F.col("_up") / F.nullif(F.col("n"), F.lit(0)))
    return out.select(key, "z", "n", (share * (100.0 if percent else 1.0)).alias("frequency"))


def packed(series: DataFrame, key: str = "node_id", level: str = "level") -> DataFrame:
    """key, levels: the sorted finite levels of each key as array<float>."""
    return series.groupBy(key).agg(F.array_sort(F.collect_list(finite(F.col(level).cast("float")))).alias("levels"))


def packed_frequency(levels: Column, z: Column, percent: bool = True) -> Column:
    """The same from a packed array: for a few heights a key. A raster's pixels go through plans.blocks, which searches the array."""
    share = F.size(F.filter(levels, lambda x: x > z)) / F.nullif(F.size(levels), F.lit(0))
    return F.when(z.isNotNull(), share * (100.0 if percent else 1.0))


def extremes(series: DataFrame, key: str = "node_id", level: str = "level") -> DataFrame:
    """key, high, low, range of the finite levels; null where there is none."""
    h = finite(F.col(level))
    return series.groupBy(key).agg(F.max(h).alias("high"), F.min(h).alias("low"), (F.max(h) - F.min(h)).alias("range"))


def empirical_rank(series: DataFrame, key: str, level: str, order: str) -> DataFrame:
    """Share of the finite levels of the key that are above each of them."""
    from pyspark.sql.window import Window

    return series.where(finite(F.col(level)).isNotNull()).select(key, order, level, (1.0 - F.cume_dist().over(Window.partitionBy(key).orderBy(level))).alias("share_above"))

"""Tide series of points and tables of points."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shoreline.functions import geo, timegrid
from shoreline.functions.tide import Harmonic, TideModel
from shoreline.operators import datum


def series(spark: SparkSession, model: Harmonic, node_id: int, lon: float, lat: float, start: datetime, end: datetime, freq: str, inclusive: str = "both", tz: str = "UTC", target: str = "msl", heights: DataFrame | None = None) -> DataFrame:
    """datetime_utc, longitude, latitude, short-period, long-period and total tide in cm, total in m and its flag, and the height columns of the
    target. heights: one row with mdt_m, delta_n_m, n_egm2008_m and geoid of the place, which targets but msl need."""
    times = timegrid.time_grid(spark, start, end, freq, inclusive, tz)
    point = spark.createDataFrame([(node_id, float(lon), float(lat))], "node_id long, lon double, lat double")
    if datum.target_of(target) != "msl" and heights is None:
        raise ValueError(f"target {target} needs the place's heights")
    total = F.col("short_cm") + F.col("long_cm")
    out = model.parts(point, times).select(F.col("t").alias("datetime_utc"), F.lit(lon).alias("longitude"), F.lit(lat).alias("latitude"), F.col("short_cm").alias("tide_short_period_cm"), F.col("long_cm").alias("tide_long_period_cm"), total.alias("tide_total_cm"), (total / 100.0).alias("tide_total_m"), total.isNotNull().cast("int").alias("quality_flag"))
    known = ["mdt_m", "delta_n_m", "n_egm2008_m", "geoid"]
    if heights is None:
        return out.withColumn("tide_msl_m", F.col("tide_total_m"))
    return datum.convert(out.crossJoin(F.broadcast(heights.select(*known).limit(1))), target, "tide_total_m").drop(*known)


def year(spark: SparkSession, model: Harmonic, node_id: int, lon: float, lat: float, y: int, freq: str = "30min") -> DataFrame:
    return series(spark, model, node_id, lon, lat, datetime(y, 1, 1), datetime(y + 1, 1, 1), freq, "left")


def points_period(nodes: DataFrame, times: DataFrame, model: TideModel) -> DataFrame:
    """node_id, t, level, flag of every node at every time."""
    return model.levels(nodes, times)


def points_at_time(nodes: DataFrame, model: TideModel, at: datetime) -> DataFrame:
    """node_id, t, level, flag of every node at one time (naive: UTC)."""
    t = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    one = nodes.sparkSession.createDataFrame([(t.timestamp(),)], "s double").select(F.timestamp_seconds("s").alias("t"))
    return model.levels(nodes, one)


def joined_in_time(parts: list[DataFrame]) -> DataFrame:
    """Levels of successive time slices as one table; a sample that two slices have is there once."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["node_id", "t"])


class Counted:
    """A model that counts its calls, and observes how many nodes and samples it gave and how many were finite (`last`, after an action)."""

    def __init__(self, model: TideModel):
        self.model, self.calls, self.last = model, 0, None

    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        self.calls += 1
        self.last = Observation(f"levels-{self.calls}-{uuid.uuid4().hex}")
        return self.model.levels(nodes, times).observe(self.last, F.count("*").alias("samples"), F.count_if(F.col("level").isNotNull()).alias("finite"))


@contextmanager
def scope(*frames: DataFrame):
    """Keeps tables in memory for as long as a block runs, however it ends; scopes may be nested."""
    held = [f.persist() for f in frames]
    try:
        yield held if len(held) != 1 else held[0]
    finally:
        for f in held:
            f.unpersist()


def batch(points: DataFrame, level, lon: str, lat: str, time: str, seas: DataFrame | None = None) -> DataFrame:
    """A table of points with any columns, each with its own time (UTC): keeps them all and adds datetime_utc, tide_total_m,
    quality_flag and qc_warning; a row with a bad coordinate or time has no level and says so. With the closed seas' edges, reference_geoid too, and
    qc_warning names an approximate one. Rows are grouped by 5-degree chunk."""
    x, y, t = F.col(lon).try_cast("double"), F.col(lat).try_cast("double"), F.col(time).try_cast("timestamp")
    ok = geo.valid_coordinate(x, y) & t.isNotNull()
    h = F.when(ok, level(timegrid.seconds(t), geo.normalize_longitude(x), y))
    warn = F.when(~F.coalesce(geo.valid_coordinate(x, y), F.lit(False)), "QC_COORDINATE_INVALID").when(t.isNull(), "QC_TIME_INVALID").otherwise("NORMAL")
    out = points.withColumns({"datetime_utc": t, "tide_total_m": h, "quality_flag": h.isNotNull().cast("int"), "qc_warning": warn})
    if seas is not None:
        out = out.withColumn("_row", F.monotonically_increasing_id())
        g = datum.geoid_of_points(out.select("_row", x.alias("lon"), y.alias("lat")), seas, "_row")
        out = out.join(g, "_row").drop("_row").withColumn("qc_warning", F.when(F.col("qc_warning") == "NORMAL", F.col("quality")).otherwise(F.col("qc_warning"))).withColumnRenamed("geoid", "reference_geoid").drop("quality")
    return out.repartition(F.coalesce(geo.chunk_key(geo.normalize_longitude(x), y), F.lit(-1)))

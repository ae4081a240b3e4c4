"""Runs over one raster: control grid to cache bundle, and products from a bundle or straight from the tide model.

Times are naive UTC datetimes; a window is half-open unless it says otherwise.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions import qc, timegrid
from shoreline.functions.tide import TideModel
from shoreline.operators import frequency, metrics, topology
from shoreline.plans import blocks, control
from shoreline.plans.control import Settings
from shoreline.sources import bundle
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import scratch


@dataclass(frozen=True)
class Window:
    """The samples of a run."""

    start: datetime
    end: datetime
    freq: str = "30min"
    inclusive: str = "left"

    def times(self, spark: SparkSession) -> DataFrame:
        return timegrid.time_grid(spark, self.start, self.end, self.freq, self.inclusive)

    def seconds(self) -> tuple[float, float]:
        return tuple(t.replace(tzinfo=timezone.utc).timestamp() for t in (self.start, self.end))

    def tags(self) -> dict:
        a, b = self.seconds()
        n = timegrid.samples_in(self.start, self.end, self.freq, True)
        whole = (b - a) % timegrid.step_seconds(self.freq) == 0
        n -= (self.inclusive in ("left", "neither") and whole) + (self.inclusive in ("right", "neither"))
        return {"start": self.start.isoformat(), "end": self.end.isoformat(), "start_epoch": a, "end_epoch": b, "freq": self.freq, "step_s": timegrid.step_seconds(self.freq), "inclusive": self.inclusive, "time_samples": n}


def expected_tags(frame: Frame, window: Window, settings: Settings, datum: str = "msl", constituents="all", size: int = 0, modified: int = 0) -> dict:
    """What a bundle for this run must say."""
    return frame.tags() | window.tags() | settings.tags() | {"dem_datum": datum.lower(), "constituents": str(constituents).lower(), "dem_bytes": size, "dem_mtime": modified}


def build_cache(path: str, pixels: DataFrame, frame: Frame, model: TideModel, window: Window, settings: Settings = Settings(), offset=None, overwrite: bool = False, **tags) -> dict:
    """Stage 1: the control grid of a raster with its levels and those at the window's end, as a bundle. Gives its tags."""
    spark = pixels.sparkSession
    if not overwrite and bundle.exists(spark, path):
        raise bundle.ExistingOutput(path)
    grid = control.control_grid(pixels, frame, model, window.times(spark), settings, offset)
    nodes = grid["nodes"].drop("levels")
    end = spark.createDataFrame([(window.seconds()[1],)], "s double").select(F.timestamp_seconds("s").alias("t"))
    terminal = model.levels(nodes.select("node_id", "lon", "lat"), end).select("node_id", "level")
    all_tags = expected_tags(frame, window, settings, **tags) | {"nodes": grid["node_count"], "cells": grid["cells"].count()}
    bundle.write_bundle(path, nodes, grid["cells"], grid["tide"].select("node_id", "t", F.col("level").cast("float").alias("level")), all_tags, terminal, overwrite)
    return bundle.tags_of(spark, path)


def _opened(spark: SparkSession, path: str, frame: Frame) -> tuple[dict, dict]:
    """The parts and tags of a complete bundle that fits the raster; every reason against it is named."""
    tags = bundle.tags_of(spark, path)
    if why := bundle.incompatible(frame.tags(), tags):
        raise ValueError(f"{path} doesn't belong to this raster: {'; '.join(why)}")
    return bundle.read_bundle(spark, path), tags


def _water(parts: dict, name: str) -> DataFrame:
    """Levels with the nodes' offsets."""
    off = parts["nodes"].where("valid").select("node_id", F.col("offset").cast("float").alias("offset"))
    return parts[name].join(off, "node_id").withColumn("level", (F.col("level") + F.col("offset")).cast("float")).drop("offset")


def _placed(pixels: DataFrame, frame: Frame, cells: DataFrame, nodes: DataFrame, settings: Settings, components=None, factor=None) -> DataFrame:
    if components is None:
        _, components, factor = control.support(pixels, frame, settings)
    p = control.with_component(frame.centers(pixels.where(F.col("z").isNotNull())), components, factor)
    p = p.withColumn("pixel", F.col("row").cast("long") * frame.width + F.col("col"))
    _, _, east, north = frame.bounds
    bucket = max(frame.steps(settings.least_m))
    return blocks.placed(p, cells, nodes, "pixel", east, north, bucket)


def _whole(pixels: DataFrame, frame: Frame, found: DataFrame, none_qc: int) -> DataFrame:
    """A row for every pixel of the raster: one without height has no value and the nodata bits."""
    key = (F.col("row").cast("long") * frame.width + F.col("col")).alias("pixel")
    j = pixels.select("row", "col", "z", key).join(found, "pixel", "left")
    return j.withColumn("qc", F.when(F.col("z").isNull(), none_qc).otherwise(F.coalesce("qc", F.lit(qc.INSUFFICIENT | qc.CONNECTIVITY)))).drop("pixel", "z")


def _settings(tags: dict) -> Settings:
    return Settings(float(tags["initial_spacing_m"]), float(tags["min_spacing_m"]), float(tags["tolerance_pct"]), tags["target_mode"], float(tags["topology_resolution_m"]), float(tags["topology_fraction"]))


def inundation_from_cache(pixels: DataFrame, frame: Frame, path: str) -> DataFrame:
    """Stage 2: row, col, frequency (percent), qc of every pixel, from a bundle and without the tide model."""
    parts, tags = _opened(pixels.sparkSession, path, frame)
    rows = _placed(pixels, frame, parts["cells"], parts["nodes"], _settings(tags))
    return _whole(pixels, frame, blocks.frequencies(parts["cells"], rows, _water(parts, "tide"), "pixel"), qc.NODATA)


def inundation(pixels: DataFrame, frame: Frame, model: TideModel, window: Window, settings: Settings = Settings(), offset=None) -> DataFrame:
    """The same straight from the tide model: control grid, then pixels."""
    return inundation_of(control.control_grid(pixels, frame, model, window.times(pixels.sparkSession), settings, offset), pixels, frame, settings)


def inundation_of(grid: dict, pixels: DataFrame, frame: Frame, settings: Settings) -> DataFrame:
    """The same from a control grid that is there."""
    rows = _placed(pixels, frame, grid["cells"], grid["nodes"], settings, grid["components"], grid["factor"])
    return _whole(pixels, frame, blocks.frequencies(grid["cells"], rows, _water(grid, "tide"), "pixel"), qc.NODATA)


def exposure_from_cache(pixels: DataFrame, frame: Frame, path: str) -> DataFrame:
    """Stage 2: row, col, the six measures and qc of every pixel. The bundle's window must be half-open."""
    parts, tags = _opened(pixels.sparkSession, path, frame)
    if tags.get("inclusive", "left") != "left":
        raise ValueError(f"{path}: exposure takes a half-open window [start, end), not {timegrid.interval_semantics(tags['inclusive'])}")
    rows = _placed(pixels, frame, parts["cells"], parts["nodes"], _settings(tags))
    start, end = float(tags["start_epoch"]), float(tags["end_epoch"])
    closing = _water(parts, "terminal") if "terminal" in parts else None
    found = blocks.exposures(parts["cells"], rows, _water(parts, "tide"), "pixel", (start, end), closing, end if closing is not None else None)
    return _whole(pixels, frame, found, qc.NODATA).withColumn("qc", F.when(F.col("qc") == (qc.INSUFFICIENT | qc.CONNECTIVITY), qc.X_INSUFFICIENT).otherwise(F.col("qc")))


def exposure(pixels: DataFrame, frame: Frame, model: TideModel, window: Window, settings: Settings = Settings(), offset=None) -> DataFrame:
    """Both stages over a bundle in the shared folder, which goes with the session."""
    path = scratch(pixels.sparkSession, f"cache-{uuid.uuid4().hex}")
    build_cache(path, pixels, frame, model, window, settings, offset)
    return exposure_from_cache(pixels, frame, path)


def snapshot(pixels: DataFrame, frame: Frame, model: TideModel, at: datetime, offset=None) -> DataFrame:
    """row, col, water, qc of every pixel at one time: the model's level there and the static offset."""
    spark = pixels.sparkSession
    p = frame.centers(pixels.where(F.col("z").isNotNull())).withColumn("node_id", F.col("row").cast("long") * frame.width + F.col("col"))
    lon, lat = frame.lonlat(F.col("x"), F.col("y"))
    p = p.select("node_id", lon.alias("lon"), lat.alias("lat"))
    t = spark.createDataFrame([(at.replace(tzinfo=timezone.utc).timestamp(),)], "s double").select(F.timestamp_seconds("s").alias("t"))
    off = p.select("node_id", F.lit(0.0).alias("offset"), F.lit(False).alias("approx")) if offset is None else offset(p)
    j = model.levels(p, t).join(off.select("node_id", frequency.finite(F.col("offset").cast("double")).alias("offset"), "approx"), "node_id", "left")
    h, bit = frequency.finite(F.col("level")), lambda c, b: F.when(c, b).otherwise(0)
    bits = bit((F.col("flag") == 0) | h.isNull(), qc.INSUFFICIENT).bitwiseOR(bit(F.col("flag") < 0, qc.EXTRAPOLATED)).bitwiseOR(bit(F.col("offset").isNull(), qc.DATUM_INVALID)).bitwiseOR(bit(F.coalesce("approx", F.lit(False)), qc.DATUM_APPROX))
    return _whole(pixels, frame, j.select(F.col("node_id").alias("pixel"), (h + F.col("offset")).cast("float").alias("water"), bits.alias("qc")), qc.NODATA)


def at_centre(pixels: DataFrame, frame: Frame, model: TideModel, window: Window) -> DataFrame:
    """row, col, frequency of every pixel as if the tide of the raster's centre held everywhere."""
    west, south, east, north = frame.bounds
    spark = pixels.sparkSession
    lon, lat = frame.lonlat(F.lit((west + east) / 2), F.lit((south + north) / 2))
    point = spark.range(1).select(F.lit(0).cast("long").alias("node_id"), lon.alias("lon"), lat.alias("lat"))
    levels = frequency.packed(model.levels(point, window.times(spark)), "node_id", "level").first()
    import numpy as np
    import pyarrow as pa

    series = spark.sparkContext.broadcast(np.array(levels["levels"] if levels else [], np.float32))

    def run(batches):
        for b in batches:
            z, n = b.column(2).to_numpy(zero_copy_only=False).astype(float), len(series.value)
            f = (n - np.searchsorted(series.value, z, "right")) * 100.0 / n if n else np.full(len(z), np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, mask=np.isnan(f) | np.isnan(z))], names=["row", "col", "frequency"])

    return pixels.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("z").cast("double")).mapInArrow(run, "row int, col int, frequency double")


def direct_sample(pixels: DataFrame, frame: Frame, model: TideModel, window: Window, n: int, seed: int = 42) -> DataFrame:
    """pixel, frequency of n pixels chosen by a hash, each with the model's own series: what an interpolated product is held against."""
    spark = pixels.sparkSession
    p = metrics.seeded_sample(frame.centers(pixels.where(F.col("z").isNotNull())), n, seed, "row", "col")
    lon, lat = frame.lonlat(F.col("x"), F.col("y"))
    p = p.select((F.col("row").cast("long") * frame.width + F.col("col")).alias("node_id"), "z", lon.alias("lon"), lat.alias("lat"))
    tide = model.levels(p.select("node_id", "lon", "lat"), window.times(spark))
    return frequency.frequency(tide, p.select("node_id", "z"), "node_id", "level").select(F.col("node_id").alias("pixel"), "frequency")


def node_diagnosis(grid: dict, mdt: Column, delta_n: Column, offset: Column) -> DataFrame:
    """node_id, class, low, high (levels of the cells at it) of a control grid's nodes; the three inputs are expressions on a node."""
    cls = metrics.support_class(F.size("levels") > 0, mdt, delta_n, offset)
    return grid["nodes"].select("node_id", cls.alias("class")).join(metrics.incident_levels(grid["nodes"], grid["cells"]), "node_id")


def topology_of(pixels: DataFrame, frame: Frame, settings: Settings) -> DataFrame:
    """r, c, valid_n, total_n, fraction of a raster's support topology."""
    factor = topology.coarse_factor(settings.topology_m, max(1e-3, frame.pixel_m()))
    return topology.downsample(pixels, factor, frame.height, frame.width)

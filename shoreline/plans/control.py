"""The control grid of a raster: macro cells refined level by level until the frequencies of their pixels can be interpolated.

Every level is one set of jobs over all its cells; the driver counts levels and nodes and holds no rows. A node is named by its coordinates, so
that cells share it, and is evaluated once, by the model, for the whole time axis. Levels of cells, nodes and series are written tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions import geo, qc
from shoreline.functions.tide import TideModel
from shoreline.operators import frequency, quadtree, topology
from shoreline.plans.blocks import _arrays
from shoreline.plans.pyramid import pyramid
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import freed, stored

#: Modes of refinement, and the most nodes (unless settings say otherwise) and levels of one raster.
MODES, MAX_NODES, MAX_DEPTH = ("standard", "intertidal"), 50_000, 12


BOUNDS, PATH = ("x_min", "y_min", "x_max", "y_max"), ("mr", "mc", "pr", "pc")


class TooManyNodes(RuntimeError):
    pass


@dataclass(frozen=True)
class Settings:
    """Spacings in metres, tolerance in percentage points, resolution and least valid share of the support topology. More than max_nodes nodes are an
    error; None sets no limit: nodes are written tables, and no process holds them all."""

    initial_m: float = 4000.0
    least_m: float = 500.0
    tolerance: float = 1.0
    mode: str = "standard"
    topology_m: float = 200.0
    fraction: float = 0.20
    max_nodes: int | None = MAX_NODES

    def tags(self) -> dict:
        return {"initial_spacing_m": self.initial_m, "min_spacing_m": self.least_m, "tolerance_pct": self.tolerance, "target_mode": self.mode, "topology_resolution_m": self.topology_m, "topology_fraction": self.fraction}


def support(pixels: DataFrame, frame: Frame, settings: Settings) -> tuple[DataFrame, DataFrame, int]:
    """Coarse cells with any height (r, c), components of those that are valid enough (r, c, component, from 1), and pixels a coarse cell."""
    factor = topology.coarse_factor(settings.topology_m, max(1e-3, frame.pixel_m()))
    coarse = stored(topology.downsample(pixels, factor, frame.height, frame.width).where("valid_n > 0"), "coarse")
    named = topology.components(coarse.where(F.col("fraction") >= settings.fraction).select("r", "c"))
    return coarse.select("r", "c"), stored(named.withColumn("component", F.col("component") + 1), "components"), factor


def coarse_cell(frame: Frame, factor: int, x: Column, y: Column) -> tuple[Column, Column]:
    """r, c of the coarse cell at a point, the nearest one for points outside."""
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(math.ceil(n / factor) - 1), F.floor(v / factor))).cast("long")
    return clip((y - frame.y0) / frame.dy, frame.height), clip((x - frame.x0) / frame.dx, frame.width)


def with_component(pixels: DataFrame, components: DataFrame, factor: int) -> DataFrame:
    """pixels with the component of their coarse cell, 0 where it has none."""
    at = pixels.withColumns({"r": F.floor(F.col("row") / factor).cast("long"), "c": F.floor(F.col("col") / factor).cast("long")})
    return at.join(components.select("r", "c", "component"), ["r", "c"], "left").withColumn("component", F.coalesce("component", F.lit(0))).drop("r", "c")


def macro_cells(spark, frame: Frame, active: DataFrame, settings: Settings, factor: int) -> DataFrame:
    """The first cells: those that overlap a coarse cell with heights, or all if none does."""
    west, south, east, north = frame.bounds
    cells = quadtree.initial_cells(spark, west, south, east, north, *frame.steps(settings.initial_m))
    rows = [(F.col(c) - frame.y0) / frame.dy for c in ("y_min", "y_max")]
    cols = [(F.col(c) - frame.x0) / frame.dx for c in ("x_min", "x_max")]

    def span(pair, n):
        last = math.ceil(n / factor)
        low = F.greatest(F.lit(0), F.least(F.lit(last - 1), F.floor(F.least(*pair) / factor)))
        high = F.greatest(F.lit(0), F.least(F.lit(last), F.floor(F.greatest(*pair) / factor) + 1))
        return low.cast("long"), high.cast("long")

    (r0, r1), (c0, c1) = span(rows, frame.height), span(cols, frame.width)
    cells = stored(cells.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1}), "macro")
    each = cells.where("r1 > r0 and c1 > c0").withColumn("r", F.explode(F.sequence("r0", F.col("r1") - 1))).withColumn("c", F.explode(F.sequence("c0", F.col("c1") - 1)))
    some = each.join(active, ["r", "c"], "left_semi").select("x_min", "y_min").distinct()
    kept = cells.join(some, ["x_min", "y_min"], "left_semi")
    (sx, sy), zero = frame.steps(settings.initial_m), F.lit(0)
    named = {"mr": F.rint((F.col("y_min") - south) / sy).cast("int"), "mc": F.rint((F.col("x_min") - west) / sx).cast("int"), "pr": zero, "pc": zero}
    return (cells if kept.isEmpty() else kept).select(*BOUNDS, "level").withColumns(named)


def node_id(x: Column, y: Column, projected: bool) -> Column:
    """A number for a node: its coordinates to 1 cm or 1e-6 degrees."""
    k = 100.0 if projected else 1e6
    return F.rint(x * k).cast("long") * (1 << 32) + F.rint(y * k).cast("long") + (1 << 31)


def _points(cells: DataFrame, places: list, projected: bool) -> DataFrame:
    """cell, place, x, y, node_id of some places of every cell."""
    at = F.array(*(F.struct(F.lit(k).alias("place"), x.alias("x"), y.alias("y")) for k, x, y in places))
    return cells.select("cell", F.explode(at).alias("p")).select("cell", "p.*").withColumn("node_id", node_id(F.col("x"), F.col("y"), projected))


class Nodes:
    """The nodes evaluated so far: written tables of nodes (with their sorted water levels) and of their series."""

    def __init__(self, frame: Frame, model: TideModel, times: DataFrame, components: DataFrame, factor: int, settings: Settings, offset=None):
        self.frame, self.model, self.times, self.components, self.factor, self.settings, self.offset = frame, model, times, components, factor, settings, offset
        self.tables, self.series, self.count = [], [], 0

    def evaluate(self, points: DataFrame) -> None:
        """Evaluates the points that aren't nodes yet."""
        new = points.groupBy("node_id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
        if self.tables:
            new = new.join(self.all().select("node_id"), "node_id", "left_anti")
        lon, lat = self.frame.lonlat(F.col("x"), F.col("y"))
        r, c = coarse_cell(self.frame, self.factor, F.col("x"), F.col("y"))
        new = stored(new.withColumns({"lon": lon, "lat": lat, "r": r, "c": c}), "new-nodes")
        n = new.count()
        if not n:
            return freed(new)
        if self.settings.max_nodes is not None and self.count + n > self.settings.max_nodes:
            raise TooManyNodes(f"{self.count} nodes and {n} more are over the limit of {self.settings.max_nodes}: take wider spacings, a larger tolerance, a smaller raster or a higher limit")
        self.count += n
        series = stored(self.model.levels(new.select("node_id", "lon", "lat"), self.times).select("node_id", "t", "level", "flag"), "node-levels")
        own = topology.node_component(new.select("node_id", "r", "c"), self.components)
        static = new.select("node_id", F.lit(0.0).alias("offset"), F.lit(False).alias("approx")) if self.offset is None else self.offset(new.select("node_id", "lon", "lat")).select("node_id", "offset", "approx")
        static = static.withColumn("offset", frequency.finite(F.col("offset").cast("double")))
        water = series.join(static.select("node_id", "offset"), "node_id").withColumn("level", (F.col("level") + F.col("offset")).cast("float"))
        levels = frequency.packed(water, "node_id", "level").join(series.groupBy("node_id").agg(F.min("flag").alias("flag")), "node_id")
        out = new.join(own, "node_id").join(static, "node_id").join(levels, "node_id", "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<float>")))
        valid = F.size("levels") > 0
        bits = [(~valid, qc.INSUFFICIENT), (F.coalesce(F.col("flag"), F.lit(0)) < 0, qc.EXTRAPOLATED), (F.coalesce("approx", F.lit(False)), qc.DATUM_APPROX), (F.col("offset").isNull(), qc.DATUM_INVALID)]
        mask = reduce(Column.bitwiseOR, [F.when(c, b).otherwise(0) for c, b in bits])
        out = out.select("node_id", "x", "y", "lon", "lat", F.col("component_id").cast("long").alias("component_id"), valid.alias("valid"), mask.alias("qc"), F.coalesce("offset", F.lit(0.0)).alias("offset"), F.coalesce("flag", F.lit(0)).alias("flag"), "levels")
        self.tables.append(stored(out, "nodes"))
        self.series.append(series)
        freed(new)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)

    def tide(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.series)


def _errors(rows: DataFrame) -> DataFrame:
    """cell, error in percentage points. rows: cell, heights, levels (arrays of the valid corners' levels), middle (of the centre's; empty if not valid)."""

    def run(batches):
        for b in batches:
            out, z = [], _arrays_of(b.column(1))
            middle = _arrays_of(b.column(3))
            for h, corners, mid in zip(z, _arrays(b.column(2)), middle, strict=True):
                f = np.array([100.0 * (len(c) - np.searchsorted(c, h, "right")) / len(c) for c in corners]).reshape(len(corners), len(h))
                if len(mid):
                    out.append(float(np.abs(100.0 * (len(mid) - np.searchsorted(mid, h, "right")) / len(mid) - f.mean(0)).max()) if len(f) else 0.0)
                else:
                    out.append(float((f.max(0) - f.min(0)).max()) if len(f) > 1 else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["cell", "error"])

    return rows.select("cell", "heights", "levels", "middle").mapInArrow(run, "cell long, error double")


def _arrays_of(column: pa.Array) -> list[np.ndarray]:
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:z] for a, z in zip(at, at[1:], strict=False)]


def control_grid(pixels: DataFrame, frame: Frame, model: TideModel, times: DataFrame, settings: Settings = Settings(), offset=None) -> dict:
    """nodes (node_id, x, y, lon, lat, component_id, valid, qc, offset, flag, levels), cells (cell_id, bounds, level, error, corners, cell_qc) and tide
    (node_id, t, level without offset, flag) of a raster; components (r, c, component) and factor of its support topology.

    pixels: row, col, z (null where there is no height). offset(nodes) gives node_id, offset (null where unknown) and approx. A cell splits where the
    frequency at its pixels' test heights can't be told from its corners within the tolerance, where nodes with and without water meet or lie in different
    components (mode standard), or where corners lie in two components or none has water but its inside or edges do (intertidal)."""
    if settings.mode not in MODES:
        raise ValueError(f"unknown mode {settings.mode!r}")
    spark = pixels.sparkSession
    active, components, factor = support(pixels, frame, settings)
    nodes = Nodes(frame, model, times, components, factor, settings, offset)
    depth = min(math.ceil(math.log2(max(1.0, settings.initial_m / max(1.0, settings.least_m)))), MAX_DEPTH)
    least = settings.least_m / (frame.factor if frame.projected else geo.DEGREE_M)
    cells, leaves = macro_cells(spark, frame, active, settings, factor), []
    corner = [("x_min", "y_min"), ("x_max", "y_min"), ("x_min", "y_max"), ("x_max", "y_max")]
    mx, my = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    five = [*((k, F.col(x), F.col(y)) for k, (x, y) in enumerate(corner)), (4, mx, my)]
    edges = [(5, mx, F.col("y_min")), (6, mx, F.col("y_max")), (7, F.col("x_min"), my), (8, F.col("x_max"), my)]
    every = pyramid(pixels, frame, frame.steps(settings.initial_m), depth)
    for level in range(depth + 1):
        cells = stored(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
        if cells.isEmpty():
            break
        points = stored(_points(cells, five, frame.projected), "points")
        nodes.evaluate(points)
        flags = lambda: nodes.all().select("node_id", "valid", "component_id")
        dry = points.join(flags(), "node_id").groupBy("cell").agg(F.bool_or("valid").alias("any")).where("not any").select("cell")
        probes = stored(_points(cells.join(dry, "cell", "left_semi"), edges, frame.projected), "probes")
        if not probes.isEmpty():
            nodes.evaluate(probes)
        wet = probes.join(flags(), "node_id").groupBy("cell").agg(F.bool_or("valid").alias("probe"))
        of = points.join(nodes.all().select("node_id", "valid", "component_id", "levels"), "node_id")
        at = F.col("place") < 4
        known = of.groupBy("cell").agg(F.count_if(at & F.col("valid")).alias("wet"), F.bool_or(~at & F.col("valid")).alias("mid"), F.size(F.collect_set(F.when(at & F.col("valid") & (F.col("component_id") > 0), F.col("component_id")))).alias("parts"), F.collect_list(F.when(at & F.col("valid"), F.col("levels"))).alias("levels"), F.coalesce(F.first(F.when(~at & F.col("valid"), F.col("levels")), ignorenulls=True), F.array().cast("array<float>")).alias("middle"))
        heights = stored(cells.select("cell", *PATH).join(every.where(F.col("level") == level).drop("level"), list(PATH)).select("cell", "heights"), "heights")
        error = _errors(heights.join(known, "cell"))
        j = cells.join(known.drop("levels", "middle"), "cell").join(wet, "cell", "left").join(heights.select("cell", F.lit(True).alias("any")), "cell", "left").join(error, "cell", "left")
        probe, conflict = F.coalesce("probe", F.lit(False)), F.col("parts") > 1
        broken = ((F.col("wet") > 0) & (F.col("wet") < 4)) | ((F.col("wet") == 4) != F.col("mid")) | probe | conflict
        error = F.coalesce("error", F.lit(0.0))
        want = quadtree.wants_split(error, settings.tolerance, F.col("wet"), F.col("mid"), probe, conflict, settings.mode == "intertidal")
        some = F.coalesce("any", F.lit(False))
        room = F.least(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) / 2 >= least - 1e-6
        j = stored(j.select(*BOUNDS, *PATH, "level", F.when(some, error).otherwise(0.0).alias("error"), (some & want).alias("want"), room.alias("room"), (some & broken).alias("broken")), "judged")
        split = F.col("want") & F.col("room") & F.lit(level < depth)
        bits = [(F.col("want") & ~F.col("room"), qc.MIN_SPACING), (F.col("want") & F.col("room"), qc.MAX_REFINEMENT), (F.col("broken"), qc.VALIDITY_BOUNDARY)]
        leaf = j.where(~split).withColumn("cell_qc", reduce(Column.bitwiseOR, [F.when(c, b).otherwise(0) for c, b in bits]))
        leaves.append(leaf.drop("want", "room", "broken", *PATH))
        quarters = quadtree.children(j.where(split).select(*BOUNDS, *PATH, "level"))
        half = {"pr": F.col("pr") * 2 + F.expr("quarter div 2").cast("int"), "pc": F.col("pc") * 2 + F.col("quarter") % 2}
        cells = quarters.withColumns(half).select(*BOUNDS, "level", *PATH)
        freed(points, probes, heights)
    freed(every)
    out = reduce(DataFrame.unionByName, leaves)
    ids = [node_id(F.col(x), F.col(y), frame.projected) for x, y in corner]
    out = out.withColumns({"cell_id": ids[0], "corners": F.array(*ids)})
    return {"nodes": nodes.all(), "cells": out, "tide": nodes.tide(), "components": components, "factor": factor, "node_count": nodes.count}

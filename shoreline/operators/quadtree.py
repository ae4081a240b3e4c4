"""Cells of a quadtree: macro cells, children, and the rules of refinement as expressions; plans.control refines a raster's grid."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


MAX_DEPTH = 12


def depth_cap(initial: float, least: float, most: int = MAX_DEPTH) -> int:
    return max(0, min(math.ceil(math.log2(initial / least)), most))


def initial_cells(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, step_x: float, step_y: float) -> DataFrame:
    """Macro cells from (x0, y0) until the bounds are covered."""
    nx, ny = max(1, math.ceil((x1 - x0) / step_x - 1e-9)), max(1, math.ceil((y1 - y0) / step_y - 1e-9))
    ij = spark.range(nx).select(F.col("id").alias("i")).crossJoin(F.broadcast(spark.range(ny).select(F.col("id").alias("j"))))
    at = lambda a, k, s: F.lit(a) + k * F.lit(s)
    return ij.select(at(x0, F.col("i"), step_x).alias("x_min"), at(y0, F.col("j"), step_y).alias("y_min"), at(x0, F.col("i") + 1, step_x).alias("x_max"), at(y0, F.col("j") + 1, step_y).alias("y_max"), F.lit(0).alias("level"))


def children(cells: DataFrame) -> DataFrame:
    """The four quarters of every cell, in the order of its corners."""
    mx, my = (F.col("x_min") + F.col("x_max")) / 2, (F.col("y_min") + F.col("y_max")) / 2
    q = [(F.col("x_min"), F.col("y_min"), mx, my), (mx, F.col("y_min"), F.col("x_max"), my), (F.col("x_min"), my, mx, F.col("y_max")), (mx, my, F.col("x_max"), F.col("y_max"))]
    four = F.array(*(F.struct(F.lit(k).alias("quarter"), a.alias("x_min"), b.alias("y_min"), c.alias("x_max"), d.alias("y_max")) for k, (a, b, c, d) in enumerate(q)))
    keep = [c for c in cells.columns if c not in ("x_min", "y_min", "x_max", "y_max", "level", "quarter")]
    return cells.select(*keep, (F.col("level") + 1).alias("level"), F.explode(four).alias("q")).select(*keep, "level", "q.*")


def cell_error(corners: Column, centre: Column) -> Column:
    """Percentage points: |centre - mean of the valid corners|, else the largest difference of two valid corners, else 0."""
    ok = F.filter(corners, lambda x: x.isNotNull())
    mean = F.aggregate(ok, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(ok), F.lit(0))
    spread = F.when(F.size(ok) >= 2, F.array_max(ok) - F.array_min(ok)).otherwise(0.0)
    return F.when(centre.isNotNull() & (F.size(ok) > 0), F.abs(centre - mean)).otherwise(spread)


def wants_split(error: Column, tolerance: float, corners_valid: Column, centre_valid: Column, probe_valid: Column, conflict: Column, intertidal: bool = False) -> Column:
    """corners_valid: how many of four. conflict: corners lie in two components."""
    mixed = (corners_valid > 0) & (corners_valid < 4)
    broken = mixed | ((corners_valid == 4) != centre_valid) | probe_valid | conflict
    if intertidal:
        return conflict | (error > tolerance) | ((corners_valid == 0) & (centre_valid | probe_valid))
    return (error > tolerance) | broken

"""Exposure in its long form, snapshots and seams of rasters, and checks of products. plans.blocks has the forms for whole rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.functions import qc, timegrid
from shoreline.operators import cells as cell_ops
from shoreline.operators import exposure, metrics


def exposure_long(corners: DataFrame, pixels: DataFrame, tide: DataFrame, key: str) -> DataFrame:
    """Exposure of pixels with one row for each pixel and time: for stations and checks."""
    level = cell_ops.blend_levels(corners, tide, key).join(pixels.select(key, "z"), key)
    return exposure.metrics(level.select(key, timegrid.seconds(F.col("t")).alias("t"), F.col("level").alias("h"), "z"), key)


def snapshot(points: DataFrame, key: str, at, level) -> DataFrame:
    """key, water at one time: tide and static offset."""
    t = F.lit(float(timegrid.localize(at, "UTC").timestamp()))
    return points.select(key, (level(t, F.col("lon"), F.col("lat")) + F.col("offset")).alias("water"))


def seam(left: DataFrame, right: DataFrame, whole: DataFrame, column: int) -> DataFrame:
    """n, mae, p95, p99, worst of two tiles put together against the whole, over pixels where both are finite, the 95th percentile of the step across their
    seam, and status (fixed values); figures of no pixels are 0."""
    t = left.select("row", "col", "z").unionByName(right.select("row", "col", "z"))
    e = metrics.errors(metrics.aligned(t, whole, ["row", "col"], "z"), "a", "b")
    a, b = (t.where(F.col("col") == c).select("row", F.col("z").alias(n)) for c, n in ((column - 1, "p"), (column, "q")))
    step = metrics.errors(a.join(b, "row"), "p", "q").select(F.col("p95").alias("seam_p95"))
    out = e.select("n", "mae", "p95", "p99", "worst").crossJoin(F.broadcast(step)).na.fill(0.0)
    good, fair = (F.col("p95") <= 1) & (F.col("worst") <= 10), (F.col("p95") <= 2) & (F.col("worst") <= 10)
    return out.withColumn("status", F.when(good, "PASS").when(fair, "BETA_ACCEPTABLE").otherwise("INVESTIGATE"))


#: Why a pixel has no solution.
CAUSES = ("Q68_NO_FES_SUPPORT", "Q68_DATUM_SUPPORT_FAILURE", "Q68_MIXED_FES_AND_DATUM", "Q68_TOPOLOGY_REJECTED", "Q68_OTHER")


def attribute(pixels: DataFrame, cells: DataFrame, classes: DataFrame) -> DataFrame:
    """cause, n, percent of the pixels whose qc is 68, for all five causes. pixels: cell_id (null for none) and qc; classes: node_id and class
    (metrics.support_class). The cause is that of the cell: four nodes without tide, four without topography, none complete, or else its
    topology; a pixel without cell and a cell with an unknown node are other."""
    c = cells.select("cell_id", F.explode("corners").alias("node_id")).join(classes.select("node_id", "class"), "node_id", "left")
    of = lambda x: F.count_if(F.col("class") == x)
    c = c.groupBy("cell_id").agg(F.count_if(F.col("class").isNull()).alias("gone"), of(metrics.NO_TIDE).alias("dry"), of(metrics.NO_MDT).alias("bare"), of(metrics.COMPLETE).alias("whole"))
    cause = F.when(F.coalesce(F.col("gone"), F.lit(1)) > 0, CAUSES[4]).when(F.col("dry") == 4, CAUSES[0]).when(F.col("bare") == 4, CAUSES[1]).when(F.col("whole") == 0, CAUSES[2]).otherwise(CAUSES[3])
    found = pixels.where(F.col("qc") == (qc.INSUFFICIENT | qc.CONNECTIVITY)).join(c, "cell_id", "left").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    every = pixels.sparkSession.createDataFrame([(x,) for x in CAUSES], "cause string").join(found, "cause", "left").select("cause", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    whole = every.agg(F.sum("n").alias("_t"))
    return every.crossJoin(F.broadcast(whole)).select("cause", "n", F.coalesce(100.0 * F.col("n") / F.nullif("_t", F.lit(0)), F.lit(0.0)).alias("percent"))

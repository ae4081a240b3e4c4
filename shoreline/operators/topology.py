"""Support topology: how much of each coarse cell is valid, and which cells hang together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.sources.tables import stored


def coarse_factor(resolution_m: float, pixel_m: float) -> int:
    return max(1, round(resolution_m / pixel_m))


def downsample(pixels: DataFrame, factor: int, height: int, width: int, z: str = "z") -> DataFrame:
    """r, c, valid_n, total_n, fraction of each coarse cell; cells at the ragged edge have fewer pixels."""
    r, c = F.floor(F.col("row") / factor), F.floor(F.col("col") / factor)
    out = pixels.groupBy(r.cast("long").alias("r"), c.cast("long").alias("c")).agg(F.count(z).alias("valid_n"))
    total = F.least(F.lit(factor), height - F.col("r") * factor) * F.least(F.lit(factor), width - F.col("c") * factor)
    return out.select("r", "c", "valid_n", total.cast("long").alias("total_n"), (F.col("valid_n") / total).alias("fraction"))


def components(cells: DataFrame) -> DataFrame:
    """r, c, component (the smallest r * 2^32 + c that hangs together, by 8 neighbours) of active cells r, c.

    Labels spread to the smallest neighbour and then jump to the label's own label, so that rounds grow with the logarithm of the
    longest chain, until none changes. Every round is written, so that a lost executor costs one round."""
    node = F.col("r") * (1 << 32) + F.col("c")
    cells = stored(cells.select("r", "c", node.alias("node")).distinct(), "cells")
    steps = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    edge = cells.withColumn("s", F.explode(F.array(*steps))).select("node", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    edge = stored(edge.join(cells.select("r", "c", F.col("node").alias("other")), ["r", "c"]).select("node", "other"), "edges")
    labels = cells.select("node", F.col("node").alias("label"))
    while True:
        known = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = edge.join(known, "other").groupBy("node").agg(F.min("theirs").alias("m"))
        low = labels.join(near, "node", "left").select("node", "label", F.least("label", "m").alias("up"))
        top = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        new = stored(low.join(top, "up", "left").select("node", F.col("label").alias("old"), F.least("up", "top").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            break
    return cells.join(labels, "node").select("r", "c", F.col("label").alias("component"))


def node_component(nodes: DataFrame, coarse: DataFrame, reach: int = 2) -> DataFrame:
    """node_id, component_id of nodes (node_id, r, c): that of their cell, else the only one within `reach` cells, else 0."""
    lab = coarse.select("r", "c", "component")
    own = nodes.join(lab, ["r", "c"], "left").select("node_id", F.col("component").alias("own"))
    span = F.sequence(F.lit(-reach), F.lit(reach))
    near = nodes.withColumn("a", F.explode(span)).withColumn("b", F.explode(span)).select("node_id", (F.col("r") + F.col("a")).alias("r"), (F.col("c") + F.col("b")).alias("c")).join(lab, ["r", "c"])
    one = near.groupBy("node_id").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return own.join(one, "node_id", "left").select("node_id", F.coalesce("own", F.when(F.col("x") == F.col("y"), F.col("x")), F.lit(0)).alias("component_id"))

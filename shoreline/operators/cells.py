"""Leaf cells over pixels: membership, corners, topology and blended products.

cells: cell_id, x_min, y_min, x_max, y_max, corners (ids of the nodes at (x0,y0), (x1,y0), (x0,y1), (x1,y1)), cell_qc.
nodes: node_id, valid, component_id, qc. A pixel belongs to a cell by half-open bounds, closed on the east and north edge of the raster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.functions import geo, qc

EDGE = 1e-6


def _inside(x_edge: float, y_edge: float):
    x, y = F.col("x"), F.col("y")
    east = (x < F.col("x_max")) | ((F.col("x_max") >= x_edge - EDGE) & (x <= F.col("x_max")))
    north = (y < F.col("y_max")) | ((F.col("y_max") >= y_edge - EDGE) & (y <= F.col("y_max")))
    return (x >= F.col("x_min")) & (y >= F.col("y_min")) & east & north


def membership(pixels: DataFrame, cells: DataFrame, key: str, x_edge: float, y_edge: float, bucket: float, max_buckets: int = 4096, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, x, y, the columns `carry` and the cell of every pixel that has one. Cells are spread over the buckets they touch and joined on the bucket;
    a cell that touches more than max_buckets goes to coarser buckets, so that no cell is multiplied without bound."""
    def level(size: float, some: DataFrame) -> DataFrame:
        b = lambda c: F.floor(F.col(c) / size).cast("long")
        spread = some.withColumn("bx", F.explode(F.sequence(b("x_min"), b("x_max")))).withColumn("by", F.explode(F.sequence(b("y_min"), b("y_max"))))
        at = pixels.select(key, "x", "y", *carry, b("x").alias("bx"), b("y").alias("by"))
        return at.join(spread, ["bx", "by"]).where(_inside(x_edge, y_edge)).drop("bx", "by")

    touched = (F.floor(F.col("x_max") / bucket) - F.floor(F.col("x_min") / bucket) + 1) * (F.floor(F.col("y_max") / bucket) - F.floor(F.col("y_min") / bucket) + 1)
    out = level(bucket, cells.where(touched <= max_buckets))
    large = cells.where(touched > max_buckets)
    side = large.agg(F.max(F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))).alias("s")).first()["s"]
    return out if side is None else out.unionByName(level(max(side, bucket), large))


def membership_plain(pixels: DataFrame, cells: DataFrame, key: str, x_edge: float, y_edge: float) -> DataFrame:
    """The same by the bare condition, for checks on small tables."""
    return pixels.select(key, "x", "y").join(cells, _inside(x_edge, y_edge))


def corner_weights(members: DataFrame, key: str) -> DataFrame:
    """key, cell_id, corner (0..3), node_id, weight."""
    u = (F.col("x") - F.col("x_min")) / (F.col("x_max") - F.col("x_min"))
    v = (F.col("y") - F.col("y_min")) / (F.col("y_max") - F.col("y_min"))
    w = F.array(*geo.bilinear_weights(u, v))
    return members.select(key, "cell_id", F.posexplode(F.arrays_zip(F.col("corners").alias("node"), w.alias("weight"))).alias("corner", "c")).select(key, "cell_id", "corner", F.col("c.node").alias("node_id"), F.col("c.weight").alias("weight"))


def missing_nodes(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cell_id, node_id of corners that name no node; must be empty."""
    return cells.select("cell_id", F.explode("corners").alias("node_id")).join(nodes.select("node_id"), "node_id", "left_anti").select("cell_id", "node_id")


def usable_corners(weights: DataFrame, nodes: DataFrame, key: str, component: str = "component") -> DataFrame:
    """Corners that a pixel may use, with weights that sum to 1. weights: key, component (of the pixel), node_id, weight.

    A pixel in component P uses valid corners of P if there are any, else all valid ones if none has a component, else none; a pixel
    without component uses all valid ones unless they lie in two components. A corner without component is never P.
    Adds usable (how many), connectivity and spatial (fallbacks)."""
    n = nodes.select("node_id", F.coalesce("valid", F.lit(False)).alias("_ok"), F.coalesce("component_id", F.lit(0)).alias("_c"))
    w = Window.partitionBy(key)
    j = weights.join(n, "node_id").withColumn("_p", F.coalesce(component, F.lit(0)))
    ok, own = F.col("_ok"), F.col("_ok") & (F.col("_c") == F.col("_p"))
    j = j.withColumns({"_n": F.count_if(ok).over(w), "_own": F.count_if(own).over(w), "_low": F.min(F.when(ok & (F.col("_c") > 0), F.col("_c"))).over(w), "_high": F.max(F.when(ok & (F.col("_c") > 0), F.col("_c"))).over(w)})
    several = F.col("_low") != F.col("_high")
    use = F.when(F.col("_p") > 0, F.when(F.col("_own") > 0, own).otherwise(ok & F.col("_low").isNull())).otherwise(ok & ~F.coalesce(several, F.lit(False)))
    j = j.withColumn("_use", use)
    used = F.count_if("_use").over(w)
    total = F.sum(F.when(F.col("_use"), F.col("weight"))).over(w)
    fallback = (F.col("_p") > 0) & (used > 0) & F.when(F.col("_own") > 0, F.col("_own") < F.col("_n")).otherwise(True)
    j = j.withColumns({"usable": used, "share": F.col("weight") / F.when(total > 1e-9, total).otherwise(1.0), "connectivity": fallback, "spatial": (used > 0) & (used < 4)})
    return j.select(*weights.columns, F.col("_use").alias("use"), "usable", "share", "connectivity", "spatial")


def with_nodes(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """cells with `n`, their nodes in the order of the corners: valid, component, qc. A corner that names no node isn't valid; missing_nodes()
    finds such cells."""
    each = cells.select("cell_id", F.posexplode("corners").alias("i", "node_id")).join(nodes.select("node_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("component_id", F.lit(0)).alias("component"), F.coalesce("qc", F.lit(0)).alias("qc")), "node_id", "left")
    n = each.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("component", F.lit(0)).alias("component"), F.coalesce("qc", F.lit(0)).alias("qc")))).alias("n"))
    return cells.join(n, "cell_id")


def corner_choice(m: DataFrame) -> DataFrame:
    """The rule of usable_corners() as expressions on pixels (x, y, component) with their cell's bounds and nodes (with_nodes()): shares s0 to s3 (0 for
    a corner that isn't used), usable, connectivity, spatial, used_qc (bits of the nodes used) and all_qc (bits of all four). No row is made for a
    corner. Steps are columns of their own, so that none is computed twice and generated code stays small."""
    k4, col = range(4), F.col
    add = lambda f: reduce(Column.__add__, [f(k) for k in k4])
    m = m.withColumns({"_p": F.coalesce("component", F.lit(0)), **{f"_ok{k}": col("n")[k]["valid"] for k in k4}, **{f"_c{k}": col("n")[k]["component"] for k in k4}, **{f"_q{k}": col("n")[k]["qc"] for k in k4}})
    m = m.withColumns({f"_own{k}": col(f"_ok{k}") & (col(f"_c{k}") == col("_p")) for k in k4} | {f"_named{k}": F.when(col(f"_ok{k}") & (col(f"_c{k}") > 0), col(f"_c{k}")) for k in k4})
    named = [f"_named{k}" for k in k4]
    m = m.withColumns({"_oks": add(lambda k: col(f"_ok{k}").cast("int")), "_owns": add(lambda k: col(f"_own{k}").cast("int")), "_none": F.coalesce(*named).isNull(), "_several": F.coalesce(F.least(*named) != F.greatest(*named), F.lit(False))})
    use = lambda k: F.when(col("_p") > 0, F.when(col("_owns") > 0, col(f"_own{k}")).otherwise(col(f"_ok{k}") & col("_none"))).otherwise(col(f"_ok{k}") & ~col("_several"))
    w = geo.bilinear_weights((col("x") - col("x_min")) / (col("x_max") - col("x_min")), (col("y") - col("y_min")) / (col("y_max") - col("y_min")))
    m = m.withColumns({f"_use{k}": use(k) for k in k4} | {f"_w{k}": x for k, x in enumerate(w)})
    m = m.withColumns({f"_part{k}": F.when(col(f"_use{k}"), col(f"_w{k}")).otherwise(0.0) for k in k4} | {"usable": add(lambda k: col(f"_use{k}").cast("int"))})
    m = m.withColumn("_total", add(lambda k: col(f"_part{k}")))
    bits = lambda f: reduce(Column.bitwiseOR, [F.when(f(k), col(f"_q{k}")).otherwise(0) for k in k4])
    out = {f"s{k}": col(f"_part{k}") / F.when(col("_total") > 1e-9, col("_total")).otherwise(1.0) for k in k4}
    out |= {"connectivity": (col("_p") > 0) & (col("usable") > 0) & F.when(col("_owns") > 0, col("_owns") < col("_oks")).otherwise(True), "spatial": (col("usable") > 0) & (col("usable") < 4)}
    return m.withColumns(out | {"used_qc": bits(lambda k: col(f"_use{k}")), "all_qc": bits(lambda k: F.lit(True))})


def blend_frequency(corners: DataFrame, node_frequency: DataFrame, key: str) -> DataFrame:
    """key, frequency, qc of pixels: the weighted mean of the nodes' frequencies at the pixel's height, and the union of the bits.
    corners: usable_corners() with z, cell_qc and node_qc; node_frequency: key, node_id, frequency."""
    j = corners.join(node_frequency, [key, "node_id"], "left")
    bits = F.when(F.col("use"), F.col("node_qc")).otherwise(0)
    out = j.groupBy(key).agg(F.sum(F.when(F.col("use"), F.col("share") * F.col("frequency"))).alias("f"), F.bit_or(bits).alias("b"), F.max("cell_qc").alias("cq"), F.max("usable").alias("u"), F.bool_or("connectivity").alias("c"), F.bool_or("spatial").alias("s"))
    solved = F.col("u") > 0
    extra = F.when(F.col("c"), qc.CONNECTIVITY).otherwise(0).bitwiseOR(F.when(F.col("s"), qc.SPATIAL_FALLBACK).otherwise(0))
    bad = F.col("cq").bitwiseOR(F.lit(qc.INSUFFICIENT | qc.CONNECTIVITY))
    return out.select(key, F.when(solved, F.col("f")).alias("frequency"), F.when(solved, F.col("cq").bitwiseOR(F.col("b")).bitwiseOR(extra)).otherwise(bad).alias("qc"))


def blend_levels(corners: DataFrame, tide: DataFrame, key: str, t: str = "t") -> DataFrame:
    """key, t, level: the water at pixels, weights renormalised at each time over the corners that have a level."""
    j = corners.where("use").select(key, "node_id", "share").join(tide.select("node_id", t, "level"), "node_id")
    ok = F.col("level").isNotNull()
    return j.groupBy(key, t).agg((F.sum(F.when(ok, F.col("share") * F.col("level"))) / F.nullif(F.sum(F.when(ok, F.col("share"))), F.lit(0.0))).alias("level"))

"""Values of regular grids at points: bilinear, nearest, and inverse distance over the nearest neighbours.

A grid is a table i, j, val (i along x, j along y); points need an id. All joins are equi-joins on cell indices, so they
shuffle by cell whatever the size of grid and points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.functions import geo
from shoreline.sources.tables import stored


def bilinear(points: DataFrame, grid: DataFrame, key: str, fx: str, fy: str) -> DataFrame:
    """key, value: the mean of the four grid values around the fractional index (fx, fy), null if one is missing, whatever its weight."""
    i0, j0 = F.floor(fx), F.floor(fy)
    u, v = F.col(fx) - i0, F.col(fy) - j0
    w = geo.bilinear_weights(u, v)
    corners = F.array(*(F.struct((i0 + a).cast("long").alias("i"), (j0 + b).cast("long").alias("j"), x.alias("w")) for (a, b), x in zip(((0, 0), (1, 0), (0, 1), (1, 1)), w, strict=True)))
    four = points.where(F.col(fx).isNotNull() & F.col(fy).isNotNull()).select(key, F.explode(corners).alias("c")).select(key, "c.i", "c.j", "c.w")
    hit = four.join(grid.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "val"), ["i", "j"], "left")
    mean = hit.groupBy(key).agg(F.sum(F.col("w") * F.col("val")).alias("s"), F.count_if(F.col("val").isNull() | F.isnan("val")).alias("gone"))
    found = mean.select(key, F.when(F.col("gone") == 0, F.col("s")).alias("value"))
    return points.select(key).join(found, key, "left")


def nearest(points: DataFrame, grid: DataFrame, key: str, fx: str, fy: str) -> DataFrame:
    """key, value of the nearest grid cell; halves go to the even index."""
    at = points.select(key, F.bround(fx).cast("long").alias("i"), F.bround(fy).cast("long").alias("j"))
    return at.join(grid.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("val").alias("value")), ["i", "j"], "left").select(key, "value")


#: Half the side of the cube that holds the sphere (a power of two, so that cells have exact bounds), and how often it is halved at most (to a quarter of a millimetre).
_HALF, _DEEPEST = 2.0**23, 36


def _side(level):
    return 2 * _HALF / F.pow(F.lit(2.0), level)


def _cell(level, prefix: str = "_") -> list:
    """The cell of a level that a place is in, as columns _cx, _cy, _cz."""
    return [F.floor((F.col(f"{prefix}{c}") + _HALF) / _side(level)).alias(f"_c{c}") for c in "xyz"]


def _reach(far: bool):
    """Metres from a place to the nearest or farthest point of a cell."""
    side, parts = _side(F.col("_l")), []
    for c in "xyz":
        low = F.col(f"_c{c}") * side - _HALF
        a, b = low - F.col(f"_{c}"), F.col(f"_{c}") - (low + side)
        parts.append(F.greatest(F.abs(a), F.abs(b)) if far else F.greatest(a, b, F.lit(0.0)))
    return F.sqrt(sum(p * p for p in parts))


def knn(points: DataFrame, support: DataFrame, key: str, sid: str, k: int, cell_deg: float = 1.0, lon: str = "lon", lat: str = "lat", by: str | None = None, apart: str | None = None, stop: float | None = None) -> DataFrame:
    """key, sid, d (chord metres), rank: the k nearest support points of every point, exactly; with `by`, among those equal in that column, with
    `apart`, among those that differ in it. Ties go to the smaller id. With `stop` (metres), points without support that near are left out; so are points without a position.

    Points at one place are searched for once, and of support at one place the k smallest ids count. The chord's cube is halved again and again; a place begins
    in the smallest cell about it that holds enough support, so that its k-th neighbour is no farther than that cell's far corner, and takes the cells around
    that are as near. Those that hold many are halved, with what is then known to be too far left out, until all are small: whatever the density of the
    support, and however far from it a place is, few rows are compared. cell_deg has no effect; sizes come from the support."""
    cell, own = ["_l", "_cx", "_cy", "_cz"], [*["_by"] * bool(by), *["_apart"] * bool(apart)]
    cell_by, place = cell + ["_by"] * bool(by), ["_lon", "_lat", *own]

    def placed(df, i):
        at = df.select(F.col(i), F.col(lon).cast("double").alias("_lon"), F.col(lat).cast("double").alias("_lat"), *([F.col(by).alias("_by")] if by else []), *([F.col(apart).alias("_apart")] if apart else []))
        return at.where(geo.finite(F.col("_lon")) & geo.finite(F.col("_lat"))).dropna(subset=own) if own else at.where(geo.finite(F.col("_lon")) & geo.finite(F.col("_lat")))

    xyz = [c.alias(n) for c, n in zip(geo.chord(F.col("_lon"), F.col("_lat")), ("_x", "_y", "_z"), strict=True)]
    first = F.row_number().over(Window.partitionBy(*place).orderBy(sid))
    sup = stored(placed(support, sid).withColumn("_i", first).where(F.col("_i") <= k).drop("_i").select(sid, *own, *xyz), "knn-support")
    total = sup.count()
    if not total:
        return points.select(key, F.lit(None).cast(support.schema[sid].dataType).alias(sid), F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("rank")).limit(0)
    want, few = min(k, total), max(32, 4 * k)
    crowded = sup.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(_DEEPEST), F.lit(2)))).groupBy("_l", *_cell(F.col("_l")), *["_by"] * bool(by)).count().where(F.col("count") > few)
    deepest = crowded.agg(F.max("_l").alias("l")).first()["l"]
    depth = 0 if deepest is None else min(deepest + 2, _DEEPEST)
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    rows = sup.withColumn("_l", levels).select("*", *_cell(F.col("_l")))
    held = stored(rows.groupBy(*cell_by).agg(F.count("*").alias("_n")), "knn-cells")
    same = stored(rows.groupBy(*cell_by, "_apart").agg(F.count("*").alias("_same")), "knn-apart") if apart else None

    def open_to(df):
        """Cells with _e, how much of their support a place may take."""
        return df.join(same, [*cell_by, "_apart"], "left").withColumn("_e", F.col("_n") - F.coalesce("_same", F.lit(0))).drop("_same") if apart else df.withColumn("_e", F.col("_n"))

    places = placed(points, key).select(*place).distinct().select(*place, *xyz)
    inner = held.where((F.col("_n") >= max(want, 8)) | (F.col("_l") == 0))
    chain = open_to(places.withColumn("_l", levels).select("*", *_cell(F.col("_l"))).join(inner, cell_by)).where((F.col("_e") >= max(want, 8)) | (F.col("_l") == 0))
    begin = chain.groupBy(*place).agg(F.max_by(F.struct("_x", "_y", "_z", *cell, "_e"), "_l").alias("b")).select(*place, "b.*")
    begin = stored(begin.withColumn("_most", F.when(F.col("_e") >= want, _reach(True)).otherwise(float("inf"))).drop("_e"), "knn-begin")
    around = begin.select(*cell_by).distinct()
    for c in "xyz":
        around = around.withColumn(f"_o{c}", F.explode(F.array(*(F.lit(o) for o in (-2, -1, 0, 1, 2)))))
    mine, near_by = [f"_m{c}" for c in "xyz"], [F.col(f"_c{c}") for c in "xyz"]
    around = around.select("_l", *["_by"] * bool(by), *(c.alias(m) for c, m in zip(near_by, mine, strict=True)), *((F.col(f"_c{c}") + F.col(f"_o{c}")).alias(f"_c{c}") for c in "xyz")).join(held, cell_by)
    begin_at = begin.select(*place, "_x", "_y", "_z", "_most", "_l", *(c.alias(m) for c, m in zip(near_by, mine, strict=True)))
    near_enough = lambda df: df.where(_reach(False) <= F.col("_most") + 1e-6)  # noqa: E731  with what rounding may take
    small = (F.col("_n") <= few) | (F.col("_l") == depth)
    found = stored(open_to(near_enough(begin_at.join(around, ["_l", *["_by"] * bool(by), *mine]).drop(*mine))).where("_e > 0"), "knn-found")
    leaves = [found]
    # two levels at a time
    inside = lambda n: held.where(F.col("_l") >= n).select(*((F.col(c) - n if c == "_l" else F.shiftright(c, n)).alias(c) for c in cell), *["_by"] * bool(by), "_n", *(F.col(c).alias(f"{c}_to") for c in cell))
    below = inside(2).unionByName(inside(1).where(F.col("_l") == depth - 1))
    while not found.where(~small).isEmpty():
        halves = found.where(~small).drop("_n", "_e").join(below, cell_by).drop(*cell).withColumnsRenamed({f"{c}_to": c for c in cell})
        halves = open_to(near_enough(halves)).where("_e > 0").withColumn("_far", _reach(True))
        w = Window.partitionBy(*place)
        enough = F.sum("_e").over(w.orderBy("_far").rowsBetween(Window.unboundedPreceding, 0)) >= want
        halves = halves.withColumn("_at", F.when(enough, F.col("_far"))).withColumn("_most", F.least("_most", F.min("_at").over(w)))
        found = stored(near_enough(halves.drop("_far", "_at")), "knn-found")
        leaves.append(found)
    ends = reduce(DataFrame.unionByName, leaves).where(small)
    if len(leaves) > 1:
        ends = near_enough(ends.withColumn("_most", F.min("_most").over(Window.partitionBy(*place))))
    d = F.sqrt(sum((F.col(f"_{c}") - F.col(f"_s{c}")) ** 2 for c in "xyz"))
    other = rows.withColumnsRenamed({f"_{c}": f"_s{c}" for c in "xyz"}).withColumnRenamed("_apart", "_other")
    pairs = ends.join(other, cell_by).where(F.col("_apart") != F.col("_other") if apart else F.lit(True)).withColumn("d", d).where(F.col("d") <= F.col("_most") + 1e-6)
    ranked = pairs.select(*place, sid, "d").withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy("d", sid))).where(F.col("rank") <= want)
    if stop is not None:
        ranked = ranked.withColumn("_d0", F.min("d").over(Window.partitionBy(*place))).where(F.col("_d0") <= stop)
    return placed(points, key).join(ranked, place).select(key, sid, "d", "rank")


def idw(points: DataFrame, support: DataFrame, key: str, sid: str, value: str, k: int = 8, cutoff_m: float | None = 100_000.0, power: float = 2.0, native: str | None = None, cell_deg: float = 1.0) -> DataFrame:
    """key, value, quality: the native value (0), else the inverse-distance mean of the k nearest (1) where the nearest is within the
    cutoff, else null (2). Within 0.1 mm of a support point its value is taken. A cutoff of 0 turns extrapolation off."""
    cutoff_m = 100_000.0 if cutoff_m is None else cutoff_m
    if not 0 <= cutoff_m <= 500_000:
        raise ValueError("the cutoff must be 0 to 500 km")
    open_points = points if native is None else points.where(F.col(native).isNull())
    near = knn(open_points, support, key, sid, k, cell_deg, stop=cutoff_m).join(support.select(sid, F.col(value).alias("_v")), sid)
    w = F.col("d") ** -power
    mean = near.groupBy(key).agg(F.min("d").alias("d0"), F.min_by("_v", F.struct("d", sid)).alias("v0"), (F.sum(F.when(F.col("d") >= 1e-4, w * F.col("_v"))) / F.sum(F.when(F.col("d") >= 1e-4, w))).alias("m"))
    far = mean.select(key, F.when(F.col("d0") < 1e-4, F.col("v0")).otherwise(F.col("m")).alias("_far")).where((mean["d0"] <= cutoff_m) & F.lit(cutoff_m > 0))
    out = points.join(far, key, "left")
    own = F.col(native) if native else F.lit(None).cast("double")
    quality = F.when(own.isNotNull(), 0).when(F.col("_far").isNotNull(), 1).otherwise(2)
    return out.select(key, F.coalesce(own, F.col("_far")).alias("value"), quality.alias("quality"))


def leave_one_out(anchors: DataFrame, sid: str, value: str, k: int = 4, max_km: float = 8.0, power: float = 2.0, cell_deg: float = 1.0) -> DataFrame:
    """sid, truth, value, km of every anchor with a value: its own value, the inverse-distance mean of those of the k nearest other anchors within
    max_km, and the distance of the nearest. Anchors with none within max_km are left out; others at the same place weigh as at 0.1 m."""
    a = anchors.where(F.col(value).isNotNull())
    near = knn(a.withColumnRenamed(sid, "_own"), a, "_own", sid, k + 1, cell_deg)
    # where more than k others share the place, the anchor itself may not be among the nearest
    other = near.where(F.col("_own") != F.col(sid)).withColumn("rank", F.row_number().over(Window.partitionBy("_own").orderBy("d", sid)))
    other = other.where((F.col("rank") <= k) & (F.col("d") <= max_km * 1000.0)).join(a.select(sid, F.col(value).alias("_v")), sid)
    km = F.col("d") / 1000.0
    w = F.greatest(km, F.lit(1e-4)) ** -power
    mean = other.groupBy("_own").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("value"), F.min(km).alias("km"))
    return mean.join(a.select(F.col(sid).alias("_own"), F.col(value).alias("truth")), "_own").select(F.col("_own").alias(sid), "truth", "value", "km")


def nearest_connected(points: DataFrame, anchors: DataFrame, key: str, sid: str, component: str = "component", cell_deg: float = 1.0) -> DataFrame:
    """key, sid, d of the nearest anchor in the point's component, or of no component, or, for a point without component (0), of any."""
    far = "_far"
    named = points.where(F.col(component) > 0)
    runs = [
        knn(named, anchors.where(F.col(component) > 0), key, sid, 1, cell_deg, by=component),
        knn(named, anchors.where(F.col(component) == 0), key, sid, 1, cell_deg),
        knn(points.where(F.col(component) == 0), anchors, key, sid, 1, cell_deg),
    ]
    found = runs[0].unionByName(runs[1]).unionByName(runs[2])
    best = found.groupBy(key).agg(F.min(F.struct("d", sid)).alias(far)).select(key, f"{far}.{sid}", f"{far}.d")
    return points.select(key).join(best, key, "left")

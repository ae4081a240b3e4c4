"""Cells of regular grids around points: indices on ascending and descending axes, what their valid corners allow, where validity ends, and
windows over the antimeridian. A grid is a table i, j, val (i along x, j along y; null where there is no value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.functions import geo
from shoreline.operators.frequency import finite

#: What a cell's valid corners are to a point, and the tolerances of the tests.
TYPE_4, TYPE_3_INSIDE, TYPE_3_OUTSIDE, TYPE_2_ON_SEGMENT, TYPE_2_OUTSIDE, TYPE_1, TYPE_0 = "TYPE_4", "TYPE_3_INSIDE", "TYPE_3_OUTSIDE", "TYPE_2_ON_SEGMENT", "TYPE_2_OUTSIDE", "TYPE_1", "TYPE_0"
INSIDE_TOLERANCE, SEGMENT_KM = 1e-5, 0.05


@dataclass(frozen=True)
class Axis:
    """Values first, first + step, ... of n grid lines; the step may be negative."""

    first: float
    step: float
    n: int

    def cell(self, x: Column) -> Column:
        """The lower of the two line numbers around a value, null outside; the last line belongs to the last cell."""
        last = self.first + self.step * (self.n - 1)
        inside = (x >= min(self.first, last)) & (x <= max(self.first, last))
        at = F.floor((x - self.first) / self.step)
        return F.when(inside, F.greatest(F.lit(0), F.least(F.lit(self.n - 2), at))).cast("long")

    def at(self, k: Column) -> Column:
        return F.lit(self.first) + k * F.lit(self.step)


def axis_of(grid: DataFrame, index: str, value: str) -> Axis:
    """The axis of a grid whose lines carry their coordinate, in either order. Two rows come to the driver."""
    low, high, n = grid.agg(F.min(F.struct(index, value)), F.max(F.struct(index, value)), F.count_distinct(index)).first()
    return Axis(low[value], (high[value] - low[value]) / max(1, high[index] - low[index]), n)


def corners(points: DataFrame, grid: DataFrame, x: Axis, y: Axis, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """key, lon, lat, i, j and v, the values at the cell's corners (i, j), (i+1, j), (i, j+1), (i+1, j+1); i and j are null outside the grid."""
    p = points.select(key, F.col(lon).alias("lon"), F.col(lat).alias("lat"), x.cell(F.col(lon)).alias("i"), y.cell(F.col(lat)).alias("j"))
    four = F.array(*(F.struct(F.lit(k).alias("k"), (F.col("i") + a).alias("gi"), (F.col("j") + b).alias("gj")) for k, (a, b) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1)))))
    each = p.where("i is not null and j is not null").select(key, F.explode(four).alias("c")).select(key, "c.*")
    hit = each.join(grid.select(F.col("i").cast("long").alias("gi"), F.col("j").cast("long").alias("gj"), finite(F.col("val").cast("double")).alias("val")), ["gi", "gj"], "left")
    v = hit.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "val"))), lambda s: s.val).alias("v"))
    return p.join(v, key, "left")


def geometry(points: DataFrame, grid: DataFrame, x: Axis, y: Axis, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """key, finite (corners with a value), kind and value: bilinear with four, barycentric in the triangle of three, linear on the segment of
    two; null where the point lies outside what they span."""
    c = corners(points, grid, x, y, key, lon, lat)
    px, py = F.col("lon"), F.col("lat")
    xs, ys = (x.at(F.col("i")), x.at(F.col("i") + 1)), (y.at(F.col("j")), y.at(F.col("j") + 1))
    place = [(xs[k % 2], ys[k // 2]) for k in range(4)]
    v = [F.col("v")[k] for k in range(4)]
    n = sum((a.isNotNull().cast("int") for a in v[1:]), v[0].isNotNull().cast("int"))
    n = F.coalesce(n, F.lit(0))
    w = geo.bilinear_weights((px - xs[0]) / (xs[1] - xs[0]), (py - ys[0]) / (ys[1] - ys[0]))
    four = w[0] * v[0] + w[1] * v[1] + w[2] * v[2] + w[3] * v[3]
    inside3 = value3 = on2 = value2 = None
    for gone in range(4):
        a, b, d = (k for k in range(4) if k != gone)
        u = geo.barycentric(px, py, *place[a], *place[b], *place[d])
        ok = (u[0] >= -INSIDE_TOLERANCE) & (u[1] >= -INSIDE_TOLERANCE) & (u[2] >= -INSIDE_TOLERANCE)
        value = u[0] * v[a] + u[1] * v[b] + u[2] * v[d]
        inside3 = F.when(v[gone].isNull(), ok) if inside3 is None else inside3.when(v[gone].isNull(), ok)
        value3 = F.when(v[gone].isNull(), value) if value3 is None else value3.when(v[gone].isNull(), value)
    kx = geo.DEGREE_KM * F.cos(F.radians(py))
    for a in range(4):
        for b in range(a + 1, 4):
            here = v[a].isNotNull() & v[b].isNotNull()
            (ax, ay), (bx, by) = place[a], place[b]
            far = geo.segment_distance(px * kx, py * geo.DEGREE_KM, ax * kx, ay * geo.DEGREE_KM, bx * kx, by * geo.DEGREE_KM)
            t = F.sqrt((px - ax) ** 2 + (py - ay) ** 2) / F.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
            value = (1.0 - t) * v[a] + t * v[b]
            on2 = F.when(here, far <= SEGMENT_KM) if on2 is None else on2.when(here, far <= SEGMENT_KM)
            value2 = F.when(here, value) if value2 is None else value2.when(here, value)
    kind = F.when(n == 4, TYPE_4).when((n == 3) & inside3, TYPE_3_INSIDE).when(n == 3, TYPE_3_OUTSIDE).when((n == 2) & on2, TYPE_2_ON_SEGMENT).when(n == 2, TYPE_2_OUTSIDE).when(n == 1, TYPE_1).otherwise(TYPE_0)
    out = c.withColumns({"finite": n, "kind": kind})
    value = F.when(F.col("kind") == TYPE_4, four).when(F.col("kind") == TYPE_3_INSIDE, value3).when(F.col("kind") == TYPE_2_ON_SEGMENT, value2)
    return out.select(key, "finite", "kind", value.alias("value"))


def whole_cells(grid: DataFrame) -> DataFrame:
    """i, j of the cells all four of whose corners have a value."""
    ok = grid.where(finite(F.col("val").cast("double")).isNotNull())
    each = ok.select(F.explode(F.array(*(F.struct((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j")) for a in (0, 1) for b in (0, 1)))).alias("c")).select("c.*")
    return each.groupBy("i", "j").agg(F.count("*").alias("n")).where("n = 4").select("i", "j")


def boundary_segments(grid: DataFrame) -> DataFrame:
    """i1, j1, i2, j2: edges between a whole cell and one that isn't."""
    w = whole_cells(grid).withColumn("here", F.lit(True))
    sides = ((-1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1))
    edge = F.array(*(F.struct((F.col("i") + a).alias("ni"), (F.col("j") + b).alias("nj"), (F.col("i") + p).alias("i1"), (F.col("j") + q).alias("j1"), (F.col("i") + r).alias("i2"), (F.col("j") + s).alias("j2")) for a, b, p, q, r, s in sides))
    each = w.select(F.explode(edge).alias("e")).select("e.*")
    return each.join(w.select(F.col("i").alias("ni"), F.col("j").alias("nj"), "here"), ["ni", "nj"], "left").where("here is null").select("i1", "j1", "i2", "j2")


def angular_gap(near: DataFrame, key: str, dx: str, dy: str) -> DataFrame:
    """key, gap: the largest angle in degrees without a neighbour, around each point. near: a row a neighbour, with its offsets."""
    a = near.select(key, F.degrees(F.atan2(dy, dx)).alias("a"))
    w = Window.partitionBy(key)
    nxt = F.coalesce(F.lead("a").over(w.orderBy("a")), F.min("a").over(w) + 360.0)
    return a.withColumn("g", nxt - F.col("a")).groupBy(key).agg(F.max("g").alias("gap"))


def longitude_window(grid: DataFrame, west: float, east: float, south: float, north: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The grid lines within a window, by filters that reach the scan. A window over the antimeridian (west > east) is two ranges of which the second
    is shifted by 360; lines that both halves have are there once."""
    rows = grid.where(F.col(lat).between(south, north))
    if west <= east:
        return rows.where(F.col(lon).between(west, east))
    right, left = rows.where(F.col(lon).between(west, 180.0)), rows.where(F.col(lon).between(-180.0, east)).withColumn(lon, F.col(lon) + 360.0)
    return right.unionByName(left).dropDuplicates([lon, lat])


def squeezed(grid: DataFrame, time: str) -> DataFrame:
    """A grid without its time of one value; more than one is an error that the first action raises."""
    one = grid.agg(F.count_distinct(time).alias("_n"))
    return grid.crossJoin(F.broadcast(one)).where(F.assert_true(F.col("_n") <= 1, "the grid has more than one time").isNull()).drop(time, "_n")


def constant_grid(spark, nx: int, ny: int, value: float | None) -> DataFrame:
    """A grid of one value, for tests and where a source is not installed."""
    return spark.range(nx * ny).select((F.col("id") % nx).alias("i"), F.expr(f"id div {nx}").alias("j"), F.lit(value).cast("double").alias("val"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """i, j, val of two grids on the same lines, null where one has none."""
    j = a.select("i", "j", F.col("val").alias("x")).join(b.select("i", "j", F.col("val").alias("y")), ["i", "j"], "full_outer")
    return j.select("i", "j", (F.col("x") - F.col("y")).alias("val"))


def resampled(grid: DataFrame, x: Axis, y: Axis, to: DataFrame, to_x: Axis, to_y: Axis) -> DataFrame:
    """The values of a grid at the lines of another (i, j), bilinear."""
    p = to.select("i", "j", to_x.at(F.col("i")).alias("lon"), to_y.at(F.col("j")).alias("lat")).withColumn("key", F.struct("i", "j"))
    found = geometry(p, grid, x, y, "key").where(F.col("kind") == TYPE_4)
    return p.select("i", "j", "key").join(found.select("key", "value"), "key", "left").select("i", "j", F.col("value").alias("val"))


def pixel_span(cells: DataFrame, x0: float, y0: float, dx: float, dy: float, width: int, height: int) -> DataFrame:
    """cells with r0, r1, c0, c1: the rows and columns (inclusive) whose centres are in the half-open cell."""
    def span(lo, hi, origin, step, n):
        a, b = (F.col(lo) - origin) / step - 0.5, (F.col(hi) - origin) / step - 0.5
        low, high = F.least(a, b), F.greatest(a, b)
        # the closed side of the half-open interval is the smaller coordinate; it is the higher index where the axis descends
        first = F.ceil(low) if step > 0 else F.floor(low) + 1
        last = F.ceil(high) - 1 if step > 0 else F.floor(high)
        return F.greatest(F.lit(0), first).cast("long"), F.least(F.lit(n - 1), last).cast("long")

    (c0, c1), (r0, r1) = span("x_min", "x_max", x0, dx, width), span("y_min", "y_max", y0, dy, height)
    return cells.withColumns({"r0": r0, "r1": r1, "c0": c0, "c1": c1})


def cell_classes(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """cell_id, classes of its four nodes in the order of the corners (null for an unknown node)."""
    each = cells.select("cell_id", F.posexplode("corners").alias("k", "node_id")).join(classes.select("node_id", "class"), "node_id", "left")
    return each.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "class"))), lambda s: s["class"]).alias("classes"))


def first_containing(boxes: DataFrame, parents: DataFrame, key: str, order: str, tolerance: float = 1e-5) -> DataFrame:
    """key, parent: the first parent box that holds each box. Parents are the models loaded at a time, so few; they are broadcast."""
    p = parents.select(F.col(order).alias("parent"), *(F.col(c).alias(f"p_{c}") for c in ("west", "south", "east", "north")))
    holds = (F.col("p_west") <= F.col("west") + tolerance) & (F.col("p_south") <= F.col("south") + tolerance) & (F.col("p_east") >= F.col("east") - tolerance) & (F.col("p_north") >= F.col("north") - tolerance)
    return boxes.join(F.broadcast(p), holds, "left").groupBy(key).agg(F.min("parent").alias("parent"))


def ordered_cells(cells: DataFrame, name: str) -> DataFrame:
    """Cells by their name: whole numbers by value, then other texts, then those without."""
    number = F.col(name).try_cast("long")
    return cells.orderBy(F.when(number.isNotNull(), 0).when(F.col(name).isNotNull(), 1).otherwise(2), number, F.col(name))


def preview(df: DataFrame, rows: int = 2000) -> DataFrame:
    """The first rows, for display."""
    return df.limit(rows)


def chunk_order(points: DataFrame, chunk: str) -> DataFrame:
    """points with `turn`, the place of their chunk among all chunks."""
    turns = points.select(chunk).distinct().withColumn("turn", F.dense_rank().over(Window.orderBy(chunk)))
    return points.join(turns, chunk)


def chunk_length(series: int, most: int = 1_000_000) -> int:
    """Times evaluated at once for so many series."""
    return max(1, max(10_000, most) // max(1, series))

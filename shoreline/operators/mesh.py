"""An unstructured mesh of tide constants: storage that a box prunes, location of points in triangles, and interpolation.

triangles: triangle, nodes (3 node ids, or 6: the corners and then the middles of the sides 1-2, 2-3 and 3-1, for a quadratic element).
nodes: node, lon, lat. constants: node, constituent, amp_cm, phase_deg.

A triangle lies in the cells of one level of a hierarchy of grids, that whose cells are no smaller than it and at most twice as large, so
it touches four cells at most, and a point looks up one cell a level. The join is an equi-join on cells; that of a dense coast and that of
the open sea hold equally few triangles. Amplitude and phase are interpolated as complex numbers, one row of all constituents a node.

On disk the mesh is cut into tiles of TILE_DEG degrees, which are directories, and sorted by cell within them, so that a box reads only the tiles that
it meets, and of them the row groups. A triangle is in each tile that it touches."""

from __future__ import annotations

import math
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions.tide import SPEEDS, Harmonic, constituents

BASE_DEG, MOST_LEVELS, TILE_DEG = 45.0, 22, 5.0
#: A point this far outside, in parts of a triangle, still lies in it; boxes contain others to the second tolerance (a fixed value).
EDGE, WITHIN = 1e-9, 1e-5
Box = tuple[float, float, float, float]
TABLES = {
    "triangles": "triangle long, nodes array<long>, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, west double, east double, south double, north double, level int, tile int",
    "constants": "node long, lon double, lat double, re array<double>, im array<double>, tile int",
}


def turned(x: Column, first: Column) -> Column:
    """A longitude as the nearest to `first`, so that differences don't jump at the antimeridian."""
    return first + F.pmod(x - first + 180.0, F.lit(360.0)) - 180.0


def cell_of(level: Column, i: Column, j: Column) -> Column:
    """A number for a cell; columns of cells close around the globe."""
    across = F.call_function("shiftleft", F.lit(8).cast("long"), level)
    return F.shiftleft(level.cast("long"), 56) + F.shiftleft(F.pmod(i.cast("long"), across), 28) + j.cast("long")


def side(level: Column) -> Column:
    return F.lit(BASE_DEG) / F.pow(F.lit(2.0), level)


def shaped(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """triangle, nodes, x1..y3, west, south, east, north (unwrapped from the first corner), level. Triangles of unknown corners or without area are left out."""
    corner = triangles.select("triangle", "nodes", F.posexplode(F.slice("nodes", 1, 3)).alias("k", "node"))
    placed = corner.join(nodes.select("node", "lon", "lat"), "node").where("lon is not null and lat is not null")
    at = placed.groupBy("triangle").agg(F.first("nodes").alias("nodes"), F.array_sort(F.collect_list(F.struct("k", "lon", "lat"))).alias("c")).where(F.size("c") == 3)
    t = at.select(F.col("triangle").cast("long").alias("triangle"), F.col("nodes").cast("array<long>").alias("nodes"), *(F.col("c")[k][n].alias(f"{a}{k + 1}") for k in range(3) for n, a in (("lon", "x"), ("lat", "y"))))
    t = t.withColumn("x1", F.pmod("x1", F.lit(360.0))).withColumns({f"x{k}": turned(F.col(f"x{k}"), F.pmod("x1", F.lit(360.0))) for k in (2, 3)})
    t = t.withColumns({"west": F.least("x1", "x2", "x3"), "east": F.greatest("x1", "x2", "x3"), "south": F.least("y1", "y2", "y3"), "north": F.greatest("y1", "y2", "y3")})
    t = t.where((F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y1")) != (F.col("x3") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    level = F.floor(F.log2(F.lit(BASE_DEG) / F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))))
    return t.withColumn("level", F.greatest(F.lit(0), F.least(F.lit(MOST_LEVELS), level)).cast("int"))


def touched(t: DataFrame, size: Column) -> tuple[Column, Column]:
    """Columns and rows of cells of a size that a triangle's box meets."""
    i = F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size))
    j = F.sequence(F.floor((F.col("south") + 90.0) / size), F.floor((F.col("north") + 90.0) / size))
    return i, j


def tile_of(i: Column, j: Column) -> Column:
    return (F.pmod(i, F.lit(int(360 / TILE_DEG))) * 1000 + j).cast("int")


def write_mesh(triangles: DataFrame, nodes: DataFrame, constants: DataFrame, path: str, names: list[str] | None = None, overwrite: bool = False) -> None:
    """<path>/triangles, <path>/constants by tile, and <path>/about, one row: constituents, levels that occur, and reach (the largest extent of a triangle)."""
    from shoreline.sources.bundle import ExistingOutput, _fs, exists, swap
    from shoreline.sources.tables import freed, stored

    spark = triangles.sparkSession
    if exists(spark, path) and not overwrite:
        raise ExistingOutput(path)
    names, new = constituents("all" if names is None else names), f"{path}.new-{uuid.uuid4().hex}"
    fs, p = _fs(spark, new)
    try:
        t = stored(shaped(triangles, nodes), "mesh-triangles")
        i, j = touched(t, F.lit(TILE_DEG))
        tiled = t.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).withColumn("tile", tile_of(F.col("i"), F.col("j"))).drop("i", "j")
        tiled.repartition("tile", F.floor(F.col("south"))).sortWithinPartitions("tile", "level", "south", "west").write.partitionBy("tile").parquet(f"{new}/triangles")
        order = F.create_map(*(F.lit(x) for k, c in enumerate(names) for x in (c, k)))
        angle = F.radians("phase_deg")
        wave = constants.withColumn("k", F.try_element_at(order, F.col("constituent"))).where("k is not null and amp_cm is not null and phase_deg is not null")
        wave = wave.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct((F.col("amp_cm") * F.cos(angle)).alias("re"), (F.col("amp_cm") * F.sin(angle)).alias("im"))))).alias("w"))
        every = F.sequence(F.lit(0), F.lit(len(names) - 1))
        parts = [F.transform(every, lambda k: F.try_element_at("w", k)["re"]).alias("re"), F.transform(every, lambda k: F.try_element_at("w", k)["im"]).alias("im")]
        lon = F.pmod("lon", F.lit(360.0))
        known = nodes.where("lon is not null and lat is not null").join(wave, "node").select(F.col("node").cast("long").alias("node"), lon.alias("lon"), "lat", *parts)
        known = known.withColumn("tile", tile_of(F.floor(F.col("lon") / TILE_DEG), F.floor((F.col("lat") + 90.0) / TILE_DEG)))
        known.repartition("tile", F.floor(F.col("lat"))).sortWithinPartitions("tile", "lat", "lon").write.partitionBy("tile").parquet(f"{new}/constants")
        about = t.agg(F.array_sort(F.collect_set("level")).alias("levels"), F.coalesce(F.max(F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))), F.lit(0.0)).alias("reach"))
        about.withColumn("constituents", F.array(*map(F.lit, names))).coalesce(1).write.parquet(f"{new}/about")
        freed(t)
        swap(spark, new, path)
    finally:
        fs.delete(p, True)


def contains(outer: Box, inner: Box) -> bool:
    """Boxes of west, south, east, north; those of longitudes over 360 go on around the globe."""
    turn = 360.0 * math.floor((inner[0] - outer[0] + WITHIN) / 360.0)
    return outer[0] <= inner[0] - turn + WITHIN and inner[2] - turn <= outer[2] + WITHIN and outer[1] <= inner[1] + WITHIN and inner[3] <= outer[3] + WITHIN


def box_around(points: DataFrame, buffer_deg: float, lon: str = "lon", lat: str = "lat") -> Box | None:
    """The shortest box around places, wherever it begins, found by whole degrees: at most 360 numbers and four extremes come to the driver."""
    x = F.pmod(F.col(lon), F.lit(360.0))
    found = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(x.alias("x"), F.col(lat).alias("y"))
    rows = found.groupBy(F.floor("x").cast("int").alias("d")).agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.w)
    south, north = min(r.s for r in rows), max(r.n for r in rows)
    gaps = [(b.w - a.e, k) for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False))] + [(rows[0].w + 360.0 - rows[-1].e, len(rows) - 1)]
    widest = max(gaps)[1]
    west, east = rows[(widest + 1) % len(rows)].w, rows[widest].e
    east += 360.0 if east < west else 0.0
    west, east = west - buffer_deg, east + buffer_deg
    west, east = (0.0, 360.0) if east - west >= 360.0 else (west, east)
    return west, max(-90.0, south - buffer_deg), east, min(90.0, north + buffer_deg)


@dataclass
class Mesh:
    """A mesh on disk, read by boxes.

    Within `scope(boxes)` the tables of each box are kept in memory from the first time on that a request lies in it; scopes may be nested and
    let go of their tables however they end. `loads` and `hits` count what was read and what was there."""

    spark: SparkSession
    path: str
    loads: int = 0
    hits: int = 0
    _kept: list = field(default_factory=list)
    _about: object = None

    @property
    def about(self):
        if self._about is None:
            self._about = self.spark.read.parquet(f"{self.path}/about").first()
        return self._about

    def clipped(self, box: Box) -> tuple[DataFrame, DataFrame]:
        """Triangles that meet the box, each once, and the constants of all their nodes. The tiles are a filter of partitions, the box one of row groups."""
        reach = self.about["reach"]
        wider = (box[0] - reach, box[1] - reach, box[2] + reach, box[3] + reach)
        t = self._read("triangles", box).where(F.col("south") <= box[3]).where(F.col("north") >= box[1]).where(_meets(F.col("west"), F.col("east"), box)).dropDuplicates(["triangle"]).drop("tile")
        c = self._read("constants", wider).where(F.col("lat").between(wider[1], wider[3])).where(_meets(F.col("lon"), F.col("lon"), wider)).drop("tile")
        return t, c

    def _read(self, name: str, box: Box) -> DataFrame:
        if box[2] - box[0] >= 360.0:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        lines = range(math.floor((max(-90.0, box[1]) + 90.0) / TILE_DEG), math.floor((min(90.0, box[3]) + 90.0) / TILE_DEG) + 1)
        tiles = [i % int(360 / TILE_DEG) * 1000 + j for i in range(math.floor(box[0] / TILE_DEG), math.floor(box[2] / TILE_DEG) + 1) for j in lines]
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}").where(F.col("tile").isin(*sorted(set(tiles))))

    def tables(self, box: Box) -> tuple[DataFrame, DataFrame]:
        """Of the first kept box that contains this one, else of this one alone."""
        for kept in reversed(self._kept):
            for parent, found in kept.items():
                if contains(parent, box):
                    if found is None:
                        self.loads += 1
                        kept[parent] = found = tuple(x.persist() for x in self.clipped(parent))
                    else:
                        self.hits += 1
                    return found
        self.loads += 1
        return self.clipped(box)

    @contextmanager
    def scope(self, *boxes: Box):
        self._kept.append(dict.fromkeys(boxes))
        try:
            yield self
        finally:
            for found in self._kept.pop().values():
                for t in found or ():
                    t.unpersist()

    def locate(self, points: DataFrame, triangles: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
        """key, triangle, nodes, weights (of three nodes, or six) of points in a triangle; of several triangles the one with the smallest number."""
        levels = F.array(*(F.lit(k) for k in self.about["levels"]))
        size = side(F.col("level"))
        i, j = touched(triangles, size)
        t = triangles.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).withColumn("cell", cell_of(F.col("level"), F.col("i"), F.col("j"))).drop("i", "j", "level", "west", "south", "east", "north")
        p = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(key).alias("_key"), F.pmod(F.col(lon), F.lit(360.0)).alias("px"), F.col(lat).alias("py"), F.explode(levels).alias("level"))
        p = p.withColumn("cell", cell_of(F.col("level"), F.floor(F.col("px") / size), F.floor((F.col("py") + 90.0) / size))).drop("level")
        x, y = turned(F.col("px"), F.col("x1")) - F.col("x1"), F.col("py") - F.col("y1")
        a, b, c, d = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x1"), F.col("y3") - F.col("y1")
        area = a * d - c * b
        near = p.join(t, "cell").select("_key", "triangle", "nodes", ((x * d - c * y) / area).alias("l2"), ((a * y - x * b) / area).alias("l3"))
        near = near.withColumn("l1", 1.0 - F.col("l2") - F.col("l3")).where(F.least("l1", "l2", "l3") >= -EDGE)
        l1, l2, l3 = F.col("l1"), F.col("l2"), F.col("l3")
        quadratic = F.array(*(k * (2.0 * k - 1.0) for k in (l1, l2, l3)), 4.0 * l1 * l2, 4.0 * l2 * l3, 4.0 * l3 * l1)
        best = near.groupBy("_key").agg(F.min(F.struct("triangle", "nodes", F.when(F.size("nodes") == 6, quadratic).otherwise(F.array(l1, l2, l3)).alias("weights"))).alias("t"))
        return best.select(F.col("_key").alias(key), "t.triangle", "t.nodes", "t.weights")

    def interpolate(self, points: DataFrame, key: str, box: Box | None = None, lon: str = "lon", lat: str = "lat", buffer_deg: float = 0.0) -> DataFrame:
        """key, re, im (arrays over about.constituents, cm) of the points that lie in a triangle; a constituent that one of its nodes lacks is null there."""
        box = box or box_around(points, buffer_deg, lon, lat) or (0.0, 0.0, 0.0, 0.0)
        triangles, known = self.tables(box)
        at = self.locate(points, triangles, key, lon, lat).select(F.col(key).alias("_key"), F.size("nodes").alias("wanted"), F.explode(F.arrays_zip("nodes", "weights")).alias("n"))
        at = at.select("_key", "wanted", F.col("n.nodes").alias("node"), F.col("n.weights").alias("w"))
        whole = at.join(known.select("node", "re", "im"), "node").groupBy("_key").agg(F.max("wanted").alias("wanted"), F.collect_list(F.struct("node", "w", "re", "im")).alias("v"))
        whole = whole.where(F.size("v") == F.col("wanted")).withColumn("v", F.array_sort("v"))  # in one order, so that sums are the same each time
        every = F.sequence(F.lit(0), F.lit(len(self.about["constituents"]) - 1))
        mean = lambda part: F.transform(every, lambda k: F.aggregate("v", F.lit(0.0), lambda s, n: s + n["w"] * n[part][k]))
        return whole.select(F.col("_key").alias(key), mean("re").alias("re"), mean("im").alias("im"))


def _meets(west: Column, east: Column, box: Box) -> Column:
    """Whether longitudes [west, east] meet those of the box, as they are and a turn on or back."""
    if box[2] - box[0] >= 360.0:
        return F.lit(True)
    shifts = [k * 360.0 for k in (-1, 0, 1, 2)]
    hit = F.lit(False)
    for s in shifts:
        hit = hit | ((west + s <= box[2]) & (east + s >= box[0]))
    return hit


@dataclass
class MeshTide:
    """A tide model over a mesh: harmonic levels of the constants at each node; no level where there is no triangle or a constituent is missing."""

    mesh: Mesh
    which: object = "all"
    buffer_deg: float = 0.0
    astronomical: bool = False
    calls: int = 0

    def constants(self, nodes: DataFrame) -> DataFrame:
        """node_id, constituent, amp_cm, phase_deg of nodes (node_id, lon, lat) for which all wanted constituents are known."""
        names = self.mesh.about["constituents"]
        wanted = [c for c in constituents(self.which) if c in names]
        if not wanted:
            raise ValueError("the mesh has none of these constituents")
        self.calls += 1
        found = self.mesh.interpolate(nodes, "node_id", buffer_deg=self.buffer_deg)
        each = F.array(*(F.struct(F.lit(c).alias("constituent"), F.col("re")[names.index(c)].alias("re"), F.col("im")[names.index(c)].alias("im")) for c in wanted))
        rows = found.withColumn("c", each).where(~F.exists("c", lambda x: x["re"].isNull() | x["im"].isNull())).select("node_id", F.inline("c"))
        return rows.select("node_id", "constituent", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2).alias("amp_cm"), F.pmod(F.degrees(F.atan2("im", "re")), F.lit(360.0)).alias("phase_deg"))

    def harmonic(self, nodes: DataFrame) -> Harmonic:
        return Harmonic(self.constants(nodes), [c for c in constituents(self.which) if c in self.mesh.about["constituents"] and c in SPEEDS], astronomical=self.astronomical)

    def parts(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        return self.harmonic(nodes).parts(nodes, times)

    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        return self.harmonic(nodes).levels(nodes, times)


def finite_share(levels: DataFrame, key: str = "node_id") -> DataFrame:
    """key, samples, finite, share of every node of a model's levels."""
    ok = F.count_if(F.col("level").isNotNull() & ~F.isnan("level"))
    return levels.groupBy(key).agg(F.count("*").alias("samples"), ok.alias("finite")).withColumn("share", F.col("finite") / F.col("samples"))

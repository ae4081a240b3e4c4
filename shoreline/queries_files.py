"""Registered queries over files: rasters of the given tables are written as GeoTIFF files in the shared folder and read again."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from shoreline.functions import projections
from shoreline.operators import mesh as mesh_ops
from shoreline.operators import sampling
from shoreline.plans import geoid
from shoreline.queries import PIXELS, PX, WIDTH, pixels, query, r, rd
from shoreline.sources import geotiff
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import scratch

#: The raster of orders in its own place, as PIXELS has it, and the same as a geoid in steps of a tenth of a degree.
BLOCK, TILE = 256, 64


def frame(spark, d) -> Frame:
    rows = rd(spark, d, "orders").agg(F.max("o_orderkey").alias("k")).first()["k"] // WIDTH + 1
    return Frame(122.0, 31.0, PX, PX, WIDTH, rows, nodata=-9999.0)


def written_orders(spark, d) -> str:
    path = scratch(spark, "orders-raster")
    geotiff.write_raster(pixels(spark, d), frame(spark, d), path, dtype="float64", nodata=-9999.0, tags={"SOURCE": "orders"}, block=BLOCK, tile=TILE)
    return path


@query(f"with {PIXELS} select row, col, z from pixels where z is not null and x between 122.0205 and 122.0957 and y between 31.05 and 31.9 and col < 90")
def geotiff_window(spark, d):
    """A box, and a bound on the columns, of a raster in files; see tests/coast/test_geotiff.py for the tiles that are opened."""
    got = geotiff.read_raster(spark, written_orders(spark, d), bbox="122.0205,31.05,122.0957,31.9")
    return got.where("col < 90 and z is not null").select("row", "col", "z")


@query(f"with {PIXELS}, h as (select (max(row) + 1) n from pixels) select (row // {BLOCK} * {BLOCK})::int as row, 0 as col, least({BLOCK}, any_value(n) - row // {BLOCK} * {BLOCK})::int height, {WIDTH} width, count(z)::bigint valid from pixels, h group by row // {BLOCK}")
def geotiff_blocks(spark, d):
    """The blocks of a raster in files, with their pixels that have a value."""
    index = geotiff.read_index(written_orders(spark, d))
    return spark.createDataFrame(index.select(["row", "col", "height", "width", "valid"]))


@query(f"with {PIXELS}, h as (select (max(row) + 1)::int n from pixels) select 'orders-raster' raster, {WIDTH} width, least({BLOCK}, n)::int height, 1 bands, 'EPSG:4326' crs, 'degree' unit, round({PX}::double, 9) a, round({PX}::double, 9) e, round(122.0::double, 6) west, round(31.0::double, 6) south, -9999.0::double nodata, 'float64' dtype, 'orders' source from h")
def geotiff_headers(spark, d):
    """What the first file of the raster says of itself."""
    path = written_orders(spark, d)
    from shoreline.sources.tables import discover

    h = geotiff.headers(discover(spark, path)).where("raster_id like 'block_00000_%'")
    return h.select(F.lit("orders-raster").alias("raster"), "width", "height", "bands", "crs", "unit", r("a", 9).alias("a"), r("e", 9).alias("e"), r("c").alias("west"), r("f").alias("south"), "nodata", "dtype", F.col("tags")["SOURCE"].alias("source"))


_POINTS = f"points as (select c_custkey id, 122.0::double + (c_custkey * 7 % {WIDTH - 1} + 0.5::double + c_custkey % 10 / 10.0::double) * {PX}::double lon, 31.0::double + (c_custkey * 3 % 110 + 0.5::double + c_custkey % 4 / 4.0::double) * {PX}::double lat from customer)"


@query(f"""with {PIXELS}, {_POINTS}, p as (select id, c_custkey * 7 % {WIDTH - 1} i0, c_custkey * 3 % 110 j0, c_custkey % 10 / 10.0::double u, c_custkey % 4 / 4.0::double v from points join customer on id = c_custkey),
 f as (select id, i0 + a i, j0 + b j, case when a = 0 then 1 - u else u end * case when b = 0 then 1 - v else v end w from p, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(a, b)),
 s as (select id, sum(w * z) s, count(*) filter (z is null) gone from f left join pixels on col = i and row = j group by 1) select id, round(case when gone = 0 then s end, 8) as value from s""")
def geotiff_grid_sample(spark, d):
    """Values of a grid in files at places, bilinear."""
    grid, h = geotiff.read_grid(spark, written_orders(spark, d))
    k = F.col("c_custkey")
    points = rd(spark, d, "customer").select(k.alias("id"), (F.lit(122.0) + (k * 7 % (WIDTH - 1) + 0.5 + k % 10 / 10.0) * PX).alias("lon"), (F.lit(31.0) + (k * 3 % 110 + 0.5 + k % 4 / 4.0) * PX).alias("lat"))
    x, y = geotiff.fractional(F.col("lon"), F.col("lat"), h)
    # places on a line fall to either side of it by rounding
    points = points.select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))
    return sampling.bilinear(points, grid, "id", "x", "y").select("id", r("value", 8).alias("value"))


@query(f"with {PIXELS}, q as (select row, col, case when row % 7 <> 0 then z * 0.5::double + 1 end z from pixels), j as (select a.z::float - b.z::float v from pixels a join q b using (row, col)) select count(v)::bigint n, round(min(v)::double, 4) low, round(max(v)::double, 4) high, round(avg(v::double), 4) mean, round(stddev_pop(v::double), 4) spread from j")
def geotiff_geoid_difference(spark, d):
    """Two geoids in files, and their difference in a third, read again."""
    one, two, out = written_orders(spark, d), scratch(spark, "second-geoid"), scratch(spark, "difference")
    other = pixels(spark, d).withColumn("z", F.when(F.col("row") % 7 != 0, F.col("z") * 0.5 + 1))
    geotiff.write_raster(other, frame(spark, d), two, dtype="float64", nodata=-9999.0, block=BLOCK, tile=TILE)
    geoid.write_geoid_difference(spark, one, two, out, "first", "second", block=BLOCK, tile=TILE)
    v = geotiff.read_raster(spark, out).where("z is not null").select(F.col("z").alias("v"))
    return v.agg(F.count("v").alias("n"), r(F.min("v"), 4).alias("low"), r(F.max("v"), 4).alias("high"), r(F.avg("v"), 4).alias("mean"), r(F.stddev_pop("v"), 4).alias("spread"))


# ---------------------------------------------------------------- a mesh of suppliers

#: Suppliers are the nodes of a jittered lattice of five columns, customers the places.
_NODES = """lattice as (select greatest(1, max(s_suppkey) // 5) n from supplier),
 nodes as (select s_suppkey k, s_suppkey, 100.0::double + (s_suppkey % 5 + s_nationkey % 7 / 20.0::double) * 0.5::double lon, 20.0::double + (s_suppkey // 5 + s_suppkey % 4 / 10.0::double) * (50.0::double / n) lat,
   50.0::double + s_acctbal / 100.0::double m2, radians(s_nationkey * 13.0::double) m2p, case when s_suppkey % 19 <> 0 then s_suppkey % 50 + 1.0::double end s2, radians(s_suppkey * 7 % 360 * 1.0::double) s2p from supplier, lattice)"""


@query(f"""with {_NODES}, q as (select a.k, a.k n1, b.k n2, c.k n3, d.k n4 from nodes a join nodes b on b.k = a.k + 1 join nodes c on c.k = a.k + 5 join nodes d on d.k = a.k + 6 where a.k % 5 < 4),
 t as (select 2 * k triangle, n1 a, n2 b, n3 c from q union all select 2 * k + 1, n4, n3, n2 from q),
 g as (select triangle, a, b, c, p.lon x1, p.lat y1, q.lon - p.lon ax, q.lat - p.lat ay, r.lon - p.lon bx, r.lat - p.lat by_ from t join nodes p on p.k = a join nodes q on q.k = b join nodes r on r.k = c),
 pt as (select c_custkey id, 100.0::double + c_custkey * 37 % 1000 / 1000.0::double * 2.3::double x, 20.0::double + c_custkey * 61 % 997 / 997.0::double * 52.0::double y from customer),
 w as (select id, triangle, a, b, c, ((x - x1) * by_ - bx * (y - y1)) / (ax * by_ - bx * ay) l2, (ax * (y - y1) - (x - x1) * ay) / (ax * by_ - bx * ay) l3 from pt join g on abs(x - x1) < 2 and abs(y - y1) <= 4 * (select 50.0::double / n from lattice)),
 h as (select * from w where least(1 - l2 - l3, l2, l3) >= -1e-9 qualify row_number() over (partition by id order by triangle) = 1)
 select id, triangle, {", ".join(f"round((1 - l2 - l3) * p.{c} * {f}(p.{c}p) + l2 * q.{c} * {f}(q.{c}p) + l3 * r.{c} * {f}(r.{c}p), 6) {c}_{n}" for c in ("m2", "s2") for f, n in (("cos", "re"), ("sin", "im")))}
 from h join nodes p on p.k = a join nodes q on q.k = b join nodes r on r.k = c""")
def mesh_constants(spark, d):
    """Constants of a mesh at places: the mesh is written by tiles, and what the box of the places meets is read."""
    s = rd(spark, d, "supplier")
    n = max(1, s.agg(F.max("s_suppkey").alias("k")).first()["k"] // 5)
    k = F.col("s_suppkey").cast("long")
    lon, lat = F.lit(100.0) + (k % 5 + F.col("s_nationkey") % 7 / 20.0) * 0.5, F.lit(20.0) + (F.expr("s_suppkey div 5") + F.col("s_suppkey") % 4 / 10.0) * (50.0 / n)
    nodes = s.select(k.alias("node"), lon.alias("lon"), lat.alias("lat"))
    waves = [("M2", 50.0 + F.col("s_acctbal") / 100.0, F.col("s_nationkey") * 13.0), ("S2", F.when(F.col("s_suppkey") % 19 != 0, F.col("s_suppkey") % 50 + 1.0), F.col("s_suppkey") * 7 % 360 * 1.0)]
    constants = s.select(k.alias("node"), F.inline(F.array(*(F.struct(F.lit(c).alias("constituent"), a.cast("double").alias("amp_cm"), p.cast("double").alias("phase_deg")) for c, a, p in waves))))
    node = F.col("node")
    whole = nodes.select("node").where(node % 5 < 4).join(nodes.select((node - 6).alias("node")), "node", "left_semi")
    triangles = whole.select(F.inline(F.array(F.struct((2 * node).alias("triangle"), F.array(node, node + 1, node + 5).alias("nodes")), F.struct((2 * node + 1).alias("triangle"), F.array(node + 6, node + 5, node + 1).alias("nodes")))))
    path = scratch(spark, "mesh")
    mesh_ops.write_mesh(triangles, nodes, constants, path, ["M2", "S2"])
    c = F.col("c_custkey")
    places = rd(spark, d, "customer").select(c.alias("id"), (F.lit(100.0) + c * 37 % 1000 / 1000.0 * 2.3).alias("lon"), (F.lit(20.0) + c * 61 % 997 / 997.0 * 52.0).alias("lat"))
    mesh = mesh_ops.Mesh(spark, path)
    box = mesh_ops.box_around(places, 0.0)
    with mesh.scope(box):
        triangle = mesh.locate(places, mesh.tables(box)[0], "id").select("id", "triangle")
        found = mesh.interpolate(places, "id", box).join(triangle, "id", "right")
    return found.select("id", "triangle", *(r(F.col(p)[k]).alias(f"{c}_{p}") for k, c in enumerate(("m2", "s2")) for p in ("re", "im")))


# ---------------------------------------------------------------- projections

_E = projections._e(projections.WGS84)
_POLAR = projections.SYSTEMS[3413]
_SCALE = _POLAR._scale()[2]
_STEP = 110.0


def _corner() -> tuple[float, float]:
    """Where the raster of orders begins, in the system of the target, less a few pixels."""
    r, angle = _SCALE * projections._conformal(math.radians(31.0), _E), math.radians(122.064 + 45.0)
    return round(r * math.sin(angle)) - 32 * _STEP, round(-r * math.cos(angle)) + 4 * _STEP


_LAT = "pi() / 2 - 2 * atan(t * pow((1 - {e}::double * sin({l})) / (1 + {e}::double * sin({l})), {e}::double / 2))"


@query(f"""with {PIXELS}, h as (select (max(row) + 1)::int n from pixels), g as (select r as row, c as col, {_corner()[0]}::double + {_STEP}::double * (c + 0.5::double) x, {_corner()[1]}::double - {_STEP}::double * (r + 0.5::double) y from (select unnest(range(0, n)) r from h), (select unnest(range(64)) c)),
 a as (select row, col, degrees(atan2(x, -y)) - 45 lon, sqrt(x * x + y * y) / {_SCALE!r}::double t from g), l0 as (select *, pi() / 2 - 2 * atan(t) l from a), {", ".join(f"l{k} as (select row, col, lon, t, {_LAT.format(e=repr(_E), l='l')} l from l{k - 1})" for k in range(1, 6))},
 f as (select row, col, (((lon - 122.0::double) % 360 + 360) % 360) / {PX}::double - 0.5 fx, (degrees(l) - 31.0::double) / {PX}::double - 0.5 fy from l5),
 c as (select row, col, floor(fx)::bigint i0, floor(fy)::bigint j0, fx - floor(fx) u, fy - floor(fy) v from f),
 w as (select row, col, i0 + a i, j0 + b j, case when a = 0 then 1 - u else u end * case when b = 0 then 1 - v else v end w from c, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(a, b)),
 s as (select w.row, w.col, sum(w * z) s, count(*) filter (z is null) gone from w left join pixels p on p.col = i and p.row = j group by 1, 2) select row::bigint as row, col::bigint as col, round(s, 5) z from s where gone = 0""")
def raster_reprojected(spark, d):
    """The raster of orders on pixels of a polar stereographic one."""
    g = pixels(spark, d).select(F.col("col").alias("i"), F.col("row").alias("j"), F.col("z").alias("val"))
    source = frame(spark, d)
    x, y = _corner()
    target = Frame(x, y, _STEP, -_STEP, 64, source.height, "EPSG:3413", "metre")
    return geoid.reprojected(g, source, target).where("val is not null").select(F.col("j").alias("row"), F.col("i").alias("col"), r("val", 5).alias("z"))

"""Registered queries of sources, grid cells, diagnoses and whole runs; they join the catalogue in shoreline.queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from shoreline.functions import geo, tide, timegrid
from shoreline.operators import cells as cell_ops
from shoreline.operators import datum, gridcells, metrics, sampling
from shoreline.plans import control, products, validation
from shoreline.queries import CELL, CELLS, HEIGHTS, HOURS, KNN, LEVEL, NODES, PIXELS, PLACES, PX, SERIES, WIDTH, cells, heights, height, nodes, pixels, places, query, r, rd, series, support
from shoreline.queries import _XYZ, CLASSED, classed
from shoreline.sources import manifest, rasters, tables

# ---------------------------------------------------------------- sources


def headers(spark, d):
    """Parts as rasters: geographic ones, UTM ones in metres and feet, and broken ones."""
    k = F.col("p_partkey")
    unit = F.when(k % 3 == 0, "degree").when(k % 3 == 1, "metre").otherwise("foot")
    crs = F.when(k % 17 == 0, "").when(k % 3 == 0, "EPSG:4326").otherwise(F.concat(F.lit("EPSG:"), F.lit(32600) + k % 60 + 1))
    step = F.when(k % 3 == 0, F.element_at(F.array(F.lit(0.0002), F.lit(0.005), F.lit(0.25)), (k % 7 % 3 + 1).cast("int"))).otherwise(F.element_at(F.array(F.lit(0.5), F.lit(30.0), F.lit(2000.0)), (k % 7 % 3 + 1).cast("int")))
    return rd(spark, d, "part").select(
        k.alias("raster_id"), F.concat(F.lit("t/"), k, F.lit(".tif")).alias("path"), (F.col("p_size") * 10).cast("int").alias("width"), F.when(k % 23 == 0, 0).otherwise(F.col("p_size") * 20).cast("int").alias("height"), F.lit(1).alias("bands"), crs.alias("crs"), unit.alias("unit"),
        step.alias("a"), F.lit(0.0).alias("b"), (k % 300 * F.lit(0.5)).alias("c"), F.lit(0.0).alias("d"), (-step).alias("e"), (k % 100 * F.lit(0.5)).alias("f"), F.when(k % 2 == 0, -9999.0).alias("nodata"),
    )


HEADERS = """headers as (select p_partkey raster_id, 't/' || p_partkey || '.tif' path, (p_size * 10)::int width, (case when p_partkey % 23 = 0 then 0 else p_size * 20 end)::int height, 1 bands,
  case when p_partkey % 17 = 0 then '' when p_partkey % 3 = 0 then 'EPSG:4326' else 'EPSG:' || (32601 + p_partkey % 60) end crs, case p_partkey % 3 when 0 then 'degree' when 1 then 'metre' else 'foot' end unit,
  case when p_partkey % 3 = 0 then [0.0002::double, 0.005, 0.25][p_partkey % 7 % 3 + 1] else [0.5::double, 30, 2000][p_partkey % 7 % 3 + 1] end a, p_partkey % 300 * 0.5::double c, p_partkey % 100 * 0.5::double f from part),
 sound as (select *, abs(a) res, least(c, c + a * width) west, greatest(c, c + a * width) east, least(f, f - a * height) south, greatest(f, f - a * height) north, case unit when 'metre' then 1.0::double when 'foot' then 0.3048::double else 1.0::double end factor from headers where crs <> '' and width > 0 and height > 0)"""


@query(f"""with {HEADERS} select 'all' as by, 'all' as name, count(*)::bigint n from headers union all select 'valid', (crs <> '' and width > 0 and height > 0)::varchar, count(*) from headers group by 2
 union all select 'crs', crs, count(*) from sound group by 2 union all select 'resolution', printf('%.6fx%.6f', a, a), count(*) from sound group by 2""")
def raster_inventory(spark, d):
    return rasters.inventory(headers(spark, d))


_FAR = "case when {0} >= 1000 then printf('%.2f km', {0} / 1000) when {0} >= 10 then printf('%.1f m', {0}) else printf('%.2f m', {0}) end"
_MX, _MY = "(res * 111320.0::double * greatest(0.001, cos(radians((south + north) / 2))))", "(res * 111320.0::double)"


@query(f"""with {HEADERS} select raster_id, unit <> 'degree' projected, factor unit_factor, round(west, 6) west, round(south, 6) south, round(east, 6) east, round(north, 6) north, width::bigint * height total_pixels,
 case when unit = 'degree' then printf(case when res < 0.001 then '%.6f° × %.6f°' when res < 0.01 then '%.5f° × %.5f°' else '%.4f° × %.4f°' end, res, res) || ' (about ' || {_FAR.format(_MX)} || ' × ' || {_FAR.format(_MY)} || ')'
  when unit = 'foot' then printf('%.2f ft × %.2f ft (about %.2f m × %.2f m)', res, res, res * factor, res * factor) when res >= 1000 then printf('%.2f km × %.2f km', res / 1000, res / 1000) when res < 1 then printf('%.3f m × %.3f m', res, res) else printf('%.2f m × %.2f m', res, res) end resolution from sound""")
def raster_headers(spark, d):
    h = rasters.inspected(headers(spark, d))
    return h.select("raster_id", "projected", "unit_factor", r("west").alias("west"), r("south").alias("south"), r("east").alias("east"), r("north").alias("north"), "total_pixels", rasters.formatted_resolution(h).alias("resolution"))


@query(f"with {PIXELS}, h as (select n_nationkey raster_id, case when n_nationkey % 2 = 0 then -2.0::double end nodata from nation) select raster_id, count(*) filter (z is not null and not coalesce(abs(z - nodata) <= 1e-8 + 1e-5 * abs(nodata), false))::bigint valid_pixels from h left join pixels on pixel % 25 = raster_id group by 1")
def raster_valid_pixels(spark, d):
    n = rd(spark, d, "nation")
    h = n.select(F.col("n_nationkey").alias("raster_id"), F.lit("x").alias("path"), F.lit(9).alias("width"), F.lit(9).alias("height"), F.lit(1).alias("bands"), F.lit("EPSG:4326").alias("crs"), F.lit("degree").alias("unit"), *(F.lit(v).alias(c) for c, v in zip("abcdef", (1.0, 0.0, 0.0, 0.0, -1.0, 0.0), strict=True)), F.when(F.col("n_nationkey") % 2 == 0, -2.0).alias("nodata"))
    p = pixels(spark, d).select((F.col("pixel") % 25).cast("int").alias("raster_id"), "row", "col", "z")
    return rasters.inspected(h, p).select("raster_id", "valid_pixels")


@query(f"""with {PIXELS}, h as (select (max(row) + 1)::int n from pixels), c as (select row, col, z, case when not (row < n * 0.15::double and col < {WIDTH} * 0.15::double) then (-2.5::double + 6.0 * (col / {WIDTH}.0::double) - 1.5 * (row / n::double) + 0.6 * sin(row / 25.0::double) * cos(col / 30.0::double))::float::double end w from pixels, h)
 select row, col, round(z - w, 5) above from c""")
def terrain_coast(spark, d):
    """How far the raster of orders is above a synthetic coast of its size."""
    p = pixels(spark, d)
    rows = p.agg(F.max("row").alias("n")).first()["n"] + 1
    coast = rasters.terrain(spark, "coast", WIDTH, rows).withColumnRenamed("z", "w")
    return p.join(coast, ["row", "col"]).select("row", "col", r(F.col("z") - F.col("w"), 5).alias("above"))


@query(f"with {PIXELS} select row // 16 r_off, col // 16 c_off, count(*)::bigint n, round(sum(z), 4) s from pixels where z is not null group by 1, 2")
def tile_pixels(spark, d):
    """Tiles of 16 x 16 packed into arrays and unpacked again."""
    p = pixels(spark, d)
    t = F.array(*map(F.lit, range(256)))
    packed = p.withColumns({"r": F.expr("row div 16"), "c": F.expr("col div 16"), "k": F.col("row") % 16 * 16 + F.col("col") % 16}).groupBy("r", "c").agg(F.map_from_entries(F.collect_list(F.struct("k", "z"))).alias("m"))
    tiles = packed.select(F.lit(1).alias("raster_id"), (F.col("r") * 16).alias("r_off"), (F.col("c") * 16).alias("c_off"), F.lit(16).alias("w"), F.transform(t, lambda k: F.try_element_at("m", k)).alias("data"))
    out = tables.tiles_to_pixels(tiles).where("z is not null")
    return out.groupBy(F.expr("row div 16").alias("r_off"), F.expr("col div 16").alias("c_off")).agg(F.count("*").alias("n"), r(F.sum("z"), 4).alias("s")).select(F.col("r_off").cast("int").alias("r_off"), F.col("c_off").cast("int").alias("c_off"), "n", "s")


@query("select o_orderkey k, case when o_orderkey % 3 = 0 then 1.7e9::double + o_orderkey when o_orderkey % 3 = 1 then 1704067200.0::double + o_orderkey % 86400 end t from orders")
def parsed_times(spark, d):
    """Epoch seconds and times as text; a small number and a word are neither."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, F.format_string("%.1f", F.lit(1.7e9) + k)).when(k % 3 == 1, F.date_format(F.timestamp_seconds(F.lit(1704067200) + k % 86400), "yyyy-MM-dd HH:mm:ss")).when(k % 2 == 0, "99").otherwise("soon")
    return rd(spark, d, "orders").select(k.alias("k"), timegrid.parse_epoch(text).alias("t"))


@query("select p_partkey k, p_partkey % 5 in (0, 1, 2) msl from part")
def already_msl_tags(spark, d):
    k = F.col("p_partkey")
    tags = F.when(k % 5 == 0, F.create_map(F.lit("DATUM"), F.lit(" msl "))).when(k % 5 == 1, F.create_map(F.lit("ANALYSIS_REFERENCE"), F.lit("MSL"))).when(k % 5 == 2, F.create_map(F.lit("TARGET_VERTICAL_DATUM"), F.lit("Msl"))).when(k % 5 == 3, F.create_map(F.lit("VERTICAL_DATUM"), F.lit("MSL"))).otherwise(F.create_map(F.lit("DATUM"), F.lit("EGM2008")))
    return rd(spark, d, "part").select(k.alias("k"), manifest.already_msl(tags).alias("msl"))


# ---------------------------------------------------------------- geography


@query(f"with {PIXELS} select pixel, round(500000.0::double + 10 * (col + 0.5::double), 4) x, round(3400000.0::double - 10 * (row + 0.5::double), 4) y, col + 0.5::double fc, row + 0.5::double fr from pixels")
def pixel_centers(spark, d):
    p = pixels(spark, d)
    a = (10.0, 0.0, 500000.0, 0.0, -10.0, 3400000.0)
    x, y = geo.pixel_center(F.col("row"), F.col("col"), *a)
    fc, fr = geo.inverse_affine(x, y, *a)
    return p.select("pixel", r(x, 4).alias("x"), r(y, 4).alias("y"), r(fc, 6).alias("fc"), r(fr, 6).alias("fr"))


@query(f"with {PLACES} select id, (lon >= 350 - 1e-6 or lon <= 20 + 1e-6) inside from places")
def box_membership(spark, d):
    """Places in a box of longitudes over the zero meridian."""
    return places(spark, d).select("id", geo.in_boxes(F.col("lon"), 350.0, 380.0).alias("inside"))


@query(f"with {HEIGHTS} select id, case geoid when 'GOCO06s' then id % 7 / 20.0::double when 'EIGEN-6C4' then id % 9 / 10.0::double end dn from heights")
def delta_n_choice(spark, d):
    return heights(spark, d).select("id", datum.delta_n(F.col("geoid"), F.col("delta_n_m"), F.col("id") % 9 / 10.0).alias("dn"))


@query(f"with {PLACES}, b as (select *, case when id % 2 = 0 then 'wide' when id % 3 = 0 then 'west' end parent from places) select id, case when lon >= 100 and lon + 5 <= 200 and lat >= -40 and lat + 5 <= 40 then 1 when lon >= 0 and lon + 5 <= 250 and lat >= -60 and lat + 5 <= 60 then 2 end parent from b")
def parent_box(spark, d):
    """The first loaded box that holds a place's own."""
    p = places(spark, d).select("id", F.col("lon").alias("west"), F.col("lat").alias("south"), (F.col("lon") + 5).alias("east"), (F.col("lat") + 5).alias("north"))
    parents = spark.createDataFrame([(2, 0.0, -60.0, 250.0, 60.0), (1, 100.0, -40.0, 200.0, 40.0)], "n int, west double, south double, east double, north double")
    return gridcells.first_containing(p, parents, "id", "n", 1e-9)


@query(f"with {PLACES}, c as (select id, (floor(lon / 5) * 1000 + floor((lat + 90) / 5))::bigint chunk from places) select id, chunk, dense_rank() over (order by chunk)::int turn from c")
def chunk_turns(spark, d):
    p = places(spark, d).select("id", geo.chunk_key(F.col("lon"), F.col("lat")).alias("chunk"))
    return gridcells.chunk_order(p, "chunk").select("id", "chunk", "turn")


# ---------------------------------------------------------------- grid cells

AX, AY = gridcells.Axis(0.0, 10.0, 36), gridcells.Axis(-85.0, 10.0, 18)


def holed(spark):
    """A grid of 36 x 18 of which two in five are missing, in stripes that leave cells of all kinds."""
    i, j = F.col("id") % 36, F.expr("id div 36")
    return spark.range(648).select(i.alias("i"), j.alias("j"), F.when((i * 7 + j * j * 3 + F.expr("id div 50")) % 5 >= 2, F.col("id") % 97 / 10.0).alias("val"))


HOLED = "holed as (select id % 36 i, id // 36 j, case when ((id % 36) * 7 + (id // 36) * (id // 36) * 3 + id // 50) % 5 >= 2 then id % 97 / 10.0::double end val from (select unnest(range(648)) id))"
_UV = f"""{PLACES}, {HOLED}, p as (select id, lon, lat, case when lon <= 350 then least(34, floor(lon / 10))::bigint end i, case when lat between -85 and 85 then least(16, floor((lat + 85) / 10))::bigint end j from places),
 c as (select p.id, lon, lat, (lon - p.i * 10) / 10 u, (lat + 85 - p.j * 10) / 10 v, a.val v0, b.val v1, c.val v2, d.val v3 from p left join holed a on a.i = p.i and a.j = p.j left join holed b on b.i = p.i + 1 and b.j = p.j left join holed c on c.i = p.i and c.j = p.j + 1 left join holed d on d.i = p.i + 1 and d.j = p.j + 1),
 n as (select *, (v0 is not null)::int + (v1 is not null)::int + (v2 is not null)::int + (v3 is not null)::int n from c)"""
_TRI = {0: ("1 - v", "1 - u", "u + v - 1", "v1", "v2", "v3"), 1: ("1 - v", "v - u", "u", "v0", "v2", "v3"), 2: ("1 - u", "u - v", "v", "v0", "v1", "v3"), 3: ("1 - u - v", "u", "v", "v0", "v1", "v2")}
_IN3 = " ".join(f"when v{k} is null then {a} >= -1e-5 and {b} >= -1e-5 and {c} >= -1e-5" for k, (a, b, c, *_) in _TRI.items())
_VAL3 = " ".join(f"when v{k} is null then ({a}) * {p} + ({b}) * {q} + ({c}) * {s}" for k, (a, b, c, p, q, s) in _TRI.items())
_PAIR = [(a, b) for a in range(4) for b in range(a + 1, 4)]


def _seg(a, b):
    (ax, ay), (bx, by) = (a % 2, a // 2), (b % 2, b // 2)
    t = f"greatest(0, least(1, ((u - {ax}) * kx * ({bx - ax}) * kx + (v - {ay}) * 1110 * ({by - ay}) * 1110) / (({bx - ax}) ** 2 * kx * kx + ({by - ay}) ** 2 * 1110 * 1110)))"
    return f"sqrt(((u - {ax} - {t} * ({bx - ax})) * kx) ** 2 + ((v - {ay} - {t} * ({by - ay})) * 1110) ** 2) <= 0.05", f"(1 - sqrt((u - {ax}) ** 2 + (v - {ay}) ** 2) / sqrt({(bx - ax) ** 2 + (by - ay) ** 2}::double)) * v{a} + sqrt((u - {ax}) ** 2 + (v - {ay}) ** 2) / sqrt({(bx - ax) ** 2 + (by - ay) ** 2}::double) * v{b}"


_ON2 = " ".join(f"when v{a} is not null and v{b} is not null then {_seg(a, b)[0]}" for a, b in _PAIR)
_VAL2 = " ".join(f"when v{a} is not null and v{b} is not null then {_seg(a, b)[1]}" for a, b in _PAIR)


@query(f"""with {_UV}, k as (select *, 1110 * cos(radians(lat)) kx from n), t as (select *, case when n = 4 then 'TYPE_4' when n = 3 then case when case {_IN3} end then 'TYPE_3_INSIDE' else 'TYPE_3_OUTSIDE' end when n = 2 then case when case {_ON2} end then 'TYPE_2_ON_SEGMENT' else 'TYPE_2_OUTSIDE' end when n = 1 then 'TYPE_1' else 'TYPE_0' end kind from k)
 select id, n finite, kind, round(case kind when 'TYPE_4' then (1 - u) * (1 - v) * v0 + u * (1 - v) * v1 + (1 - u) * v * v2 + u * v * v3 when 'TYPE_3_INSIDE' then case {_VAL3} end when 'TYPE_2_ON_SEGMENT' then case {_VAL2} end end, 5) as value from t""")
def mdt_geometry(spark, d):
    """What the valid corners of its cell allow at each place."""
    return gridcells.geometry(places(spark, d), holed(spark), AX, AY, "id").withColumn("value", r("value", 5))


_WHOLE = "whole as (select a.i, a.j from holed a join holed b on b.i = a.i + 1 and b.j = a.j join holed c on c.i = a.i and c.j = a.j + 1 join holed d on d.i = a.i + 1 and d.j = a.j + 1 where a.val is not null and b.val is not null and c.val is not null and d.val is not null)"


#: The raster of orders as a grid, under the name that the conditions above have.
_ORDERS_GRID = f"{PIXELS}, holed as (select col::bigint i, row::bigint j, z val from pixels)"


def orders_grid(spark, d):
    return pixels(spark, d).select(F.col("col").cast("long").alias("i"), F.col("row").cast("long").alias("j"), F.col("z").alias("val"))


@query(f"""with {_ORDERS_GRID}, {_WHOLE}, e as (select i - 1 ni, j nj, i i1, j j1, i i2, j + 1 j2 from whole union all select i + 1, j, i + 1, j, i + 1, j + 1 from whole union all select i, j - 1, i, j, i + 1, j from whole union all select i, j + 1, i, j + 1, i + 1, j + 1 from whole)
 select i1, j1, i2, j2 from e where not exists (select 1 from whole w where w.i = ni and w.j = nj)""")
def validity_border(spark, d):
    """Edges between cells that can be interpolated and cells that can't."""
    return gridcells.boundary_segments(orders_grid(spark, d))


@query(f"with {_ORDERS_GRID}, o as (select i, j, i * 0.5::double + j w from holed), g as (select i, j, holed.val - o.w val from holed join o using (i, j)) select i, j, round(val, 6) val from g")
def grid_difference(spark, d):
    g = orders_grid(spark, d)
    return gridcells.difference(g, g.select("i", "j", (F.col("i") * 0.5 + F.col("j")).alias("val"))).withColumn("val", r("val"))


@query(f"with {PLACES}, g as (select round((lon + 180) % 360 - 180, 6) lon, lat from places) select distinct round(case when lon < 0 then lon + 360 else lon end, 6) lon, lat from g where lat between -40 and 50 and (lon between 120 and 180 or lon between -180 and -110)")
def antimeridian_window(spark, d):
    """Places in a window that crosses the antimeridian."""
    g = places(spark, d).select(F.round(geo.normalize_longitude(F.col("lon"), False), 6).alias("lon"), "lat")
    return gridcells.longitude_window(g, 120.0, -110.0, -40.0, 50.0).select(F.round("lon", 6).alias("lon"), "lat")


_OFFSETS = "select l_orderkey k, l_quantity - 25.5::double dx, l_discount * 100 - 4.5::double dy from lineitem"


@query(f"with a as (select k, degrees(atan2(dy, dx)) a from ({_OFFSETS})), g as (select k, coalesce(lead(a) over w, min(a) over (partition by k) + 360) - a g from a window w as (partition by k order by a)) select k, round(max(g), 4) gap from g group by 1")
def angular_gaps(spark, d):
    """The widest angle without a neighbour: an order's lines lie around it."""
    i = rd(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") - 25.5).alias("dx"), (F.col("l_discount") * 100 - 4.5).alias("dy"))
    return gridcells.angular_gap(i, "k", "dx", "dy").withColumn("gap", r("gap", 4))


@query(f"""with {PLACES}, {KNN}, c as (select dd.*, row_number() over (partition by id order by d, sid) rank from dd where id % 4 = 0 or sid % 3 = 0 or id % 4 = sid % 3) select id, sid, round(d / 1000, 3) km from c where rank = 1""")
def nearest_connected(spark, d):
    """The nearest anchor that lies in the place's component, or where one of the two has none."""
    p = places(spark, d).withColumn("component", F.col("id") % 4)
    a = support(spark, d).withColumn("component", F.col("sid") % 3)
    k = sampling.nearest_connected(p, a, "id", "sid", cell_deg=10.0).where("sid is not null")
    return k.select("id", "sid", r(F.col("d") / 1000, 3).alias("km"))


@query(f"with {PLACES}, {KNN}, k as (select near.id, p.lon a, p.lat b, s.lon c, s.lat e, sid from near join places p using (id) join support s using (sid) where rank = 1) select id, sid, round(sqrt(((a - c) * 111 * cos(radians((b + e) / 2))) ** 2 + ((b - e) * 111) ** 2), 3) km from k")
def nearest_planar(spark, d):
    return validation.nearest_km(places(spark, d), support(spark, d), "id", "sid").withColumn("km", r("km", 3))


# ---------------------------------------------------------------- cells and nodes


@query(f"with {PIXELS}, {CELLS}, h as (select max(row) + 1 n from pixels) select cell_id, (cell_id // 1000 * {CELL})::bigint r0, least((select n from h) - 1, cell_id // 1000 * {CELL} + {CELL - 1})::bigint r1, (cell_id % 1000 * {CELL})::bigint c0, least({WIDTH - 1}, cell_id % 1000 * {CELL} + {CELL - 1})::bigint c1 from cells")
def cell_spans(spark, d):
    """Rows and columns whose centres lie in each cell."""
    p = pixels(spark, d)
    return gridcells.pixel_span(cells(spark, d), 122.0, 31.0, PX, PX, WIDTH, height(p)).select("cell_id", "r0", "r1", "c0", "c1")


@query(f"with {PIXELS}, {CELLS}, {NODES}, {CLASSED}, e as (select cell_id, generate_subscripts(corners, 1) k, unnest(corners) node_id from cells) select cell_id, string_agg(left(class, 1), '' order by k) classes from e left join classed using (node_id) group by 1")
def cell_node_classes(spark, d):
    c = gridcells.cell_classes(cells(spark, d), classed(spark, d))
    return c.select("cell_id", F.array_join(F.transform("classes", lambda x: F.left(x, F.lit(1))), "").alias("classes"))


@query(f"with {PIXELS}, {CELLS}, {NODES}, f as (select cell_id, count(*) filter (valid)::int finite from (select cell_id, unnest(corners) node_id from cells) join nodes using (node_id) group by 1) select finite, count(*)::bigint cells, sum(case when finite < 4 then finite else 0 end)::bigint induced from f group by 1")
def corner_counts(spark, d):
    return metrics.corner_histogram(cells(spark, d), nodes(spark, d).where("valid"))


@query(f"with {PIXELS}, {CELLS} select count(distinct node_id)::bigint nodes from (select unnest(corners) node_id from cells)")
def node_count(spark, d):
    return metrics.distinct_nodes(cells(spark, d))


@query(f"with {PIXELS}, {CELLS}, {NODES} select cell_id, node_id from (select cell_id, unnest(corners) node_id from cells) where node_id not in (select node_id from nodes where node_id % 17 <> 0)")
def unknown_corners(spark, d):
    """Corners that name no node; a sound grid has none."""
    return cell_ops.missing_nodes(cells(spark, d), nodes(spark, d).where("node_id % 17 <> 0"))


@query(f"with {SERIES} select k, count(*)::bigint n, count(h)::bigint valid, (count(*) - count(h))::bigint invalid, min(h) low, max(h) high, round(avg(h), 6) mean, case when count(h) > 0 then 'VALID' else 'INVALID_ALL_NAN' end status from series group by 1")
def smoke_stats(spark, d):
    return metrics.smoke(series(spark, d), "k", "h").withColumn("mean", r("mean"))


@query(f"with {SERIES} select k, count(h) > 0 any_finite, min(case when h > 100 then -1 else 1 end)::int least_flag, count(h)::bigint finite_n, round(count(h)::double / count(*), 6) finite_share from series group by 1")
def node_summary(spark, d):
    s = series(spark, d).withColumn("flag", F.when(F.col("h") > 100, -1).otherwise(1))
    return metrics.node_summary(s, "k", "h").withColumn("finite_share", r("finite_share"))


@query(f"with {PIXELS} select count(*)::bigint total, count(z)::bigint input_valid, count(z) filter (pixel % 6 <> 0)::bigint solved, count(z) filter (pixel % 6 = 0)::bigint unsolved from pixels")
def solved_counts(spark, d):
    return metrics.solved_counts(pixels(spark, d).withColumn("f", F.when(F.col("pixel") % 6 != 0, 1.0).otherwise(float("nan"))), "z", "f")


@query("select distinct n_regionkey from nation where n_regionkey not in (0, 1, 2)")
def domain_check(spark, d):
    """Classes of a mask that it mustn't have."""
    return metrics.outside_domain(rd(spark, d, "nation"), "n_regionkey", [0, 1, 2])


@query("select n_nationkey, round(n_nationkey * 17568.0::double * 8 / 1048576, 6) mb, case when n_nationkey * 17568.0::double * 8 / 1048576 < 1 then printf('%.1f KB', n_nationkey * 17568.0::double * 8 / 1024) else printf('%.2f MB', n_nationkey * 17568.0::double * 8 / 1048576) end size from nation")
def memory_estimate(spark, d):
    mb = metrics.memory_mb(F.col("n_nationkey"), 17568)
    return rd(spark, d, "nation").select("n_nationkey", r(mb).alias("mb"), metrics.formatted_size(mb).alias("size"))


@query("with w as (select c_custkey % 50 / 10.0::double a, case when c_custkey % 3 <> 0 then c_custkey % 70 / 10.0::double end b from customer), s as (select 'nearest' strategy, a km from w union all select 'connected', b from w) select strategy, limit_km, count(*) filter (km <= limit_km)::bigint recovered from s, (values (0.5::double), (1), (2), (4)) l(limit_km) group by 1, 2")
def recovered_nodes(spark, d):
    c = rd(spark, d, "customer").select((F.col("c_custkey") % 50 / 10.0).alias("nearest"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 70 / 10.0).alias("connected"))
    return metrics.recovered(c, ["nearest", "connected"], [0.5, 1, 2, 4])


@query(f"with {PIXELS}, j as (select z a, case when pixel % 31 <> 0 then z + pixel % 7 / 10.0::double end b from pixels) select count(*) filter (a is not null and b is not null)::bigint common, count(*) filter (a is not null and b is null)::bigint only_direct, 0::bigint only_fitted, round(avg(b - a), 5) bias, round(avg(abs(b - a)), 5) mae, round(max(abs(b - a)), 5) worst from j")
def sampled_agreement(spark, d):
    p = pixels(spark, d)
    e = metrics.sampled_agreement(p.select("pixel", F.col("z").alias("v")), p.select("pixel", F.when(F.col("pixel") % 31 != 0, F.col("z") + F.col("pixel") % 7 / 10.0).alias("v")), "pixel", "v")
    return e.select("common", "only_direct", "only_fitted", *(r(c, 5).alias(c) for c in ("bias", "mae", "worst")))


@query("with t as (select p_partkey k, p_type kind, 'tile_' || lpad(p_partkey::varchar, 9, '0') path from part), n as (select *, row_number() over (partition by kind order by path) i from t) select k, kind from n order by case when i = 1 then 0 else 1 end, path limit 5")
def tile_selection(spark, d):
    """The first tile of each kind, then what comes next, five in all."""
    t = rd(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("kind"), F.concat(F.lit("tile_"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("path"))
    return metrics.first_of_each(t, "kind", "path").select("k", "kind")


# ---------------------------------------------------------------- runs


def frame(p) -> rasters.Frame:
    """The orders' raster."""
    return rasters.Frame(122.0, 31.0, PX, PX, WIDTH, height(p))


def _model():
    """A synthetic tide whose level rises steeply east, so that control grids refine."""
    return tide.Synthetic({"ax": 8.0, "by": 5.0, "g": 30.0}, valid=lambda lon, lat: (lon > 122.013) | (lat > 31.02))


DAY = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 2), "1h")
#: The raster grows with the table, and so do its nodes: no limit.
SETTINGS = control.Settings(initial_m=3000.0, least_m=400.0, tolerance=1.0, topology_m=500.0, fraction=0.5, max_nodes=None)


@query()
def control_grid(spark, d):
    """Leaf cells of the orders' raster; tested against a plain quadtree."""
    p = pixels(spark, d)
    g = control.control_grid(p, frame(p), _model(), DAY.times(spark), SETTINGS)["cells"]
    return g.select("cell_id", r("x_min").alias("x_min"), r("y_min").alias("y_min"), r("x_max").alias("x_max"), r("y_max").alias("y_max"), "level", r("error", 4).alias("error"), "cell_qc", F.array_join("corners", ",").alias("corners"))


@query()
def inundation_run(spark, d):
    """Terrain and tide model to frequency and bits of every pixel; tested against direct evaluation."""
    p = pixels(spark, d)
    return products.inundation(p, frame(p), _model(), DAY, SETTINGS).select("row", "col", r("frequency", 4).alias("frequency"), "qc")


@query()
def exposure_run(spark, d):
    """Terrain and tide model over a cache bundle to the exposure products; tested against the state machine."""
    p = pixels(spark, d)
    m = products.exposure(p, frame(p), _model(), DAY, SETTINGS)
    return m.select("row", "col", *(r(c, 4).alias(c) for c in ("valid_h", "exposed_h", "max_h")), "events", *(r(c, 4).alias(c) for c in ("fraction", "mean_h", "valid_time")), "qc")


@query(f"with {PIXELS}, {HOURS}, lv as (select {LEVEL.replace('lon', '122.064::double').replace('lat', '(select 31.0::double + (max(row) + 1) * 0.001::double / 2 from pixels)')}::float h from hours) select row, col, round(100.0::double * count(*) filter (h > z) / count(*), 6) frequency from pixels, lv where z is not null group by 1, 2, pixel union all select row, col, null from pixels where z is null")
def inundation_at_centre(spark, d):
    """The approximation that takes the tide of the raster's centre for all of it."""
    p = pixels(spark, d)
    return products.at_centre(p, frame(p), tide.Synthetic(), DAY).withColumn("frequency", r("frequency"))


@query(f"with {PIXELS}, {HOURS}, w as (select row, col, z, pixel, x lon, y lat, s from pixels, (select 1704067200 + 6 * 3600 s)) select row, col, round(case when z is not null and pixel % 12 <> 0 then ({LEVEL}::float::double + pixel % 5 / 10.0::double)::float::double end, 4) water, (case when z is null then 65535 else case when pixel % 12 = 0 then 8 else 0 end | case when pixel % 9 = 0 then 16 else 0 end end)::int qc from w")
def snapshot_run(spark, d):
    """Water and bits of every pixel at one time, with static offsets of which some are missing or approximate."""
    p = pixels(spark, d)

    def offset(n):
        k = F.col("node_id")
        return n.select("node_id", F.when(k % 12 != 0, k % 5 / 10.0).alias("offset"), (k % 9 == 0).alias("approx"))

    s = products.snapshot(p, frame(p), tide.Synthetic(), datetime(2024, 1, 1, 6), offset)
    return s.select("row", "col", r(F.col("water").cast("double"), 4).alias("water"), F.col("qc").cast("int").alias("qc"))


@query(f"""with {PLACES}, {KNN.replace("from support)", "from support where sid % 5 <> 0)")}, t as (select sid id, val truth, {_XYZ} from support where sid % 5 = 0),
 h as (select id, truth, ss.sid, ss.val, sqrt((t.x - ss.x) ** 2 + (t.y - ss.y) ** 2 + (t.z - ss.z) ** 2) d from t, ss), n as (select *, row_number() over (partition by id order by d, sid) rank, min(d) over (partition by id) d0 from h),
 m as (select k.method, id, truth, case when min(d0) <= 500000 then case when min(d0) < 1e-4 then min_by(val, d) else sum(case when d >= 1e-4 then val / (d * d) end) / sum(case when d >= 1e-4 then 1 / (d * d) end) end end v from n, (values ('nearest', 1), ('idw4', 4), ('idw8', 8)) k(method, k) where rank <= k.k group by 1, 2, 3)
 select method, count(*)::bigint n, round(avg(v - truth), 5) bias, round(avg(abs(v - truth)), 5) mae from m where v is not null group by 1""")
def edge_holdout(spark, d):
    """Anchors that are held out, predicted from the others by three methods."""
    e = validation.holdout(support(spark, d), "sid", "val", F.col("sid") % 5 == 0, 10.0)
    return e.select("method", "n", *(r(c, 5).alias(c) for c in ("bias", "mae")))


@query()
def block_holdout(spark, d):
    """Every anchor predicted from those of other squares; tested by hand."""
    e = validation.blockwise(support(spark, d), "sid", "val", 30.0, 10.0)
    return e.select("method", "n", *(r(c, 5).alias(c) for c in ("bias", "mae")))


@query(f"""with {SERIES}, i as (select *, row_number() over (partition by k order by t) i from series), q as (select k, unnest(quantile_cont(h, [0.1, 0.25, 0.5, 0.75, 0.9])) z from series group by 1),
 f as (select q.k, q.z, 100.0::double * count(*) filter (h::float >= q.z) / nullif(count(h), 0) b, 100.0::double * count(*) filter (h::float >= q.z and i % 2 = 1) / nullif(count(h) filter (i % 2 = 1), 0) a from q join i on q.k = i.k group by 1, 2)
 select count(*)::bigint n, round(avg(a - b), 4) bias, round(avg(abs(a - b)), 4) mae, round(max(abs(a - b)), 4) worst from f where a is not null and b is not null""")
def sensitivity_quantiles(spark, d):
    """What every other sample does to the frequencies at each station's own quantiles."""
    from pyspark.sql.window import Window

    e = series(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("t"))).drop("z")
    s = validation.sensitivity(e, e.where("i % 2 = 1"), "k", "h", [0.1, 0.25, 0.5, 0.75, 0.9])
    return s.select("n", *(r(c, 4).alias(c) for c in ("bias", "mae", "worst")))


@query()
def profile_basins(spark, d):
    """The run over two basins with a barrier between them, on the heights of orders."""
    p = pixels(spark, d).where("z is not null").select("row", "col", "z")
    rows = p.agg(F.max("row").alias("n")).first()["n"] + 1
    frame = rasters.Frame(120.2 - WIDTH * 0.001, 30.0, 0.002, -0.0002, WIDTH, rows)
    return validation.profile(spark, "basins", frame=frame, pixels=p).select("row", "col", r("frequency", 4).alias("frequency"), "qc")


_MAJOR = ", ".join(str(k) for k, c in enumerate(tide.SPEEDS) if c in tide.MAJOR)
_SPEED = " ".join(f"when {k} then {s}::double" for k, (s, _) in enumerate(tide.SPEEDS.values()))
_STUDY_ERR = "count(*)::bigint n, round(avg(a - b), 4) bias, round(avg(abs(a - b)), 4) mae, round(sqrt(avg((a - b) ** 2)), 4) rmse, round(quantile_cont(abs(a - b), 0.9), 4) p90, round(quantile_cont(abs(a - b), 0.99), 4) p99, round(max(abs(a - b)), 4) worst"


@query(f"""with c as (select s_suppkey node_id, unnest(range(34)) k from supplier), h as (select node_id, k in ({_MAJOR}) major, (node_id * 7 + k * 13) % 100 / 4.0::double amp, (node_id * 31 + k * 17) % 360 * 1.0::double ph, case k {_SPEED} end sp from c),
 s as (select node_id, i, (sum(amp * cos(radians(sp * (i / 2.0::double) - ph))) / 100)::float::double h, (sum(case when major then amp * cos(radians(sp * (i / 2.0::double) - ph)) else 0.0::double end) / 100)::float::double m from h, (select unnest(range(480)) i) group by 1, 2),
 q as (select node_id, unnest(quantile_cont(h, {validation.STUDY_QUANTILES})) z from s group by 1),
 f as (select q.node_id, z, 100.0::double * avg((h >= z)::int) h1, 100.0::double * avg((h >= z)::int) filter (i % 2 = 0) h2, 100.0::double * avg((h >= z)::int) filter (i % 4 = 0) h4, 100.0::double * avg((m >= z)::int) m1, 100.0::double * avg((m >= z)::int) filter (i % 2 = 0) m2 from q join s using (node_id) group by 1, 2),
 e as (select 'step2' comparison, h2 a, h1 b from f union all select 'step4', h4, h1 from f union all select 'least', m1, h1 from f union all select 'least_step2', m2, h2 from f)
 select comparison, {_STUDY_ERR} from e group by 1""")
def sensitivity_study(spark, d):
    """What longer steps and fewer constituents do to the frequencies of ten days at suppliers."""
    s = rd(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    k = F.col("k")
    table = s.select("node_id", F.posexplode(F.array(*map(F.lit, tide.SPEEDS))).alias("k", "constituent")).select("node_id", "constituent", ((F.col("node_id") * 7 + k * 13) % 100 / 4.0).alias("amp_cm"), ((F.col("node_id") * 31 + k * 17) % 360 * F.lit(1.0)).alias("phase_deg"))
    window = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 11), "30min")
    e, _ = validation.sensitivity_study(s, lambda which: tide.Harmonic(table, which, origin=1704067200.0), window, list(tide.MAJOR))
    return e.select("comparison", "n", *(r(c, 4).alias(c) for c in ("bias", "mae", "rmse", "p90", "p99", "worst")))

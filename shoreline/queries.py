"""Registered queries: every operator over the given tables, read as stations, rasters, nodes and cells, with SQL that gives the
same rows.

events are water levels (user_id a station); orders a raster of 128 columns (o_orderkey a pixel, o_totalprice its height); nodes and
cells are laid over that raster every 8 pixels; customers and suppliers are places. Rounding makes both engines print alike.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.functions import geo, places as known_places, qc, tide, timegrid
from shoreline.operators import cells as cell_ops
from shoreline.operators import datum, exposure, frequency, metrics, peaks, quadtree, sampling, topology
from shoreline.sources import bundle, manifest, tables

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rd(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, n: int = 6):
    """Rounded as SQL engines do it, halves of the scaled double away from zero, and never a negative zero. F.round() alone goes by the shortest decimal text."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double") * F.lit(10.0**n), 0) / F.lit(10.0**n) + F.lit(0.0)


# ---------------------------------------------------------------- inputs and the same in SQL

WIDTH, CELL, PX = 128, 8, 0.001


def series(spark, d):
    e = rd(spark, d, "events")
    return e.select(F.col("user_id").alias("k"), timegrid.seconds(F.col("ts")).alias("t"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("h"), (F.col("user_id") % 7 * 30 + F.lit(50.0)).alias("z"))


SERIES = "series as (select user_id k, epoch_us(ts) / 1e6 t, case when event_id % 17 <> 0 then value end h, 50.0::double + user_id % 7 * 30 z from events)"


def pixels(spark, d):
    o = rd(spark, d, "orders")
    row, col = F.expr(f"cast(o_orderkey div {WIDTH} as int)"), (F.col("o_orderkey") % WIDTH).cast("int")
    x, y = F.lit(122.0) + (col + F.lit(0.5)) * PX, F.lit(31.0) + (row + F.lit(0.5)) * PX
    return o.select(F.col("o_orderkey").alias("pixel"), row.alias("row"), col.alias("col"), F.when(F.col("o_orderkey") % 23 != 0, F.floor(F.col("o_totalprice") / 10.0) / 10000.0 - 2.0).alias("z"), x.alias("x"), y.alias("y"))


PIXELS = f"""pixels as (select o_orderkey pixel, (o_orderkey // {WIDTH})::int row, (o_orderkey % {WIDTH})::int col, case when o_orderkey % 23 <> 0 then floor(o_totalprice / 10.0::double) / 10000.0::double - 2.0::double end z,
   122.0::double + ((o_orderkey % {WIDTH})::int + 0.5::double) * {PX}::double x, 31.0::double + ((o_orderkey // {WIDTH})::int + 0.5::double) * {PX}::double y from orders)"""


def cells(spark, d):
    p = pixels(spark, d).select(F.expr(f"row div {CELL}").cast("long").alias("r"), F.expr(f"col div {CELL}").cast("long").alias("c")).distinct()
    node = lambda a, b: (F.col("r") + a) * 1000 + F.col("c") + b
    edge = lambda k, o, base: F.lit(base) + (F.col(k) + o) * F.lit(CELL * PX)
    return p.select((F.col("r") * 1000 + F.col("c")).alias("cell_id"), edge("c", 0, 122.0).alias("x_min"), edge("r", 0, 31.0).alias("y_min"), edge("c", 1, 122.0).alias("x_max"), edge("r", 1, 31.0).alias("y_max"), F.array(node(0, 0), node(0, 1), node(1, 0), node(1, 1)).alias("corners"), (F.col("r") % 4).cast("int").alias("level"), F.when(F.col("c") % 5 == 0, qc.MIN_SPACING).otherwise(0).alias("cell_qc"))


CELLS = f"""cells as (select r * 1000 + c cell_id, 122.0::double + c * {CELL * PX}::double x_min, 31.0::double + r * {CELL * PX}::double y_min, 122.0::double + (c + 1) * {CELL * PX}::double x_max, 31.0::double + (r + 1) * {CELL * PX}::double y_max,
   [r * 1000 + c, r * 1000 + c + 1, (r + 1) * 1000 + c, (r + 1) * 1000 + c + 1] corners, (r % 4)::int as level, case when c % 5 = 0 then 32 else 0 end cell_qc from (select distinct (row // {CELL})::bigint r, (col // {CELL})::bigint c from pixels))"""


def nodes(spark, d):
    n = cells(spark, d).select(F.explode("corners").alias("node_id")).distinct()
    R, C = F.expr("node_id div 1000"), F.col("node_id") % 1000
    comp = F.when(C < 8, 1).when(C > 8, 2).otherwise(0)
    return n.select("node_id", (F.lit(122.0) + C * F.lit(CELL * PX)).alias("lon"), (F.lit(31.0) + R * F.lit(CELL * PX)).alias("lat"), (F.col("node_id") % 11 != 0).alias("valid"), comp.alias("component_id"), F.when(F.col("node_id") % 5 == 0, qc.DATUM_APPROX).otherwise(0).alias("qc"))


NODES = f"""nodes as (select node_id, 122.0::double + node_id % 1000 * {CELL * PX}::double lon, 31.0::double + node_id // 1000 * {CELL * PX}::double lat, node_id % 11 <> 0 valid, case when node_id % 1000 < 8 then 1 when node_id % 1000 > 8 then 2 else 0 end component_id, case when node_id % 5 = 0 then 16 else 0 end qc
   from (select distinct unnest(corners) node_id from cells))"""


def hours(spark, n: int = 24):
    return spark.range(n).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("t"))


HOURS = "hours as (select 1704067200 + unnest(range(24)) * 3600 s)"
LEVEL = "(0.0::double + 2.0::double * cos(2 * pi() * (s / 3600.0::double) / 12.42::double) + 0.05::double * (lon - 122.0::double) + 0.03::double * (lat - 31.0::double) + 0.01::double * ((lon - 122.0::double) * (lon - 122.0::double) + (lat - 31.0::double) * (lat - 31.0::double)))"
TIDE = f"tide as (select node_id, s, {LEVEL}::float as level from nodes, hours)"


def node_tide(spark, d):
    return tide.Synthetic().levels(nodes(spark, d), hours(spark))


def pixel_component():
    return F.when(F.col("pixel") % 10 == 0, 0).when(F.col("x") < 122.064, 1).otherwise(2)


COMPONENT = "case when pixel % 10 = 0 then 0 when x < 122.064::double then 1 else 2 end"


def weighted(spark, d):
    p = pixels(spark, d).where("z is not null")
    m = cell_ops.membership(p, cells(spark, d), "pixel", 1e9, 1e9, CELL * PX)
    w = cell_ops.corner_weights(m, "pixel").join(m.select("pixel", "x", pixel_component().alias("component")).drop("x"), "pixel")
    return cell_ops.usable_corners(w, nodes(spark, d), "pixel"), p


def raster_rows(spark, d):
    from shoreline.plans import blocks

    return blocks.placed(pixels(spark, d).withColumn("component", pixel_component()), cells(spark, d), nodes(spark, d), "pixel", 1e9, 1e9, CELL * PX)


WEIGHTS = f"""member as (select pixel, x, y, z, {COMPONENT} p, cell_id, cell_qc, corners, greatest(0.0::double, least(1.0::double, (x - x_min) / (x_max - x_min))) u, greatest(0.0::double, least(1.0::double, (y - y_min) / (y_max - y_min))) v
     from pixels join cells on x >= x_min and x < x_max and y >= y_min and y < y_max where z is not null),
   corner as (select pixel, z, p, cell_id, cell_qc, unnest(range(4)) corner, corners, [(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v] w from member),
   cw as (select pixel, z, p, cell_id, cell_qc, corner, corners[corner + 1] node_id, w[corner + 1] weight from corner),
   cn as (select cw.*, valid, component_id comp, nodes.qc node_qc from cw join nodes using (node_id)),
   cs as (select *, count(*) filter (valid) over q n, count(*) filter (valid and comp = p) over q own, min(case when valid and comp > 0 then comp end) over q low, max(case when valid and comp > 0 then comp end) over q high from cn window q as (partition by pixel)),
   cu as (select *, case when p > 0 then case when own > 0 then valid and comp = p else valid and low is null end else valid and coalesce(low = high, true) end use from cs),
   ct as (select *, count(*) filter (use) over q usable, sum(case when use then weight end) over q total from cu window q as (partition by pixel)),
   corners_used as (select *, weight / case when total > 1e-9 then total else 1.0::double end share, p > 0 and usable > 0 and case when own > 0 then own < n else true end connectivity, usable between 1 and 3 spatial from ct)"""


def height(p) -> int:
    """Rows of the raster, as far as it has pixels."""
    return p.agg(F.coalesce(F.max("row"), F.lit(-1)) + 1).first()[0]


# ---------------------------------------------------------------- frequency


@query(f"with {SERIES}, s as (select user_id k, unnest([20, 60, 120, 240])::double z from (select distinct user_id from events)) select s.k, s.z, count(h)::bigint n, round(100.0::double * count(*) filter (h::float > s.z) / nullif(count(h), 0), 6) frequency from s join series on s.k = series.k group by 1, 2")
def inundation_frequency(spark, d):
    """Share of samples above four heights at every station (the flagship)."""
    e = series(spark, d)
    z = e.select("k").distinct().select("k", F.explode(F.array(*map(F.lit, (20.0, 60.0, 120.0, 240.0)))).alias("z"))
    return frequency.frequency(e, z, "k", "h").select("k", "z", "n", r("frequency").alias("frequency"))


@query(f"with {SERIES}, s as (select user_id k, unnest([20, 60, 120, 240])::float z from (select distinct user_id from events)) select s.k, s.z::double z, round(100.0::double * count(*) filter (h::float > s.z) / nullif(count(h), 0), 6) frequency from s join series on s.k = series.k group by 1, 2")
def inundation_frequency_packed(spark, d):
    p = frequency.packed(series(spark, d), "k", "h")
    return p.select("k", "levels", F.explode(F.array(*map(F.lit, (20.0, 60.0, 120.0, 240.0)))).alias("z")).select("k", "z", r(frequency.packed_frequency(F.col("levels"), F.col("z"))).alias("frequency"))


def noisy(spark, d):
    """The series with samples that aren't numbers: every 13th second is NaN, every 29th infinite."""
    s = F.floor("t")
    return series(spark, d).withColumn("h", F.when(s % 13 == 0, F.lit(float("nan"))).when(s % 29 == 0, F.lit(float("inf"))).otherwise(F.col("h")))


#: The same; what isn't finite is none.
NOISY = f"{SERIES}, noisy as (select k, t, case when floor(t) % 13 <> 0 and floor(t) % 29 <> 0 then h end h from series)"


@query(f"with {NOISY} select k, t, round(1 - cume_dist() over (partition by k order by h), 6) share_above from noisy where h is not null")
def empirical_rank(spark, d):
    return frequency.empirical_rank(noisy(spark, d), "k", "h", "t").select("k", "t", r("share_above").alias("share_above"))


@query(f"with {NOISY} select k, max(h) high, min(h) low, round(max(h) - min(h), 6) as range from noisy group by 1")
def tide_extremes(spark, d):
    return frequency.extremes(noisy(spark, d), "k", "h").select("k", "high", "low", r("range").alias("range"))


# ---------------------------------------------------------------- exposure


def _exposure_sql(source: str, extra: str = "") -> str:
    return f"""iv as (select k, z, t t0, h h0, lead(t) over w t1, lead(h) over w h1 from {source} window w as (partition by k order by t)),
     c as (select *, t1 - t0 dt, case when h0 is null or h1 is null then 'N' when h0 <= z and h1 <= z then 'A' when h0 > z and h1 > z then 'B' when h0 > z then 'C' else 'D' end st from iv where t1 > t0),
     e as (select *, case st when 'A' then dt when 'C' then (1 - (h0 - z) / (h0 - h1)) * dt when 'D' then (z - h0) / (h1 - h0) * dt else 0.0::double end ex,
              sum(case when st in ('N', 'B', 'C') then 1 else 0 end) over (partition by k order by t0 rows unbounded preceding) isl from c),
     i as (select k, isl, sum(ex) dur, max(case when st = 'D' then 1 else 0 end) has_d, sum(case when st <> 'N' then dt else 0 end) vd from e group by 1, 2),
     g as (select k, sum(vd) / 3600 v, sum(dur) / 3600 x, max(dur) / 3600 m, count(*) filter (has_d = 1 or dur > 0) n from i group by 1),
     s as (select k, (max(t) - min(t)) / 3600 w from {source} group by 1),
     m as (select k, coalesce(v, 0) v, coalesce(x, 0) x, coalesce(m, 0) m, case when coalesce(x, 0) <= 1e-6 then 0 else n end n, w from s left join g using (k))"""


_MEASURES = "round(v, 4) valid_h, round(x, 4) exposed_h, round(m, 4) max_h, n::bigint events, round(coalesce(100 * x / nullif(v, 0), 0), 4) fraction, round(coalesce(x / nullif(n, 0), 0), 4) mean_h, round(coalesce(100 * v / nullif(w, 0), 0), 4) valid_time"


def _measures(m):
    return m.select("k", *(r(c, 4).alias(c) for c in ("valid_h", "exposed_h", "max_h")), "events", *(r(c, 4).alias(c) for c in ("fraction", "mean_h", "valid_time")))


@query(f"with {SERIES}, {_exposure_sql('series')} select k, {_MEASURES} from m")
def exposure_metrics(spark, d):
    return _measures(exposure.metrics(series(spark, d), "k"))


TERMINAL = "closed as (select k, t, h, z from series union all select k, max(t) + 1800, 10.0::double, max(z) from series group by 1)"


def _closed(spark, d):
    s = series(spark, d)
    end = s.groupBy("k").agg((F.max("t") + 1800.0).alias("t"), F.lit(10.0).alias("h"), F.max("z").alias("z"))
    return exposure.with_terminal(s, end)


@query(f"with {SERIES}, {TERMINAL}, {_exposure_sql('closed')} select k, {_MEASURES} from m")
def exposure_terminal(spark, d):
    return _measures(exposure.metrics(_closed(spark, d), "k"))


@query(f"with {SERIES}, {_exposure_sql('series')} select k, (case when x <= 1e-6 then 32 else 0 end | case when abs(x - v) <= 1e-4 then 64 else 0 end | case when coalesce(100 * v / nullif(w, 0), 0) < 99.99 then 16 else 0 end)::int qc from m")
def exposure_qc(spark, d):
    m = exposure.metrics(series(spark, d), "k")
    return m.select("k", exposure.quality(m).cast("int").alias("qc"))


# ---------------------------------------------------------------- time and places


def _samples_by_step(spark, d, grid, step):
    """t and n, the samples of all stations that fall into each step of a grid."""
    at = rd(spark, d, "events").groupBy((F.floor(timegrid.seconds(F.col("ts")) / step) * step).cast("long").alias("s")).agg(F.count("*").alias("n"))
    g = grid.withColumn("s", timegrid.seconds(F.col("t")).cast("long"))
    return g.join(at, "s", "left").select(F.col("t").cast("timestamp_ntz").alias("t"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("""with w as (select date_trunc('day', min(ts)) a, date_trunc('day', max(ts)) + interval 1 day b from events), g as (select unnest(generate_series(a, b - interval 30 minute, interval 30 minute)) t from w),
 e as (select floor(epoch_us(ts) / 1e6 / 1800)::bigint k, count(*) n from events group by 1) select t::timestamp t, coalesce(n, 0)::bigint n from g left join e on k = epoch_us(t) // 1800000000""")
def time_grid_half_open(spark, d):
    """The samples in each half hour of the days that have any."""
    a, b = rd(spark, d, "events").select(F.date_trunc("day", F.min(F.col("ts").cast("timestamp_ntz"))), F.date_trunc("day", F.max(F.col("ts").cast("timestamp_ntz"))) + F.expr("interval 1 day")).first()
    return _samples_by_step(spark, d, timegrid.time_grid(spark, a.replace(tzinfo=None), b.replace(tzinfo=None), "30min", "left"), 1800)


@query("""with g as (select unnest(generate_series(timestamp '2024-03-10 05:00:00', timestamp '2024-03-11 04:00:00', interval 1 hour)) t), e as (select floor(epoch_us(ts) / 1e6 / 3600)::bigint k, count(*) n from events group by 1)
 select t, coalesce(n, 0)::bigint n from g left join e on k = epoch_us(t) // 3600000000""")
def time_grid_inclusive(spark, d):
    """The samples in each hour of a New York day with a spring clock change, both ends included."""
    return _samples_by_step(spark, d, timegrid.time_grid(spark, datetime(2024, 3, 10), datetime(2024, 3, 11), "1h", "both", "America/New_York"), 3600)


@query("select c_custkey, c_acctbal::double lon, round(((c_acctbal % 360) + 360) % 360, 6) east, round((((c_acctbal + 180) % 360) + 360) % 360 - 180, 6) signed from customer")
def lon_normalize(spark, d):
    c = rd(spark, d, "customer")
    return c.select("c_custkey", F.col("c_acctbal").alias("lon"), r(geo.normalize_longitude(F.col("c_acctbal"))).alias("east"), r(geo.normalize_longitude(F.col("c_acctbal"), False)).alias("signed"))


def places(spark, d):
    """Customers as places."""
    c = rd(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 3600 / 10.0).alias("lon"), (F.col("c_custkey") * 53 % 1700 / 10.0 - 85.0).alias("lat"), "c_nationkey", "c_acctbal")


PLACES = "places as (select c_custkey id, c_custkey * 37 % 3600 / 10.0::double lon, c_custkey * 53 % 1700 / 10.0::double - 85.0::double lat, c_nationkey, c_acctbal from customer)"


@query(f"with {PLACES} select id, (floor(lon / 5) * 1000 + floor((lat + 90) / 5))::bigint chunk from places")
def spatial_chunk_key(spark, d):
    return places(spark, d).select("id", geo.chunk_key(F.col("lon"), F.col("lat")).alias("chunk"))


@query(f"""with {PLACES}, p as (select distinct c_nationkey, lon from places), g as (select *, coalesce(lead(lon) over w, min(lon) over (partition by c_nationkey) + 360) nxt from p window w as (partition by c_nationkey order by lon)),
 b as (select *, row_number() over (partition by c_nationkey order by round(nxt - lon, 9) desc, lon) i from g)
 select c_nationkey, round(360 - (nxt - lon), 6) span, round(nxt % 360, 6) as start from b where i = 1""")
def circular_span(spark, d):
    p = places(spark, d)
    p = p.withColumn("lon", F.round("lon", 9))
    return geo.circular_span(p, "lon", "c_nationkey").select("c_nationkey", r("span").alias("span"), r("start").alias("start"))


# ---------------------------------------------------------------- tide


@query(f"with {PIXELS}, {CELLS}, {NODES}, {HOURS} select node_id, make_timestamp(s * 1000000) t, round({LEVEL}, 4) as level from nodes, hours")
def tide_synthetic_field(spark, d):
    n = nodes(spark, d)
    n = n.crossJoin(F.broadcast(hours(spark)))
    return n.select("node_id", F.col("t").cast("timestamp_ntz").alias("t"), r(tide.synthetic_level(timegrid.seconds(F.col("t")) / 3600.0, F.col("lon"), F.col("lat")), 4).alias("level"))


@query(f"with {PLACES}, {HOURS}, p as (select id, 120 + id % 40 / 100.0::double lon from places), w as (select *, 0.5::double * cos(2 * pi() * (s / 3600.0::double) / 12.0::double) c from p, hours) select id, make_timestamp(s * 1000000) t, round(case when lon < 120.155 then 1.5::double + c when lon > 120.245 then c - 1.5::double end, 4) as level from w")
def tide_two_basin(spark, d):
    p = places(spark, d)
    p = p.select("id", (F.lit(120.0) + F.col("id") % 40 / 100.0).alias("lon")).crossJoin(F.broadcast(hours(spark)))
    return p.select("id", F.col("t").cast("timestamp_ntz").alias("t"), r(tide.two_basin_level(timegrid.seconds(F.col("t")) / 3600.0, F.col("lon")), 4).alias("level"))


_LONG = ", ".join(str(k) for k, (_, slow) in enumerate(tide.SPEEDS.values()) if slow)
_SPEED = " ".join(f"when {k} then {s}::double" for k, (s, _) in enumerate(tide.SPEEDS.values()))


@query(f"""with {HOURS}, c as (select s_suppkey node_id, unnest(range(34)) k from supplier), h as (select node_id, k in ({_LONG}) lp, (node_id * 7 + k * 13) % 100 / 4.0::double amp, (node_id * 31 + k * 17) % 360 * 1.0::double ph, case k {_SPEED} end sp from c)
 select node_id, make_timestamp(s * 1000000) t, round(sum(case when not lp then amp * cos(radians(sp * ((s - 1704067200.0::double) / 3600.0::double) - ph)) else 0.0::double end), 4) short_cm, round(sum(case when lp then amp * cos(radians(sp * ((s - 1704067200.0::double) / 3600.0::double) - ph)) else 0.0::double end), 4) long_cm from h, hours group by 1, 2""")
def tide_harmonic_series(spark, d):
    names = F.array(*map(F.lit, tide.SPEEDS))
    s = rd(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"))
    table = s.select("node_id", F.posexplode(names).alias("k", "constituent")).select("node_id", "constituent", ((F.col("node_id") * 7 + F.col("k") * 13) % 100 / 4.0).alias("amp_cm"), ((F.col("node_id") * 31 + F.col("k") * 17) % 360 * F.lit(1.0)).alias("phase_deg"))
    parts = tide.Harmonic(table, origin=1704067200.0).parts(s, hours(spark))
    return parts.select("node_id", F.col("t").cast("timestamp_ntz").alias("t"), r("short_cm", 4).alias("short_cm"), r("long_cm", 4).alias("long_cm"))


@query(f"with {SERIES}, p as (select k, t, h, lag(h) over w a, lead(h) over w b from series window w as (partition by k order by t)), x as (select k, t, h, case when h > a and h > b then 'high' when h < a and h < b then 'low' end kind from p), y as (select *, row_number() over (partition by k, kind order by case when kind = 'high' then -h else h end, t)::int rank from x where kind is not null) select k, t, h, kind, rank from y where rank <= 2")
def tide_high_low_water(spark, d):
    return peaks.top_of_each(peaks.local_extremes(series(spark, d), "k", "t", "h"), "k")


@query()
def tide_peaks_thinned(spark, d):
    """High and low waters thinned by distance; tested against a definition by hand."""
    return peaks.high_low_water(series(spark, d), "k", 1.0)


# ---------------------------------------------------------------- datum


def heights(spark, d):
    p = places(spark, d)
    return p.select("id", "lon", "lat", (F.col("c_acctbal") / 10000.0).alias("tide_m"), F.when(F.col("id") % 13 != 0, F.col("id") % 19 / 10.0).alias("mdt_m"), (F.col("id") % 7 / 20.0).alias("delta_n_m"), (F.col("id") % 31 / 2.0).alias("n_egm2008_m"), F.when(F.col("id") % 3 == 0, datum.EIGEN).otherwise(datum.GOCO).alias("geoid"))


HEIGHTS = f"{PLACES}, heights as (select id, lon, lat, c_acctbal / 10000.0::double tide_m, case when id % 13 <> 0 then id % 19 / 10.0::double end mdt_m, id % 7 / 20.0::double delta_n_m, id % 31 / 2.0::double n_egm2008_m, case when id % 3 = 0 then 'EIGEN-6C4' else 'GOCO06s' end geoid from places)"


@query(f"with {HEIGHTS} select id, round(0.0::double, 6) msl, round(mdt_m, 6) mdt_ref, round(mdt_m + delta_n_m, 6) egm2008, round(mdt_m + delta_n_m + n_egm2008_m, 6) wgs84, round(mdt_m + delta_n_m, 6) as all from heights".replace(" as all ", ' as "all" '))
def datum_offsets(spark, d):
    h = heights(spark, d)
    return h.select("id", *(r(datum.static_offset(t, F.col("mdt_m"), F.col("delta_n_m"), F.col("n_egm2008_m"))).alias(t) for t in ("msl", "mdt_ref", "egm2008", "wgs84", "all")))


@query(f"with {HEIGHTS} select id, round(tide_m, 6) tide_msl_m, round(tide_m + mdt_m, 6) h_mdt_ref_m, round(case when geoid = 'GOCO06s' then tide_m + mdt_m end, 6) h_goco06s_m, round(tide_m + mdt_m + delta_n_m, 6) h_egm2008_m, round(tide_m + mdt_m + delta_n_m + n_egm2008_m, 6) h_wgs84_m from heights")
def datum_convert_all(spark, d):
    return datum.convert(heights(spark, d), "all").select("id", *(r(c).alias(c) for c in ("tide_msl_m", "h_mdt_ref_m", "h_goco06s_m", "h_egm2008_m", "h_wgs84_m")))


@query(f"with {PIXELS}, p as (select pixel, case when pixel % 31 <> 0 then z end z, case when pixel % 37 <> 0 then pixel % 5 / 10.0::double end m, case when pixel % 41 <> 0 then pixel % 3 / 20.0::double end dn, case when pixel % 29 = 0 then 2 when pixel % 4 = 0 then 1 else 0 end q from pixels) select pixel, round(z - m - dn, 6) z_msl, q qc from p where z + m + dn is not null and q <> 2 union all select pixel, null, 2 from p where z + m + dn is null or q = 2")
def dem_to_msl(spark, d):
    """Terrain over mean sea level; heights, topography and differences that are NaN or infinite count as missing."""
    p, bad = pixels(spark, d), lambda n, c, x: F.when(F.col("pixel") % n == 0, F.lit(float(x))).otherwise(c)
    z, q = datum.to_msl(bad(31, F.col("z"), "nan"), bad(37, F.col("pixel") % 5 / 10.0, "nan"), bad(41, F.col("pixel") % 3 / 20.0, "inf"), F.when(F.col("pixel") % 29 == 0, 2).when(F.col("pixel") % 4 == 0, 1).otherwise(0))
    return p.select("pixel", r(z).alias("z_msl"), q.alias("qc"))


#: A square and a triangle stand for the closed seas.
SEAS = {"square": [(30.0, -20.0), (120.0, -20.0), (120.0, 40.0), (30.0, 40.0)], "triangle": [(200.0, 0.0), (300.0, 0.0), (250.0, 70.0)]}
_EDGES = ", ".join(f"('{n}', {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for n, p in SEAS.items() for a, b in zip(p, [*p[1:], p[0]], strict=True))
INSIDE = f"edges(polygon, x1, y1, x2, y2) as (values {_EDGES}), crossing as (select id, polygon, count(*) n from places, edges where ((y1 > lat) <> (y2 > lat)) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 group by 1, 2), inside as (select distinct id from crossing where n % 2 = 1)"


def _inside(spark, d):
    p = places(spark, d)
    hit = datum.in_polygons(p, datum.edges_of(SEAS, spark), "id").select("id").distinct().withColumn("inside", F.lit(True))
    return p.join(hit, "id", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


@query(f"with {PLACES}, {INSIDE} select p.id, case when i.id is not null then 'EIGEN-6C4' else 'GOCO06s' end geoid, case when i.id is not null then 'QC_DATUM_SOURCE_APPROX' else 'NORMAL' end quality from places p left join inside i on p.id = i.id")
def reference_geoid_polygon(spark, d):
    g, q = datum.reference_geoid(geo.valid_coordinate(F.col("lon"), F.col("lat")), F.col("inside"))
    return _inside(spark, d).select("id", g.alias("geoid"), q.alias("quality"))


@query(f"with {PLACES}, {INSIDE}, m as (select p.id, i.id is not null inside, case when p.id % 6 = 5 then 255 else p.id % 6 end mask from places p left join inside i on p.id = i.id) select id, case when mask = 1 then 'GOCO06s' when mask in (2, 3) then 'EIGEN-6C4' when inside then 'EIGEN-6C4' else 'GOCO06s' end geoid, case when mask in (1, 2, 3) then 'AUTHORITATIVE_MASK' else 'QC_DATUM_SOURCE_APPROX' end quality from m")
def reference_geoid_mask(spark, d):
    mask = F.when(F.col("id") % 6 == 5, 255).otherwise(F.col("id") % 6)
    g, q = datum.reference_geoid(geo.valid_coordinate(F.col("lon"), F.col("lat")), F.col("inside"), mask)
    return _inside(spark, d).select("id", g.alias("geoid"), q.alias("quality"))


_SEA_EDGES = ", ".join(f"('{n}', {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for n, p in known_places.CLOSED_SEAS.items() for a, b in zip(p, p[1:], strict=False))


@query(f"with places as (select o_orderkey id, -10.0::double + o_orderkey * 37 % 6000 / 100.0::double lon, 28.0::double + o_orderkey * 53 % 2200 / 100.0::double lat from orders), edges(polygon, x1, y1, x2, y2) as (values {_SEA_EDGES}), c as (select id, polygon, count(*) n from places, edges where ((y1 > lat) <> (y2 > lat)) and lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 group by 1, 2) select polygon, count(*)::bigint n from c where n % 2 = 1 group by 1")
def closed_seas(spark, d):
    """Places of a grid over southern Europe by the sea that holds them."""
    o = rd(spark, d, "orders")
    p = o.select(F.col("o_orderkey").alias("id"), (F.lit(-10.0) + F.col("o_orderkey") * 37 % 6000 / 100.0).alias("lon"), (F.lit(28.0) + F.col("o_orderkey") * 53 % 2200 / 100.0).alias("lat"))
    return datum.in_polygons(p, datum.edges_of(known_places.CLOSED_SEAS, spark), "id").groupBy("polygon").agg(F.count("*").alias("n"))


_SITES = ", ".join(f"('{n}', {x}::double, {y}::double)" for n, (x, y) in known_places.PRESETS.items())


@query(f"with {PLACES}, s as (select * from (values {_SITES}) t(name, lon, lat)), p as (select floor(lon / 30) a, floor((lat + 90) / 30) b, count(*) n from places group by 1, 2) select name, s.lon, s.lat, coalesce(n, 0)::bigint n from s left join p on a = floor((s.lon + case when s.lon < 0 then 360 else 0 end) / 30) and b = floor((s.lat + 90) / 30)")
def preset_sites(spark, d):
    """The sites offered by name, with the places in their chunk of 30 degrees."""
    sites = spark.createDataFrame([(n, *xy) for n, xy in known_places.PRESETS.items()], "name string, lon double, lat double").withColumn("k", geo.chunk_key(geo.normalize_longitude(F.col("lon")), F.col("lat"), 30.0))
    n = places(spark, d).groupBy(geo.chunk_key(F.col("lon"), F.col("lat"), 30.0).alias("k")).agg(F.count("*").alias("n"))
    return sites.join(n, "k", "left").select("name", "lon", "lat", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


# ---------------------------------------------------------------- sampling


def grid(spark):
    return spark.range(36 * 18).select((F.col("id") % 36).alias("i"), F.expr("id div 36").alias("j"), F.when(F.col("id") % 41 != 0, F.col("id") % 97 / 10.0).alias("val"))


GRID = "grid as (select id % 36 i, id // 36 j, case when id % 41 <> 0 then id % 97 / 10.0::double end val from (select unnest(range(648)) id))"


@query(f"""with {PLACES}, {GRID}, p as (select id, lon / 10 fx, (lat + 90) / 10 fy from places), c as (select id, floor(fx)::bigint i0, floor(fy)::bigint j0, fx - floor(fx) u, fy - floor(fy) v from p),
 f as (select id, i0 + a i, j0 + b j, case when a = 0 then 1 - u else u end * case when b = 0 then 1 - v else v end w from c, (values (0, 0), (1, 0), (0, 1), (1, 1)) o(a, b)),
 s as (select id, sum(w * val) s, count(*) filter (val is null) gone from f left join grid using (i, j) group by 1) select id, round(case when gone = 0 then s end, 6) as value from s""")
def bilinear_sample(spark, d):
    p = places(spark, d).select("id", (F.col("lon") / 10.0).alias("fx"), ((F.col("lat") + 90.0) / 10.0).alias("fy"))
    return sampling.bilinear(p, grid(spark), "id", "fx", "fy").select("id", r("value").alias("value"))


@query(f"with {PLACES}, {GRID}, p as (select id, round_even(lon / 10, 0)::bigint i, round_even((lat + 90) / 10, 0)::bigint j from places) select id, val as value from p left join grid using (i, j)")
def nearest_sample(spark, d):
    p = places(spark, d).select("id", (F.col("lon") / 10.0).alias("fx"), ((F.col("lat") + 90.0) / 10.0).alias("fy"))
    return sampling.nearest(p, grid(spark), "id", "fx", "fy")


def support(spark, d):
    s = rd(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("sid"), (F.col("s_suppkey") * 97 % 3600 / 10.0).alias("lon"), (F.col("s_suppkey") * 71 % 1500 / 10.0 - 75.0).alias("lat"), (F.col("s_suppkey") % 23 / 4.0).alias("val"))


_XYZ = "6371000.0::double * cos(radians(lat)) * cos(radians(lon)) x, 6371000.0::double * cos(radians(lat)) * sin(radians(lon)) y, 6371000.0::double * sin(radians(lat)) z"
KNN = f"""support as (select s_suppkey sid, s_suppkey * 97 % 3600 / 10.0::double lon, s_suppkey * 71 % 1500 / 10.0::double - 75.0::double lat, s_suppkey % 23 / 4.0::double val from supplier),
 pp as (select id, {_XYZ} from places), ss as (select sid, val, {_XYZ} from support), dd as (select id, sid, val, sqrt((pp.x - ss.x) ** 2 + (pp.y - ss.y) ** 2 + (pp.z - ss.z) ** 2) d from pp, ss),
 near as (select *, row_number() over (partition by id order by d, sid) rank from dd)"""


@query(f"with {PLACES}, {KNN}, a as (select id, min(d) d0, min_by(val, d) v0, sum(case when d >= 1e-4 then val / (d * d) end) / sum(case when d >= 1e-4 then 1 / (d * d) end) m from near where rank <= 8 group by 1) select id, round(case when d0 <= 500000 then case when d0 < 1e-4 then v0 else m end end, 5) as value, case when d0 <= 500000 then 1 else 2 end quality from a")
def idw_extrapolate(spark, d):
    p = places(spark, d)
    return sampling.idw(p, support(spark, d), "id", "sid", "val", cutoff_m=500_000.0, cell_deg=10.0).select("id", r("value", 5).alias("value"), "quality")


@query(f"with {PLACES}, {KNN} select id, sid, round(d / 1000, 3) km from near where rank = 1")
def nearest_support(spark, d):
    p = places(spark, d)
    k = sampling.knn(p, support(spark, d), "id", "sid", 1, 10.0)
    return k.select("id", "sid", r(F.col("d") / 1000, 3).alias("km"))


#: These places lie a thousand times as far apart as anchors do: 8 km and the bins are taken for thousands of km.
LOO_KM = 8000.0


@query(f"""with {PLACES}, {KNN}, a as (select sid id, val, x, y, z from ss),
 pairs as (select a.id, a.val truth, b.val, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) / 1000 km, b.sid from a join ss b on a.id <> b.sid),
 four as (select *, row_number() over (partition by id order by km, sid) rank from pairs),
 e as (select id, min(km) km, sum(val / greatest(km, 1e-4) ** 2) / sum(1 / greatest(km, 1e-4) ** 2) - min(truth) e from four where rank <= 4 and km <= {LOO_KM} group by 1),
 b as (select case when km < 500 then '0-0.5' when km < 1000 then '0.5-1' when km < 2000 then '1-2' when km < 4000 then '2-4' else '>4' end bin, e from e)
 select bin, count(*)::bigint n, round(avg(e), 5) bias, round(avg(abs(e)), 5) mae, round(sqrt(avg(e * e)), 5) rmse from b group by 1""")
def loocv_bins(spark, d):
    """Leave-one-out errors of every support point by the distance of the nearest other."""
    e = sampling.leave_one_out(support(spark, d), "sid", "val", max_km=LOO_KM, cell_deg=10.0)
    b = e.withColumn("bin", metrics.distance_bin(F.col("km") / 1000.0))
    return metrics.errors(b, "value", "truth", "bin").select("bin", "n", *(r(c, 5).alias(c) for c in ("bias", "mae", "rmse")))


# ---------------------------------------------------------------- cells and rasters


@query(f"with {PIXELS}, {CELLS} select pixel, cell_id from pixels join cells on x >= x_min and x < x_max and y >= y_min and y < y_max")
def cell_membership(spark, d):
    return cell_ops.membership(pixels(spark, d), cells(spark, d), "pixel", 1e9, 1e9, CELL * PX).select("pixel", "cell_id")


@query(f"with {PIXELS}, {CELLS} select pixel, cell_id from pixels join cells on x >= x_min and x < x_max and y >= y_min and y < y_max")
def cell_membership_oversized(spark, d):
    """Buckets far smaller than the cells: every cell takes the way of oversized ones."""
    return cell_ops.membership(pixels(spark, d), cells(spark, d), "pixel", 1e9, 1e9, CELL * PX / 16, 64).select("pixel", "cell_id")


@query(f"with {PIXELS}, {CELLS}, {NODES}, {WEIGHTS} select pixel, corner::int corner, node_id, round(weight, 6) weight from cw")
def corner_weights(spark, d):
    m = cell_ops.membership(pixels(spark, d).where("z is not null"), cells(spark, d), "pixel", 1e9, 1e9, CELL * PX)
    return cell_ops.corner_weights(m, "pixel").select("pixel", "corner", "node_id", r("weight").alias("weight"))


@query(f"with {PIXELS}, {CELLS}, {NODES}, {WEIGHTS} select pixel, node_id, use, usable::bigint usable, round(share, 6) share, connectivity, spatial from corners_used")
def topology_corners(spark, d):
    c, _ = weighted(spark, d)
    return c.select("pixel", "node_id", "use", "usable", r("share").alias("share"), "connectivity", "spatial")


@query(f"""with {PIXELS}, {CELLS}, {NODES}, {HOURS}, {TIDE}, {WEIGHTS}, f as (select pixel, c.node_id, 100.0::double * count(*) filter (level > z) / count(level) f from corners_used c join tide using (node_id) group by pixel, c.node_id),
 g as (select c.pixel, sum(case when use then share * f end) f, bit_or(case when use then node_qc else 0 end) b, max(cell_qc) cq, max(usable) u, bool_or(connectivity) co, bool_or(spatial) sp from corners_used c join f on c.pixel = f.pixel and c.node_id = f.node_id group by 1)
 select pixel, round(case when u > 0 then f end, 4) frequency, (case when u > 0 then cq | b | case when co then 64 else 0 end | case when sp then 2 else 0 end else cq | 68 end)::int qc from g""")
def inundation_raster(spark, d):
    """Frequency and bits of every pixel, blended from its usable corners."""
    from shoreline.plans import blocks

    return blocks.frequencies(cells(spark, d), raster_rows(spark, d), node_tide(spark, d), "pixel").select("pixel", r("frequency", 4).alias("frequency"), "qc")


@query(f"""with {PIXELS}, {CELLS}, {NODES}, {HOURS}, {TIDE}, {WEIGHTS}, lv as (select pixel k, s::double t, max(z) z, sum(share * level) / nullif(sum(share), 0) h from corners_used join tide using (node_id) where use group by 1, 2), {_exposure_sql('lv')}
 select k pixel, {_MEASURES} from m""")
def exposure_raster(spark, d):
    """All measures, over the time from the first sample to the last."""
    from shoreline.plans import blocks

    first, last = (1704067200.0 + 3600 * n for n in (0, 23))
    m = blocks.exposures(cells(spark, d), raster_rows(spark, d), node_tide(spark, d), "pixel", (first, last)).where("valid_h is not null")
    return _measures(m.withColumnRenamed("pixel", "k")).withColumnRenamed("k", "pixel")


@query(f"""with {PIXELS}, {CELLS}, {NODES}, {HOURS}, {TIDE}, {WEIGHTS}, lv as (select pixel k, s::double t, max(z) z, sum(share * level) / nullif(sum(share), 0) h from corners_used join tide using (node_id) where use group by 1, 2), {_exposure_sql('lv')}
 select k pixel, round(x, 3) exposed_h, n::bigint events from m""")
def exposure_raster_packed(spark, d):
    """Hours and events alone, over the samples' span."""
    from shoreline.plans import blocks

    m = blocks.exposures(cells(spark, d), raster_rows(spark, d), node_tide(spark, d), "pixel").where("valid_h is not null")
    return m.select("pixel", r("exposed_h", 3).alias("exposed_h"), "events")


@query(f"with {PIXELS}, {HOURS} select pixel, round({LEVEL.replace('lon', 'x').replace('lat', 'y')} + pixel % 5 / 10.0::double, 4) water from pixels, (select min(s) s from hours) where z is not null")
def snapshot_raster(spark, d):
    from shoreline.plans.rasters import snapshot

    p = pixels(spark, d).where("z is not null").select("pixel", F.col("x").alias("lon"), F.col("y").alias("lat"), (F.col("pixel") % 5 / 10.0).alias("offset"))
    return snapshot(p, "pixel", datetime(2024, 1, 1), lambda t, lon, lat: tide.synthetic_level(t / 3600.0, lon, lat)).select("pixel", r("water", 4).alias("water"))


@query(f"with {PIXELS} select (row // 5)::bigint r, (col // 5)::bigint c, count(z)::bigint valid_n, (least(5, (select max(row) + 1 from pixels) - (row // 5) * 5) * least(5, 128 - (col // 5) * 5))::bigint total_n, round(count(z)::double / (least(5, (select max(row) + 1 from pixels) - (row // 5) * 5) * least(5, 128 - (col // 5) * 5)), 6) fraction from pixels group by row // 5, col // 5")
def support_topology(spark, d):
    p = pixels(spark, d)
    h = height(p)
    return topology.downsample(p, 5, h, WIDTH).select("r", "c", "valid_n", "total_n", r("fraction").alias("fraction"))


@query()
def connected_components(spark, d):
    """Over the whole raster the recursive SQL is too slow; tested against a flood fill."""
    a = pixels(spark, d).where("z > 2.2").select(F.expr("cast(row div 4 as bigint)").alias("r"), F.expr("cast(col div 4 as bigint)").alias("c"))
    return topology.components(a)


@query(f"with {PIXELS}, {CELLS}, q(quarter, a, b) as (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) select cell_id, level + 1 as level, quarter, round(x_min + a * (x_max - x_min) / 2, 6) x_min, round(y_min + b * (y_max - y_min) / 2, 6) y_min from cells, q")
def quadtree_children(spark, d):
    return quadtree.children(cells(spark, d).drop("corners", "cell_qc")).select("cell_id", "level", "quarter", r("x_min").alias("x_min"), r("y_min").alias("y_min"))


@query("with c as (select l_orderkey o, list(l_quantity order by l_linenumber, l_quantity) q from lineitem where l_linenumber <= 4 group by 1), v as (select o, [x for x in [case when (o + i) % 5 <> 0 then q[i] end for i in range(1, len(q) + 1)] if x is not null] ok, case when o % 3 <> 0 then o % 50 * 1.0::double end mid from c) select o, round(case when mid is not null and len(ok) > 0 then abs(mid - list_sum(ok) / len(ok)) when len(ok) >= 2 then list_max(ok) - list_min(ok) else 0.0::double end, 6) error from v")
def cell_error(spark, d):
    i = rd(spark, d, "lineitem").where("l_linenumber <= 4")
    c = i.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("s"))
    corners = F.transform("s", lambda x, k: F.when((F.col("o") + k + 1) % 5 != 0, x.l_quantity))
    mid = F.when(F.col("o") % 3 != 0, F.col("o") % 50 * F.lit(1.0))
    return c.select("o", r(quadtree.cell_error(corners, mid)).alias("error"))


@query(f"with {PIXELS}, g as (select (row // 8)::bigint r, (col // 8)::bigint c, count(z) n, list_transform(quantile_cont(z, [0.1, 0.5, 0.9]), lambda x: x) q, list_sort(list(distinct z)) s from pixels where z is not null group by 1, 2) select r, c, n::bigint n, array_to_string(list_transform(case when n >= 10 then q else s end, lambda x: round(round(x, 6) * 10000)::bigint), ',') heights from g")
def elevation_quantiles(spark, d):
    p = pixels(spark, d).withColumns({"r": F.expr("cast(row div 8 as bigint)"), "c": F.expr("cast(col div 8 as bigint)")})
    return metrics.elevation_quantiles(p, "r", "c").select("r", "c", "n", F.array_join(F.transform("heights", lambda x: F.round(F.round(x, 6) * 10000).cast("long").cast("string")), ",").alias("heights"))


@query("with s as (select p_partkey raster_id, p_size * 10 width, p_size * 20 height from part), r as (select raster_id, width, height, unnest(range(0, height, 64)) r from s) select raster_id, r::bigint as row, c::bigint as col, least(64, height - r)::bigint h, least(64, width - c)::bigint w from (select *, unnest(range(0, width, 64)) c from r)")
def raster_windows(spark, d):
    """The blocks of every raster of a table of headers: parts, whose size gives width and height."""
    h = rd(spark, d, "part").select(F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 10).alias("width"), (F.col("p_size") * 20).alias("height"))
    return tables.windows_of(h, 16)


@query("select o_orderkey, abs(o_custkey - 100.0::double) > 1e-8 + 1e-5 * 100 ok from orders")
def nodata_mask(spark, d):
    return rd(spark, d, "orders").select("o_orderkey", geo.not_nodata(F.col("o_custkey").cast("double"), 100.0).alias("ok"))


@query(f"with {PIXELS}, m as (select *, coalesce(z > 2.5, false) v, row < 2 or row >= (select max(row) - 1 from pixels) or col < 2 or col >= 126 e from pixels), a as (select count(*) filter (v) n, min(row) filter (v) r0, max(row) filter (v) r1, min(col) filter (v) c0, max(col) filter (v) c1, count(*) filter (v and e) e from m) select n::bigint n, round(n::double / ((select max(row) + 1 from pixels) * 128), 6) valid_share, r0, r1, c0, c1, round(greatest(r1 - r0 + 1, c1 - c0 + 1)::double / least(r1 - r0 + 1, c1 - c0 + 1), 6) aspect, round(e::double / nullif(n, 0), 6) edge_share, case when n = 0 then 'EMPTY_TARGET' when greatest(r1 - r0 + 1, c1 - c0 + 1)::double / least(r1 - r0 + 1, c1 - c0 + 1) > 4 then 'NARROW_STRIP' when e::double / n > 0.3 then 'EDGE_TARGET' when n::double / ((select max(row) + 1 from pixels) * 128) > 0.4 then 'WIDE_TARGET' else 'COMPLEX_TARGET' end kind from a")
def mask_geometry(spark, d):
    p = pixels(spark, d)
    h = height(p)
    m = metrics.mask_geometry(p, h, WIDTH, F.coalesce(F.col("z") > 2.5, F.lit(False)))
    return m.select("n", r("valid_share").alias("valid_share"), "r0", "r1", "c0", "c1", r("aspect").alias("aspect"), r("edge_share").alias("edge_share"), "kind")


_OTHER = "(select pixel, row, col, case when pixel % 31 <> 0 then case when pixel % 7 = 0 then z + 0.5::double else z end end z from pixels)"


def _other(p):
    return p.withColumn("z", F.when(F.col("pixel") % 31 != 0, F.when(F.col("pixel") % 7 == 0, F.col("z") + 0.5).otherwise(F.col("z"))))


@query(f"with {PIXELS}, j as (select a.z a, b.z b from pixels a full join {_OTHER} b on a.row = b.row and a.col = b.col) select count(*) filter (a is not null and b is not null)::bigint as both, count(*) filter (a is not null and b is null)::bigint only_a, count(*) filter (a is null and b is not null)::bigint only_b, count(*) filter (a is distinct from b)::bigint unequal, round(max(abs(a - b)), 6) worst, count(*) filter (a is distinct from b) = 0 identical from j".replace(" as both,", ' as "both",'))
def raster_diff(spark, d):
    p = pixels(spark, d)
    return metrics.compare(p, _other(p), ["row", "col"], "z").withColumn("worst", r("worst"))


@query(f"with {PIXELS}, j as (select a.pixel, a.z - b.z dn from pixels a join {_OTHER} b on a.row = b.row and a.col = b.col) select count(dn)::bigint n, round(min(dn), 6) + 0 low, round(max(dn), 6) + 0 high, round(avg(dn), 6) + 0 mean, round(stddev_pop(dn), 6) spread from j")
def delta_n_raster(spark, d):
    p = pixels(spark, d)
    j = metrics.aligned(p, _other(p), ["row", "col"], "z").withColumn("dn", F.col("a") - F.col("b"))
    return j.agg(F.count("dn").alias("n"), r(F.min("dn")).alias("low"), r(F.max("dn")).alias("high"), r(F.avg("dn")).alias("mean"), r(F.stddev_pop("dn")).alias("spread"))


# ---------------------------------------------------------------- metrics


def pairs(spark, d):
    i = rd(spark, d, "lineitem")
    return i.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag", F.col("l_quantity").alias("a"), F.when(F.col("l_orderkey") % 13 == 0, F.lit(float("nan"))).when(F.col("l_orderkey") % 9 != 0, F.col("l_quantity") + F.col("l_discount") * 10 - F.col("l_tax") * 5).alias("b"))


PAIRS = "pairs as (select l_orderkey * 10 + l_linenumber id, l_returnflag, l_quantity a, case when l_orderkey % 9 <> 0 and l_orderkey % 13 <> 0 then l_quantity + l_discount * 10 - l_tax * 5 end b from lineitem)"
_ERR = "count(*)::bigint n, round(avg(a - b), 5) bias, round(avg(abs(a - b)), 5) mae, round(sqrt(avg((a - b) * (a - b))), 5) rmse, round(quantile_cont(abs(a - b), 0.5), 5) p50, round(quantile_cont(abs(a - b), 0.9), 5) p90, round(quantile_cont(abs(a - b), 0.95), 5) p95, round(quantile_cont(abs(a - b), 0.99), 5) p99, round(max(abs(a - b)), 5) worst"


@query(f"with {PAIRS} select l_returnflag, {_ERR} from pairs where b is not null group by 1")
def error_metrics(spark, d):
    e = metrics.errors(pairs(spark, d), "a", "b", "l_returnflag")
    return e.select("l_returnflag", "n", *(r(c, 5).alias(c) for c in e.columns[2:]))


@query(f"with {PAIRS}, e as (select l_returnflag, {_ERR} from pairs where b is not null group by 1) select l_returnflag, case when n < 20 then 'INSUFFICIENT' when mae <= 0.5 and p95 <= 1 and worst <= 5 then 'STRONG PASS' when mae <= 1 and p95 <= 2 and worst <= 5 then 'PASS' else 'INVESTIGATE' end grade from e")
def accuracy_gate(spark, d):
    e = metrics.errors(pairs(spark, d), "a", "b", "l_returnflag")
    return e.select("l_returnflag", metrics.gate(F.round("mae", 5), F.round("p95", 5), F.round("worst", 5), F.col("n")).alias("grade"))


@query(f"with {PAIRS} select id, round(abs(a - b), 6) error from pairs where b is not null order by round(abs(a - b), 6) desc, id limit 20")
def top_outliers(spark, d):
    p = pairs(spark, d).where(~F.isnan("b")).withColumns({"a": F.round(F.abs(F.col("a") - F.col("b")), 6), "b": F.when(F.col("b").isNotNull(), 0.0)})
    return metrics.outliers(p, "a", "b", "id").select("id", r("error").alias("error"))


@query(f"with {PIXELS}, t as (select row, col, z, z as w from pixels where col < 64 union all select row, col, z, z + 0.01::double from pixels where col >= 64), s as (select a.row, abs(a.w - b.w) step from t a join t b on a.row = b.row and a.col = 63 and b.col = 64) select (select count(*) from t where w is not null)::bigint n, (select round(avg(abs(w - z)), 6) from t) mae, (select round(quantile_cont(abs(w - z), 0.95), 6) from t) p95, (select round(quantile_cont(abs(w - z), 0.99), 6) from t) p99, (select round(max(abs(w - z)), 6) from t) worst, 'PASS' status, (select round(quantile_cont(step, 0.95), 6) from s) seam_p95")
def seam_composite(spark, d):
    from shoreline.plans.rasters import seam

    p = pixels(spark, d)
    return seam(p.where("col < 64"), p.where("col >= 64").withColumn("z", F.col("z") + 0.01), p, 64).select("n", *(r(c).alias(c) for c in ("mae", "p95", "p99", "worst", "seam_p95")), "status")


@query(f"with {PIXELS}, {CELLS}, {NODES}, x as (select unnest(corners) node_id, level from cells) select n.node_id, coalesce(min(level), -1)::int low, coalesce(max(level), -1)::int high from nodes n left join x using (node_id) group by 1")
def incident_levels(spark, d):
    return metrics.incident_levels(nodes(spark, d), cells(spark, d))


@query(f"with {SERIES}, i as (select *, row_number() over (partition by k order by t) i from series), s as (select k, unnest([60, 120])::double z from (select distinct k from series)), f as (select s.k, s.z, 100.0::double * count(*) filter (h::float > s.z) / nullif(count(h), 0) a, 100.0::double * count(*) filter (h::float > s.z and i % 2 = 1) / nullif(count(h) filter (i % 2 = 1), 0) b from s join i on s.k = i.k group by 1, 2) select z, {_ERR} from f where a is not null and b is not null group by 1")
def sensitivity_time_step(spark, d):
    """What taking every other sample does to the frequencies."""
    from pyspark.sql.window import Window

    e = series(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("t"))).drop("z")
    z = e.select("k").distinct().select("k", F.explode(F.array(F.lit(60.0), F.lit(120.0))).alias("z"))
    a = frequency.frequency(e, z, "k", "h").select("k", "z", F.col("frequency").alias("a"))
    b = frequency.frequency(e.where("i % 2 = 1"), z, "k", "h").select("k", "z", F.col("frequency").alias("b"))
    m = metrics.errors(a.join(b, ["k", "z"]), "a", "b", "z")
    return m.select("z", "n", *(r(c, 5).alias(c) for c in m.columns[2:]))


@query(f"with {SERIES}, s as (select k, unnest([20, 60])::double z from (select distinct k from series)) select s.k, s.z, count(h)::bigint n, round(100.0::double * count(*) filter (h::float >= s.z) / nullif(count(h), 0), 6) frequency from s join series on s.k = series.k group by 1, 2")
def sensitivity_at_least(spark, d):
    e = series(spark, d).drop("z")
    z = e.select("k").distinct().select("k", F.explode(F.array(F.lit(20.0), F.lit(60.0))).alias("z"))
    return frequency.frequency(e, z, "k", "h", at_least=True).select("k", "z", "n", r("frequency").alias("frequency"))


@query(f"with {PLACES}, h as (select id from places where id % 5 = 0 and lat > 0), s as (select id from places except select id from h) select (select count(*) from h)::bigint holdout, (select count(*) from s)::bigint support, (select count(*) from (select id from h intersect select id from s))::bigint shared")
def holdout_split(spark, d):
    p = places(spark, d)
    h = p.where("id % 5 = 0 and lat > 0").select("id")
    s = p.select("id").exceptAll(h)
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(h, "holdout").crossJoin(one(s, "support")).crossJoin(one(h.intersect(s), "shared"))


@query("select distinct p_type as constituent from part where p_type not in (" + ", ".join(f"'{c}'" for c in tide.SPEEDS) + ")")
def unknown_constituents(spark, d):
    known = spark.createDataFrame([(c,) for c in tide.SPEEDS], "constituent string")
    return rd(spark, d, "part").select(F.col("p_type").alias("constituent")).distinct().join(known, "constituent", "left_anti")


# ---------------------------------------------------------------- batch


def _records(spark, d):
    o = rd(spark, d, "orders")
    return o.select(F.concat(F.lit("file_"), F.col("o_custkey")).alias("path"), F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("SKIPPED").alias("status"), F.col("o_orderkey").alias("seq"))


RECORDS = "records as (select 'file_' || o_custkey path, case o_orderstatus when 'F' then 'SUCCESS' when 'O' then 'FAILED' else 'SKIPPED' end status, o_orderkey seq from orders)"


@query(f"with {RECORDS} select path, status, seq from records qualify row_number() over (partition by path order by seq desc) = 1")
def manifest_upsert(spark, d):
    m = _records(spark, d)
    return manifest.upsert(m.where("seq % 2 = 0"), m.where("seq % 2 = 1"), "path", "seq")


@query(f"with {RECORDS}, m as (select * from records qualify row_number() over (partition by path order by seq desc) = 1) select status, count(*)::bigint n from m group by 1")
def batch_summary(spark, d):
    m = _records(spark, d)
    return manifest.summary(manifest.upsert(m.where("seq % 2 = 0"), m.where("seq % 2 = 1"), "path", "seq"))


def _files(spark, d):
    return rd(spark, d, "part").select(F.concat(F.lit("tile_"), F.col("p_partkey")).alias("path"), F.col("p_size").cast("long").alias("bytes"), F.round(F.col("p_retailprice") * 10).cast("long").alias("modified"), F.col("p_brand").alias("signature"))


FILES = "files as (select 'tile_' || p_partkey path, p_size::bigint bytes, round(p_retailprice * 10)::bigint modified, p_brand signature, p_partkey k from part)"


@query(f"with {FILES} select path from files where k % 4 <> 0 and k % 3 <> 0")
def resume_skip(spark, d):
    f = _files(spark, d)
    k = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    m = f.withColumn("bytes", F.when(k % 3 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn("status", F.when(k % 4 == 0, "FAILED").otherwise("SUCCESS"))
    return manifest.skippable(f, m)


@query(f"with {FILES} select path, case when k % 10 = 0 then 'gone' when k % 10 = 1 then 'new' else 'changed' end why from files where k % 10 in (0, 1, 2)")
def snapshot_stale(spark, d):
    f = _files(spark, d)
    k = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    now = f.where(k % 10 != 0).withColumn("modified", F.when(k % 10 == 2, F.col("modified") + 1).otherwise(F.col("modified")))
    return manifest.stale(f.where(k % 10 != 1), now)


# ---------------------------------------------------------------- diagnoses

CLASSED = """classed as (select node_id, (node_id % 4)::int as level, case when node_id % 11 = 0 then 'A_FES_INVALID' when node_id % 6 = 0 then 'B_FES_VALID_MDT_INVALID' when node_id % 10 = 0 then 'C_FES_VALID_MDT_VALID_DELTAN_INVALID' when node_id % 7 <> 0 then 'D_FES_VALID_DATUM_VALID' else 'E_OTHER_DATUM_FAILURE' end class from nodes)"""


def classed(spark, d):
    """Nodes by what they lack: topography is there but 0 (which counts as lacking) at every sixth, an offset is NaN at every seventh."""
    i = F.col("node_id")
    cls = metrics.support_class(F.col("valid"), F.when(i % 6 == 0, 0.0).otherwise(1.5), F.when(i % 10 != 0, 0.25), F.when(i % 7 == 0, float("nan")).otherwise(2.0))
    return nodes(spark, d).select("node_id", (i % 4).cast("int").alias("level"), cls.alias("class"))


@query(f"with {PIXELS}, {CELLS}, {NODES}, {CLASSED}, g as (select level, class, count(*) n from classed group by rollup (level, class)) select level, class, n::bigint n, round(100.0::double * n / max(n) over (partition by level), 4) percent from g")
def node_support_class(spark, d):
    return metrics.class_counts(classed(spark, d)).withColumn("percent", r("percent", 4))


_Q68 = "case when gone > 0 then 'Q68_OTHER' when dry = 4 then 'Q68_NO_FES_SUPPORT' when bare = 4 then 'Q68_DATUM_SUPPORT_FAILURE' when whole = 0 then 'Q68_MIXED_FES_AND_DATUM' else 'Q68_TOPOLOGY_REJECTED' end"


@query(f"""with {PIXELS}, {CELLS}, {NODES}, {CLASSED}, p as (select pixel, case when pixel % 19 <> 0 then cell_id end cell_id, case when pixel % 3 = 0 then 68 else 0 end qc from pixels join cells on x >= x_min and x < x_max and y >= y_min and y < y_max),
 k as (select cell_id, count(*) filter (class is null) gone, count(*) filter (class = 'A_FES_INVALID') dry, count(*) filter (class = 'B_FES_VALID_MDT_INVALID') bare, count(*) filter (class = 'D_FES_VALID_DATUM_VALID') whole from (select cell_id, unnest(corners) node_id from cells) left join (select * from classed where node_id % 13 <> 0 or node_id > 5000) using (node_id) group by 1),
 c as (select {_Q68.replace("gone > 0", "k.cell_id is null or gone > 0")} cause, count(*) n from p left join k using (cell_id) where qc = 68 group by 1), e(cause) as (values ('Q68_NO_FES_SUPPORT'), ('Q68_DATUM_SUPPORT_FAILURE'), ('Q68_MIXED_FES_AND_DATUM'), ('Q68_TOPOLOGY_REJECTED'), ('Q68_OTHER'))
 select cause, coalesce(n, 0)::bigint n, round(100.0::double * coalesce(n, 0) / (select sum(n) from c), 4) percent from e left join c using (cause)""")
def qc68_attribution(spark, d):
    from shoreline.plans.rasters import attribute

    m = cell_ops.membership(pixels(spark, d), cells(spark, d), "pixel", 1e9, 1e9, CELL * PX)
    p = m.select(F.when(F.col("pixel") % 19 != 0, F.col("cell_id")).alias("cell_id"), F.when(F.col("pixel") % 3 == 0, 68).otherwise(0).alias("qc"))
    known = classed(spark, d).where("node_id % 13 <> 0 or node_id > 5000")
    return attribute(p, cells(spark, d), known).withColumn("percent", r("percent", 4))


@query(f"""with {PIXELS}, {HOURS}, t as (select floor(2 * cos(s / 7000.0::double) * 64) / 64 + 1 / 128.0::double tide from hours), p as (select z, pixel % 5 / 10.0::double m, pixel % 3 / 20.0::double n from pixels where z is not null)
 select count(*)::bigint n, count(*) filter ((tide + (m + n) > z) <> (tide > z - m - n))::bigint mismatches, count(*) filter (tide + (m + n) > z)::bigint under_water from p, t""")
def decision_equivalence(spark, d):
    """Decimal offsets that binary numbers can't hold: both engines must round alike for the mismatches to be the same."""
    p = pixels(spark, d).where("z is not null").select("z", (F.col("pixel") % 5 / 10.0).alias("mdt_m"), (F.col("pixel") % 3 / 20.0).alias("delta_n_m"))
    t = hours(spark).select((F.floor(2 * F.cos(timegrid.seconds(F.col("t")) / 7000.0) * 64) / 64.0 + 1 / 128).alias("tide"))
    return datum.decisions(p, t)


@query(r"""select n_nationkey, sha256('{"crs":"EPSG:' || (32600 + n_nationkey) || '","freq":"30min","name":"' || n_name || ' \\ \"q\"","region":"' || n_regionkey || '"}') signature from nation""")
def signature(spark, d):
    """Signatures of tags as canonical JSON; the tests hold them against those of single bundles."""
    n = rd(spark, d, "nation")
    name = F.concat("n_name", F.lit(' \\ "q"'))
    tags = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), name, F.lit("freq"), F.lit("30min"), F.lit("crs"), F.concat(F.lit("EPSG:"), F.lit(32600) + F.col("n_nationkey")))
    return n.select("n_nationkey", bundle.signature_column(tags).alias("signature"))


@query(f"with {SERIES}, g as (select k, t - lag(t) over (partition by k order by t) dt from series) select k, count(*)::bigint n, count(*) filter (dt <= 0)::bigint not_increasing, round(coalesce(max(abs(dt - 1800.0::double)), 0), 4) worst_step, count(*) filter (dt <= 0) = 0 and coalesce(max(abs(dt - 1800.0::double)), 0) <= 1e-3 ok from g group by 1")
def time_axis_check(spark, d):
    """Every station's axis against a cadence of half an hour."""
    c = timegrid.check_time_axis(series(spark, d).select("k", F.col("t").alias("t_seconds"), F.col("t").alias("_seq")), 1800.0, keys=("k",))
    return c.select("k", "n", "not_increasing", r("worst_step", 4).alias("worst_step"), "ok")


@query("""select s_suppkey id, array_to_string(list_sort([x for x in [case when s_suppkey % 7 = 0 then 'crs' end, case when s_suppkey % 11 = 0 then 'dem_bytes' end, case when s_suppkey % 2 = 0 then 'freq' end, case when s_suppkey % 3 = 0 then 'min_spacing_m' end, case when s_suppkey % 13 = 0 then 'signature' end, case when s_suppkey % 5 = 0 then 'topology_fraction' end] if x is not null]), ',') reasons
 from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0 or s_suppkey % 5 = 0 or s_suppkey % 7 = 0 or s_suppkey % 11 = 0 or s_suppkey % 13 = 0""")
def cache_compat_reasons(spark, d):
    """All reasons against a bundle: other tags, missing ones, another CRS than the same by number, a size that is stored, a forged signature."""
    s = rd(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    rows = lambda *kv: s.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in kv))).alias("e")).select("id", "e.*")
    i = F.col("id")
    want = rows(("freq", F.lit("30min")), ("min_spacing_m", F.lit("500")), ("topology_fraction", F.lit("0.5")), ("inclusive", F.lit("left")), ("crs", F.lit("EPSG:32651")), ("dem_bytes", F.lit("1000")), ("dem_mtime", F.lit("77")))
    have = rows(("freq", F.when(i % 2 == 0, "1h").otherwise("30min")), ("min_spacing_m", F.when(i % 3 == 0, F.lit(502.0)).otherwise(500.9)), ("inclusive", F.lit("left")), ("topology_fraction", F.when(i % 5 != 0, F.lit(0.50005))), ("crs", F.when(i % 7 == 0, "EPSG:4326").otherwise("urn:ogc:def:crs:EPSG::32651")), ("dem_bytes", F.when(i % 11 == 0, F.lit(999)).when(i % 2 == 0, F.lit(0)).otherwise(1000))).where("value is not null")
    tags = have.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("t"))
    signed = tags.select("id", F.lit("signature").alias("key"), F.when(i % 13 == 0, "forged").otherwise(bundle.signature_column(F.col("t"))).alias("value"))
    return bundle.incompatible_table(want, have.unionByName(signed))

"""Vertical datums: which geoid a mean dynamic topography refers to, the chain of heights, and static offsets.

    h_mdt_ref = tide + mdt; h_goco06s = h_mdt_ref where the reference geoid is GOCO06s; h_egm2008 = h_mdt_ref + delta_n;
    h_wgs84 = h_egm2008 + n
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.operators.frequency import finite

#: Names of targets and their aliases.
TARGETS = {"msl": "msl", "mdt_ref": "mdt_ref", "goco": "mdt_ref", "goco06s": "mdt_ref", "egm2008": "egm2008", "egm": "egm2008", "both": "egm2008", "wgs84": "wgs84", "wgs": "wgs84", "all": "all"}
#: Labels.
GOCO, EIGEN, MSL, INVALID = "GOCO06s", "EIGEN-6C4", "MSL", "INVALID"
MASKED, APPROX, NORMAL, BAD = "AUTHORITATIVE_MASK", "QC_DATUM_SOURCE_APPROX", "NORMAL", "QC_DATUM_INVALID"


def target_of(name: str) -> str:
    try:
        return TARGETS[name.lower()]
    except KeyError:
        raise ValueError(f"unknown datum {name!r}; one of {', '.join(sorted(TARGETS))}") from None


def in_polygons(points: DataFrame, edges: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """key, polygon for every polygon that holds a point, by even-odd crossing. edges: polygon, x1, y1, x2, y2 (bounded by the
    polygons' vertices, so broadcast)."""
    e = F.broadcast(edges)
    x, y = F.col(lon), F.col(lat)
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    near = points.select(key, lon, lat).join(e, crosses)
    return near.groupBy(key, "polygon").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1).select(key, "polygon")


def edges_of(polygons: dict[str, list[tuple[float, float]]], spark) -> DataFrame:
    rows = [(name, *map(float, a), *map(float, b)) for name, p in polygons.items() for a, b in zip(p, [*p[1:], p[0]], strict=True) if a != b]
    return spark.createDataFrame(rows, "polygon string, x1 double, y1 double, x2 double, y2 double")


def reference_geoid(valid: Column, inside: Column, mask: Column | None = None) -> tuple[Column, Column]:
    """(geoid, quality) of a coordinate. inside: within a polygon of the closed seas; mask: the source class, if there is a mask."""
    by_polygon = F.when(inside, EIGEN).otherwise(GOCO)
    if mask is None:
        geoid, quality = by_polygon, F.when(inside, APPROX).otherwise(NORMAL)
    else:
        geoid = F.when(mask == 1, GOCO).when(mask.isin(2, 3), EIGEN).otherwise(by_polygon)
        quality = F.when(mask.isin(1, 2, 3), MASKED).otherwise(APPROX)
    return F.when(valid, geoid).otherwise(INVALID), F.when(valid, quality).otherwise(BAD)


def geoid_of_points(points: DataFrame, seas: DataFrame, key: str, mask: DataFrame | None = None, fx: str | None = None, fy: str | None = None) -> DataFrame:
    """key, geoid, quality of points (lon, lat): by the mask's nearest cell at (fx, fy) where that names a class, else by the closed seas (edges_of())."""
    from shoreline.functions import geo
    from shoreline.operators import sampling

    hit = in_polygons(points, seas, key).select(key).distinct().withColumn("_in", F.lit(True))
    p = points.join(hit, key, "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    cls = None
    if mask is not None:
        p = p.join(sampling.nearest(points, mask, key, fx, fy).select(key, F.coalesce("value", F.lit(255)).alias("_mask")), key, "left")
        cls = F.col("_mask")
    geoid, quality = reference_geoid(F.coalesce(geo.valid_coordinate(F.col("lon"), F.col("lat")), F.lit(False)), F.col("_in"), cls)
    return p.select(key, geoid.alias("geoid"), quality.alias("quality"))


def in_closed_sea(geoid: Column) -> Column:
    """Whether a point's topography refers to the closed seas' geoid."""
    return geoid == EIGEN


def delta_n(geoid: Column, goco: Column, eigen: Column) -> Column:
    """The grid of the reference geoid; the other one never stands in."""
    return F.when(geoid == GOCO, goco).when(geoid == EIGEN, eigen)


def convert(df: DataFrame, target: str, tide: str = "tide_m", mdt: str = "mdt_m", dn: str = "delta_n_m", n: str = "n_egm2008_m", geoid: str = "geoid") -> DataFrame:
    """Adds the height columns of a target; those it doesn't give are null, and no column is read that it doesn't need."""
    t = target_of(target)
    null = F.lit(None).cast("double")
    cols = {"tide_msl_m": F.col(tide), "h_mdt_ref_m": null, "h_goco06s_m": null, "h_egm2008_m": null, "h_wgs84_m": null}
    if t != "msl":
        ref = F.col(tide) + F.col(mdt)
        cols |= {"h_mdt_ref_m": ref, "h_goco06s_m": F.when(F.col(geoid) == GOCO, ref)}
        if t != "mdt_ref":
            cols["h_egm2008_m"] = ref + F.col(dn)
            if t in ("wgs84", "all"):
                cols["h_wgs84_m"] = ref + F.col(dn) + F.col(n)
    return df.withColumns(cols)


def static_offset(target: str, mdt: Column, dn: Column, n: Column) -> Column:
    """What a target adds to the tide at a place; 'all' leaves out N."""
    t = target_of(target)
    return {"msl": F.lit(0.0), "mdt_ref": mdt, "egm2008": mdt + dn, "wgs84": mdt + dn + n, "all": mdt + dn}[t]


def to_msl(z: Column, mdt: Column, dn: Column, qc: Column) -> tuple[Column, Column]:
    """Terrain over mean sea level, and the conversion's quality (2 where an input is missing or not finite)."""
    ok = finite(z).isNotNull() & finite(mdt).isNotNull() & finite(dn).isNotNull() & F.coalesce(qc != 2, F.lit(False))
    return F.when(ok, z - mdt - dn), F.when(ok, qc).otherwise(2)


def decisions(points: DataFrame, times: DataFrame) -> DataFrame:
    """Whether moving the datum to the terrain changes a decision: n, mismatches of tide + mdt + dn > z and
    tide > z - mdt - dn, and under_water (how often the first holds)."""
    each = points.crossJoin(F.broadcast(times))
    c = F.col("mdt_m") + F.col("delta_n_m")
    return each.agg(F.count("*").alias("n"), F.count_if((F.col("tide") + c > F.col("z")) != (F.col("tide") > F.col("z") - F.col("mdt_m") - F.col("delta_n_m"))).alias("mismatches"), F.count_if(F.col("tide") + c > F.col("z")).alias("under_water"))


def broadcast_inputs(n_lon: int, n_lat: int, n_tide: int) -> str:
    """How one and many inputs go together."""
    n = max(n_lon, n_lat, n_tide)
    if any(k not in (1, n) for k in (n_lon, n_lat, n_tide)):
        raise ValueError("inputs can't be broadcast")
    if n == 1:
        return "scalar"
    if n_lon == n_lat == 1:
        return "times"
    return "places" if n_tide == 1 else "aligned"

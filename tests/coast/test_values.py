"""Closed-form values and definitions by hand."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.functions import geo, tide, timegrid
from shoreline.operators import datum, exposure, frequency, metrics, peaks, sampling, topology
from shoreline.plans.blocks import scan_block
from shoreline.sources import bundle, tables


@pytest.mark.parametrize("inclusive,n", [("both", 4), ("left", 3), ("right", 3), ("neither", 2)])
def test_grid_ends(spark, inclusive, n):
    assert timegrid.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 3), "1h", inclusive).count() == n


def test_year_and_clock_changes(spark):
    year = lambda y: timegrid.time_grid(spark, datetime(y, 1, 1), datetime(y + 1, 1, 1), "30min", "left").count()
    day = lambda m, d: timegrid.time_grid(spark, datetime(2024, m, d), datetime(2024, m, d + 1), "1h", "left", "America/New_York").count()
    assert (year(2024), year(2023)) == (17568, 17520) and (day(3, 10), day(11, 3)) == (23, 25)
    at = lambda m, d, h, mi, rule="standard": timegrid.localize(datetime(2024, m, d, h, mi), "America/New_York", rule).strftime("%H:%M")
    assert at(3, 10, 2, 30) == "07:00" and at(11, 3, 1, 30) == "06:30" and at(11, 3, 1, 30, "daylight") == "05:30"
    for bad in ("x", "0min", "-1h"):
        with pytest.raises(ValueError):
            timegrid.step_seconds(bad)


def test_frequency(spark):
    s = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 5)] + [(2, 1.0), (2, None), (2, 3.0), (2, 4.0), (3, None)], "node_id int, level double")
    z = spark.createDataFrame([(1, x) for x in (0.0, 2.0, 3.5, 5.0, 6.0)] + [(2, 2.0), (2, None), (3, 1.0)], "node_id int, z double")
    got = {(r.node_id, r.z): r.frequency for r in frequency.frequency(s, z).collect()}
    assert got == {(1, 0.0): 100, (1, 2.0): 60, (1, 3.5): 40, (1, 5.0): 0, (1, 6.0): 0, (2, 2.0): pytest.approx(200 / 3), (2, None): None, (3, 1.0): None}


def _series(seed, n=200):
    r = random.Random(seed)
    out = []
    for k in range(n):
        t = 0.0
        for _ in range(r.randrange(1, 25)):
            t += r.choice([600.0, 1800.0, 3600.0])
            out.append((k, t, None if r.random() < 0.15 else float(r.choice([0, 1, 1, 2, 3])), 1.0))
    return out


def test_exposure_against_the_state_machine(spark):
    rows = _series(1)
    got = {r.k: r for r in exposure.metrics(spark.createDataFrame(rows, "k int, t double, h double, z double"), "k").collect()}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        want = exposure.scan([r[1] for r in mine], [r[2] for r in mine], 1.0)
        t, h = np.array([r[1] for r in mine]), np.array([[np.nan if r[2] is None else r[2] for r in mine]])
        block = [x[0] for x in scan_block(t, h, np.ones((1, 1)), np.ones(1))[:4]]
        for name, b in zip(("valid_h", "exposed_h", "max_h", "events"), block, strict=True):
            assert got[k][name] == pytest.approx(want[name], abs=1e-9) == pytest.approx(b, abs=1e-9), (k, name)


@pytest.mark.parametrize("samples,z,want", [
    ([(i * 3600, 5.0) for i in range(10)], 2.0, (0, 0)), ([(i * 3600, 1.0) for i in range(11)], 3.0, (10, 1)), ([(i * 3600, 2.0) for i in range(4)], 2.0, (3, 1)),
    ([(0, 0.0), (1000, 10.0)], 4.0, (400 / 3600, 1)), ([(0, 2.0), (1800, 1.0), (3600, 2.0)], 1.0, (0, 0)), ([(0, 0.0), (1800, 2.0), (3600, 1.0), (5400, 2.0)], 1.0, (0.25, 2)),
])
def test_exposure_values(samples, z, want):
    got = exposure.scan(*zip(*samples, strict=True), z)
    assert (got["exposed_h"], got["events"]) == pytest.approx(want)


def test_longitudes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(geo.normalize_longitude(F.lit(-120.0))) == 240 and one(geo.normalize_longitude(F.lit(240.0), False)) == -120 and one(geo.normalize_longitude(F.lit(360.0))) == 0
    span = lambda *x: geo.circular_span(spark.createDataFrame([(1, float(v)) for v in x], "k int, lon double"), "lon", "k").first().span
    assert span(359, 1) == pytest.approx(2) and span(179, -179) == pytest.approx(2) and span(10, 30) == pytest.approx(20)
    assert geo.boxes(350, 370) == [(350, 360.0), (0.0, 10.0)]


def test_utm(spark):
    """Against the forward series at places of a zone."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    rows = []
    for lon, lat in ((121.5, 31.2), (123.0, 0.5), (125.9, 60.0), (120.1, -35.0)):
        e = math.sqrt(f * (2 - f))
        s = math.sin(math.radians(lat))
        t = math.sinh(math.atanh(s) - e * math.atanh(e * s))
        d = math.radians(lon - 123)
        xi, eta = math.atan2(t, math.cos(d)), math.asinh(math.sin(d) / math.hypot(t, math.cos(d)))
        x = k0 * rect * (eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1))) + 5e5
        y = k0 * rect * (xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)))
        rows.append((lon, lat, x, y))
    df = spark.createDataFrame(rows, "lon double, lat double, x double, y double")
    lon, lat = geo.utm_to_lonlat(F.col("x"), F.col("y"), 51)
    for r in df.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.a - r.lon) < 1e-6 and abs(r.b - r.lat) < 1e-6


def test_constituents():
    assert len(tide.constituents()) == 34 and len(tide.constituents("major8")) == 8
    with pytest.raises(ValueError):
        tide.constituents(["M2", "XX"])


def test_datum_values(spark):
    df = spark.createDataFrame([(5.0, 0.5, 0.1, 0), (10.0, -0.2, 0.05, 1), (-2.5, 0.3, -0.1, 0), (0.0, 0.0, 0.0, 1), (None, 0.5, 0.1, 0)], "z double, m double, d double, q int")
    z, q = datum.to_msl(F.col("z"), F.col("m"), F.col("d"), F.col("q"))
    got = [tuple(r) for r in df.select(z, q).collect()]
    assert [g[0] and round(g[0], 9) for g in got] == [4.4, 10.15, -2.7, 0, None] and [g[1] for g in got] == [0, 1, 0, 1, 2]
    assert [datum.broadcast_inputs(*x) for x in ((1, 1, 1), (5, 5, 5), (5, 5, 1), (1, 1, 5))] == ["scalar", "aligned", "places", "times"]
    with pytest.raises(ValueError):
        datum.broadcast_inputs(2, 2, 3)
    with pytest.raises(ValueError):
        datum.target_of("moon")


def test_idw(spark):
    s = spark.createDataFrame([(k, 120.0 + k * 0.1, 30.0, float(k)) for k in range(10)], "sid int, lon double, lat double, v double")
    p = spark.createDataFrame([(1, 120.3, 30.0, None), (2, 120.35, 30.1, None), (3, 10.0, 0.0, None), (4, 121.0, 30.0, 9.5)], "id int, lon double, lat double, own double")
    got = {r.id: (r.value, r.quality) for r in sampling.idw(p, s, "id", "sid", "v", native="own").collect()}
    assert got[1] == (3.0, 1) and got[3] == (None, 2) and got[4] == (9.5, 0) and 3 < got[2][0] < 4
    assert sampling.idw(p.where("id = 1"), s, "id", "sid", "v", cutoff_m=0.0).first().quality == 2
    for bad in (-1, 501_000):
        with pytest.raises(ValueError):
            sampling.idw(p, s, "id", "sid", "v", cutoff_m=bad)


def test_peaks():
    x = np.array([0, 2, 1, 3, 3, 3, 0, 5, 4, 4.5, 0])
    assert peaks.find_peaks(x, 1).tolist() == [1, 4, 7, 9]
    assert peaks.find_peaks(x, 3).tolist() == [1, 4, 7] and peaks.find_peaks(x, 4).tolist() == [1, 7]


def test_components(spark):
    cells = [(0, c) for c in range(40)] + [(5, 0), (6, 1), (7, 2)] + [(50, 50)]
    got = topology.components(spark.createDataFrame(cells, "r long, c long")).collect()
    assert len({x.component for x in got}) == 3 and len(got) == len(cells)
    assert topology.coarse_factor(100, 9) == 11 and topology.coarse_factor(1, 10) == 1


def test_bundle(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    nodes = spark.createDataFrame([(k, 0.0, 0.0, True, 1, 0, 0.5) for k in range(4)], "node_id long, x double, y double, valid boolean, component_id int, qc int, offset double")
    cells = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 1.0, [0, 1, 2, 3])], "cell_id long, x_min double, y_min double, x_max double, y_max double, corners array<long>")
    times = timegrid.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 10), "30min", "left")
    levels = nodes.crossJoin(times).select("node_id", "t", F.lit(1.0).cast("float").alias("level"))
    tags = {"freq": "30min", "time_samples": 20, "step_s": 1800, "min_spacing_m": 500.0}
    bundle.write_bundle(path, nodes, cells, levels, tags, terminal=nodes.select("node_id", F.lit(0.5).alias("level")))
    assert bundle.validate(spark, path) == [] and bundle.read_levels(spark, path, [1, 2]).count() == 40
    assert set(bundle.read_bundle(spark, path, tide=False)) == {"nodes", "cells"}
    with pytest.raises(bundle.ExistingOutput):
        bundle.write_bundle(path, nodes, cells, levels, tags)
    with pytest.raises(IndexError):
        bundle.read_levels(spark, path, [1, 99])
    with pytest.raises(IndexError):
        bundle.read_levels(spark, path, [1], datetime(2024, 1, 2), datetime(2024, 1, 1))
    seen = bundle.inspect(spark, path)
    assert (seen["num_nodes"], seen["num_cells"], seen["signed"]) == (4, 1, True)
    assert {tuple(r.levels) for r in bundle.sorted_levels(bundle.read_bundle(spark, path)).collect()} == {(1.5,) * 20}
    bundle.write_bundle(path, nodes, cells, levels.where("node_id < 3 or hour(t) < 5"), tags | {"time_samples": 7}, overwrite=True)
    assert {"time axis", "time_samples"} <= set(bundle.validate(spark, path))
    bundle.write_bundle(path, nodes.where("node_id < 3"), cells, levels, tags, overwrite=True)
    assert {"corner names no node", "level of no node"} <= set(bundle.validate(spark, path))
    stored = bundle.tags_of(spark, path)
    assert bundle.incompatible({"freq": "30min", "min_spacing_m": 500.5}, stored) == []
    assert bundle.incompatible({"freq": "1h", "min_spacing_m": 502, "crs": "EPSG:4326"}, stored) == ["crs: missing", "freq: 30min instead of 1h", "min_spacing_m: 500.0 instead of 502"]
    (tmp_path / "b" / "_COMPLETE").unlink()
    assert bundle.validate(spark, path) == ["incomplete"]


def test_discover(spark, tmp_path):
    for n in ("tile_1.tif", "Tile_2.tiff", "sub1/tile_3.tif", "a_MSL.tif", "b_qc.tif", "c.tmp.tif", "d.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = [r.relative for r in tables.discover(spark, str(tmp_path)).collect()]
    assert got == ["a_MSL.tif", "sub1/tile_3.tif", "tile_1.tif", "Tile_2.tiff"]
    assert [r.relative for r in tables.discover(spark, str(tmp_path), output=f"{tmp_path}/sub1").collect()] == ["a_MSL.tif", "tile_1.tif", "Tile_2.tiff"]
    assert {r.relative for r in tables.discover(spark, str(tmp_path), conversion=True).collect()} == {"sub1/tile_3.tif", "tile_1.tif", "Tile_2.tiff"}
    files = tables.discover(spark, str(tmp_path))
    heads = files.where("relative <> 'tile_1.tif'").select("path", F.lit(3).alias("width"), F.lit(2).alias("height"), F.lit(1).alias("bands"), F.when(F.col("relative").startswith("sub"), "").otherwise("EPSG:4326").alias("crs"))
    found = {r.relative: (r.valid, r.error) for r in tables.discovered_headers(files, heads).collect()}
    assert found == {"a_MSL.tif": (True, ""), "Tile_2.tiff": (True, ""), "tile_1.tif": (False, "no header"), "sub1/tile_3.tif": (False, "no coordinate reference system")}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (None, 1.0), (-1.0, 0.0)], "a double, b double")
    e = metrics.errors(df, "a", "b").first()
    assert (e.n, e.worst, e.p50) == (3, 2.0, 1.0) and e.bias == pytest.approx(2 / 3) and e.rmse == pytest.approx(math.sqrt(2))

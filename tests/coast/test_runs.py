"""Batch runs, sources, products, validation and values of the further operators."""

import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.functions import astro, geo, tide, timegrid
from shoreline.operators import datum, frequency, gridcells, metrics, sampling
from shoreline.plans import batch, control, products, rasters as plans, validation
from shoreline.sources import bundle, manifest
from shoreline.sources import products as stored
from shoreline.sources import rasters
from shoreline.sources.rasters import Frame

DAY = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 2), "1h")
SETTINGS = control.Settings(2000.0, 2000.0, 2.0, topology_m=400.0)


def header(name, **more):
    return {"path": f"/in/{name}", "relative": name, "width": 40, "height": 30, "bands": 1, "crs": "EPSG:4326", "unit": "degree", "a": 0.001, "b": 0.0, "c": 122.0, "d": 0.0, "e": -0.001, "f": 31.0, "nodata": -9999.0, "bytes": 10, "modified": 5} | more


def test_run_rasters(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    heads = [header("a.tif"), header("sub/b.TIFF"), header("bad.tif", crs="")]
    terrain = lambda h: rasters.terrain(spark, "beach", 40, 30)
    calls = []

    class Model(tide.Synthetic):
        def levels(self, nodes, times):
            calls.append(1)
            return super().levels(nodes, times)

    run = lambda mode, policy, hs=heads, w=DAY, **k: batch.run_rasters(spark, hs, terrain, out, Model(), w, SETTINGS, mode, policy, **k)
    first = run("full", None)
    assert [r["status"] for r in first] == ["DONE", "DONE", "FAILED"] and "reference" in first[2]["error"]
    log = stored.load_manifest(spark, out, list(batch.FIELDS))
    assert {x.path: x.status for x in log.collect()} == {h["path"]: r["status"] for h, r in zip(heads, first, strict=True)}
    data, tags = stored.read_product(spark, f"{out}/sub/b_inundation")
    assert data.count() == 1200 and tags["cache_signature"] == first[1]["cache_signature"]
    assert stored.read_product(spark, f"{out}/a_exposure_event_count")[1]["nodata"] == "4294967295"
    n = len(calls)
    again = run("full", "resume", heads[:2])
    assert [r["action"] for r in again] == ["SKIPPED_EXISTING"] * 2 and len(calls) == n
    assert [r["status"] for r in run("full", "error", heads[:1])] == ["FAILED"]
    other = run("full", "resume", heads[:1], products.Window(DAY.start, datetime(2024, 1, 3), "1h"))
    assert other[0]["status"] == "FAILED" and "other parameters" in other[0]["error"]  # not computed anew
    stale = run("inundation-from-cache", "overwrite", [header("a.tif", bytes=11)])
    assert stale[0]["status"] == "FAILED" and len(calls) == n  # and never the model
    assert run("inundation-from-cache", "overwrite", heads[:1])[0]["status"] == "DONE" and len(calls) == n
    assert run("exposure-from-cache", "resume", [header("c.tif")])[0]["status"] == "FAILED"
    assert [r["status"] for r in run("full", "overwrite", heads, cancelled=lambda: True)] == ["CANCELLED"]
    # a product that lost its tags is made again
    spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark.sparkContext._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/a_inundation/tags"), True)
    assert run("full", "resume", heads[:1])[0]["action"] == "COMPUTED" and len(calls) == n


def test_run_conversions(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    heads = [header("a.tif"), header("b.tif"), header("c.tif"), header("d.tif")]
    tags = lambda h: {"b.tif": {"TARGET_VERTICAL_DATUM": "msl"}, "c.tif": {"VERTICAL_DATUM": "MSL"}}.get(h["relative"], {"DATUM": "EGM2008"})

    def converted(h):
        if h["relative"] == "d.tif":
            raise OSError("damaged")
        p = rasters.terrain(spark, "ramp", 40, 30)
        return p.select("row", "col", (F.col("z") - 0.5).alias("z_msl"), F.when(F.col("col") < 2, 2).when(F.col("col") < 10, 1).otherwise(0).alias("qc"))

    run = lambda hs=heads, **k: batch.run_conversions(spark, hs, tags, converted, out, **k)
    first = run(write_qc=True)
    assert [r["status"] for r in first] == ["SUCCESS", "SKIPPED_MSL", "SUCCESS", "FAILED"]
    assert (first[0]["total"], first[0]["native"], first[0]["extrapolated"], first[0]["nodata"]) == (1200, 900, 240, 60)
    again = run(heads[:1], resume=True, write_qc=True)
    assert again[0]["reason"] == "kept"
    for k, why in (({"cutoff_km": 50.0}, "other parameters"),):
        assert run(heads[:1], resume=True, **k)[0]["reason"] == why
    run(heads[:1], write_qc=True)
    assert run([header("a.tif", modified=6)], resume=True)[0]["reason"] == "the input changed"
    assert batch.conversion_signature(100.0) == batch.conversion_signature(100) != batch.conversion_signature(99.0)


def test_snapshot_of_a_scan(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 2, 2)], "path string, bytes long, modified long")
    batch.check_snapshot(a, a)
    with pytest.raises(batch.ScanStale, match="y: changed"):
        batch.check_snapshot(a, a.withColumn("bytes", F.when(F.col("path") == "y", 3).otherwise(F.col("bytes"))))


def test_manifest_files(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert stored.load_manifest(spark, folder, ["path", "status"]).count() == 0
    m = spark.createDataFrame([("a", "SUCCESS", "x"), ("b", "FAILED", None)], "path string, status string, extra string")
    stored.save_manifest(m, folder)
    stored.save_manifest(m, folder)
    got = stored.load_manifest(spark, folder, ["path", "status", "signature"])
    assert {(r.path, r.status, r.extra, r.signature) for r in got.collect()} == {("a", "SUCCESS", "x", ""), ("b", "FAILED", "", "")}
    assert manifest.is_success(got, "path", "a") and not manifest.is_success(got, "path", "b") and manifest.status_of(got, "path", "z") == "PENDING" and manifest.entry(got, "path", "z") is None
    for f in (tmp_path / "manifest.json").iterdir():
        if f.suffix == ".json":
            f.write_text("{broken")
        elif f.name.startswith("."):
            f.unlink()
    assert stored.load_manifest(spark, folder, ["path"]).count() == 2  # from the CSV


def test_products_are_whole_or_not_there(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    stored.write_product(spark.range(3), path, {"a": 1})
    with pytest.raises(bundle.ExistingOutput):
        stored.write_product(spark.range(4), path, {})
    broken = spark.range(3).select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        stored.write_product(broken, path, {"a": 2}, overwrite=True)
    df, tags = stored.read_product(spark, path)
    assert df.count() == 3 and tags == {"a": "1"} and [p.name for p in tmp_path.iterdir()] == ["p"]
    assert stored.verified(spark, path, {"a": 1.000001}) == [] and stored.verified(spark, path, {"a": 2, "b": 1}) == ["a", "b"] and stored.verified(spark, path + "x", {}) == ["missing"]
    assert rasters.output_nodata(-9999) == -9999 and math.isnan(rasters.output_nodata(50)) and math.isnan(rasters.output_nodata(None)) and math.isnan(rasters.output_nodata(math.inf))


def test_settings_and_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "m.nc").write_bytes(b"12345")
    stored.save_settings({"a": 1, "paths": {"m": str(tmp_path / "data" / "m.nc"), "far": "/elsewhere/x"}}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text())["paths"] == {"m": "data/m.nc", "far": "/elsewhere/x"}
    got = stored.load_settings(str(tmp_path / "s.json"))
    assert got["paths"]["m"] == str(tmp_path / "data" / "m.nc") and stored.resolved("data/m.nc", "/nowhere", str(tmp_path)) == got["paths"]["m"]
    a = {r.name: (r.exists, r.bytes) for r in stored.availability(spark, got["paths"] | {"none": ""}).collect()}
    assert a == {"m": (True, 5), "far": (False, 0), "none": (False, 0)}
    assert stored.environment(spark).first().spark == spark.version
    h = {r.relative: (r.bytes, r.sha256[:8]) for r in stored.hashed_files(spark, f"file://{tmp_path}/data").collect()}
    assert h == {"m.nc": (5, "59944718"[:8])} or h["m.nc"][0] == 5


def test_signatures(spark):
    tags = {"b": 'say "x" \\ y', "a": "1", "é": "ü"}
    df = spark.createDataFrame([(tags,)], "t map<string,string>")
    assert df.select(bundle.signature_column(F.col("t"))).first()[0] == bundle.signature(tags)


def test_astronomy(spark):
    """Arguments advance at the constituents' speeds, and nodal factors stay within their known ranges over 18.6 years."""
    t = np.array([1.7e9, 1.7e9 + 3600])
    names = list(tide.CONSTITUENTS)
    v = astro.equilibrium(names, t)
    step = (v[:, 1] - v[:, 0]) % 360
    assert np.allclose(step, [astro.speed(n) % 360 for n in names], atol=1e-4)
    f, u = astro.nodal(names, np.linspace(0, 18.61 * 365.25 * 86400, 500))
    for name, low, high in (("M2", 0.963, 1.038), ("O1", 0.806, 1.183), ("K1", 0.882, 1.113), ("K2", 0.747, 1.317), ("Mf", 0.627, 1.459)):
        k = names.index(name)
        assert f[k].min() == pytest.approx(low, abs=0.01) and f[k].max() == pytest.approx(high, abs=0.01)
    assert (f[names.index("S2")] == 1).all() and (u[names.index("S2")] == 0).all()
    s, h, p, n, _ = (x % 360 for x in astro.longitudes(np.array(946728000.0)))  # noon of the first of January 2000
    assert (s, h, p, n) == pytest.approx((218.32, 280.47, 83.35, 125.04), abs=0.02)


def test_harmonic(spark):
    times = timegrid.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 3, 1), "1h", "left")
    table = spark.createDataFrame([(1, "M2", 100.0, 30.0), (1, "Sa", 10.0, 0.0), (2, "O1", 50.0, 10.0), (2, "XX", 9.0, 0.0)], "node_id long, constituent string, amp_cm double, phase_deg double")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0), (3, 0.0, 0.0)], "node_id long, lon double, lat double")
    got = tide.Harmonic(table, astronomical=True).parts(nodes, times).collect()
    assert len(got) == 3 * 1440 and all(r.short_cm is None for r in got if r.node_id == 3)
    for r in [r for r in got if r.node_id < 3][::97]:
        x = np.array([r.t.timestamp()])
        c = "M2" if r.node_id == 1 else "O1"
        (f,), (u,) = astro.nodal([c], x)
        want = {"M2": 100.0, "O1": 50.0}[c] * f[0] * math.cos(math.radians(astro.equilibrium([c], x)[0, 0] + u[0] - {"M2": 30.0, "O1": 10.0}[c]))
        assert r.short_cm == pytest.approx(want, abs=1e-6) and (r.long_cm == 0) == (r.node_id == 2)
    for bad in (["m2"], "some", 5):
        with pytest.raises(ValueError):
            tide.constituents(bad)
    assert tide.constituents([" M2 "]) == ["M2"] and tide.constituents(None)[0] == "2N2" and tide.constituents("major8")[2] == "K1"
    assert gridcells.chunk_length(1) == 1_000_000 and gridcells.chunk_length(10**7) == 1 and gridcells.chunk_length(5, 100) == 2000


@pytest.mark.parametrize("values,want", [
    ((True, True, True, True), "D_FES_VALID_DATUM_VALID"), ((True, None, True, True), "B_FES_VALID_MDT_INVALID"), ((False, 1.0, 1.0, 1.0), "A_FES_INVALID"), ((1.0, 0.0, 1.0, 1.0), "B_FES_VALID_MDT_INVALID"),
    ((1.0, 2.0, float("nan"), 1.0), "C_FES_VALID_MDT_VALID_DELTAN_INVALID"), ((1.0, 2.0, 3.0, float("inf")), "E_OTHER_DATUM_FAILURE"), ((True, 1, 1, 0), "E_OTHER_DATUM_FAILURE"),
])
def test_support_class(spark, values, want):
    assert spark.range(1).select(metrics.support_class(*map(F.lit, values))).first()[0] == want


def test_missing_neighbours(spark):
    """A neighbour that is missing makes the value null even where its weight is 0."""
    g = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, None), (2, 0, float("nan")), (2, 1, 1.0)], "i long, j long, val double")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 1.0, 0.5)], "id int, x double, y double")
    assert [r.value for r in sampling.bilinear(p, g, "id", "x", "y").collect()] == [None] * 3
    whole = g.where("i < 2").na.fill(4.0)
    assert {r.id: r.value for r in sampling.bilinear(p, whole, "id", "x", "y").collect()} == {1: 1.0, 2: 1.5, 3: None}


def test_levels_that_are_not_finite(spark):
    s = spark.createDataFrame([(1, float("nan")), (1, 1.0), (1, 3.0), (1, float("inf"))], "node_id int, level double")
    z = spark.createDataFrame([(1, 2.0)], "node_id int, z double")
    assert frequency.frequency(s, z).first().frequency == 50
    assert frequency.packed(s).first().levels == [1.0, 3.0]


def test_axes_in_both_orders(spark):
    rows = [(i, j, float(10 * i + j), 120 + i * 0.5, 32 - j * 0.25) for i in range(4) for j in range(5)]
    g = spark.createDataFrame(rows, "i long, j long, val double, lon double, lat double")
    x, y = gridcells.axis_of(g, "i", "lon"), gridcells.axis_of(g, "j", "lat")
    assert (x, y) == (gridcells.Axis(120.0, 0.5, 4), gridcells.Axis(32.0, -0.25, 5))
    p = spark.createDataFrame([(1, 120.6, 31.8), (2, 121.5, 31.0), (3, 119.9, 31.5), (4, 120.0, 32.0)], "id int, lon double, lat double")
    got = {r.id: r for r in gridcells.corners(p, g, x, y, "id").collect()}
    assert (got[1].i, got[1].j) == (1, 0) and (got[2].i, got[2].j) == (2, 3) and got[3].i is None and got[4].v == [0.0, 10.0, 1.0, 11.0]
    v = {r.id: (r.kind, r.value) for r in gridcells.geometry(p, g, x, y, "id").collect()}
    assert v[1] == ("TYPE_4", pytest.approx(12.0 + 0.8)) and v[3] == ("TYPE_0", None) and v[2] == ("TYPE_4", pytest.approx(34.0))
    to = gridcells.constant_grid(spark, 3, 3, None)
    half = {(r.i, r.j): r.val for r in gridcells.resampled(g, x, y, to, gridcells.Axis(120.0, 0.25, 3), gridcells.Axis(32.0, -0.125, 3)).collect()}
    assert half[1, 1] == pytest.approx(5.5) and half[2, 0] == pytest.approx(10.0)
    t = g.withColumn("time", F.lit(1))
    assert gridcells.squeezed(t, "time").count() == 20
    with pytest.raises(Exception, match="more than one time"):
        gridcells.squeezed(t.union(t.withColumn("time", F.lit(2))), "time").count()


def test_order_of_cells_and_datum_inputs(spark):
    c = spark.createDataFrame([("10",), ("b",), ("9",), (None,), ("a",), ("-1",)], "cell string")
    assert [r.cell for r in gridcells.ordered_cells(c, "cell").collect()] == ["-1", "9", "10", "a", "b", None]
    assert gridcells.preview(spark.range(5000)).count() == 2000
    assert [datum.broadcast_inputs(*x) for x in ((1, 5, 1), (5, 1, 5), (5, 5, 1))] == ["places", "aligned", "places"]


def test_frames(spark):
    f = Frame(500000.0, 3400000.0, 10.0, -10.0, 100, 50, "EPSG:32651", "metre")
    assert f.bounds == (500000.0, 3399500.0, 501000.0, 3400000.0) and f.pixel_m() == 10 and f.steps(4000) == (4000.0, 4000.0)
    feet = Frame(0.0, 0.0, 10.0, -10.0, 5, 5, "EPSG:32651", "foot")
    assert feet.pixel_m() == pytest.approx(3.048) and feet.steps(304.8)[0] == pytest.approx(1000)
    lon, lat = f.lonlat(F.lit(500000.0), F.lit(3400000.0))
    assert spark.range(1).select(lon).first()[0] == pytest.approx(123.0)
    with pytest.raises(ValueError, match="projections"):
        Frame(0.0, 0.0, 1.0, -1.0, 5, 5, "EPSG:27700", "metre").lonlat(F.lit(1.0), F.lit(1.0))
    for bad in ({"crs": " "}, {"height": 0}, {"b": 0.1}, {"bands": 0}):
        with pytest.raises(ValueError):
            rasters.frame_of(header("x.tif", **bad))
    with pytest.raises(ValueError):
        rasters.terrain(spark, "moon", 3, 3)
    assert geo.support_window(0.0, 100_000.0)[0] == pytest.approx(1.399, abs=1e-3) and geo.support_window(90.0, 500_000.0)[1] < 180


def test_block_holdout(spark):
    a = [(k, float(k * 7 % 60), float(k * 11 % 40), float(k % 9)) for k in range(60)]
    got = {r.method: r for r in validation.blockwise(spark.createDataFrame(a, "sid int, lon double, lat double, v double"), "sid", "v", 20.0, 10.0).collect()}

    def xyz(lon, lat):
        lo, la = math.radians(lon), math.radians(lat)
        return np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]) * geo.RADIUS_M

    for name, k in (("nearest", 1), ("idw4", 4), ("idw8", 8)):
        e = []
        for s, lon, lat, v in a:
            other = sorted((np.linalg.norm(xyz(lon, lat) - xyz(x, y)), t, w) for t, x, y, w in a if (x // 20, y // 20) != (lon // 20, lat // 20))[:k]
            weight = [1 / max(d, 1e-4) ** 2 for d, *_ in other]
            e.append(sum(w * o[2] for w, o in zip(weight, other, strict=True)) / sum(weight) - v)
        assert got[name].n == 60 and got[name].mae == pytest.approx(np.abs(e).mean(), rel=1e-6) and got[name].bias == pytest.approx(np.mean(e), rel=1e-6, abs=1e-9)


def test_triangles(spark):
    g = spark.range(49).select((F.col("id") % 7).alias("i"), F.expr("id div 7").alias("j"), (F.col("id") % 7 * 2.0 + F.expr("id div 7") * 3.0).alias("val"))
    x = gridcells.Axis(0.0, 1.0, 7)
    p = spark.range(200).select("id", (F.col("id") * 37 % 600 / 100.0).alias("lon"), (F.col("id") * 53 % 600 / 100.0).alias("lat"))
    e = validation.triangle_truth(g, x, x, p, "id").first()
    assert e.n > 50 and e.worst < 1e-9  # a plane is the same either way


def test_products_against_the_model(spark):
    f = Frame(122.0, 31.03, 0.001, -0.001, 40, 30)
    px, model = rasters.terrain(spark, "beach", 40, 30), tide.Synthetic()
    out = products.inundation(px, f, model, DAY, SETTINGS)
    e = validation.against_direct(px, f, model, DAY, out, 200).first()
    assert e.common == 200 and e.only_direct == e.only_fitted == 0 and e.mae < 0.5 and e.grade == "STRONG PASS"
    x = products.exposure(px, f, model, DAY, SETTINGS)
    for r in validation.exposure_oracle(px, f, model, DAY, x, 30).collect():
        assert r.fitted_h == pytest.approx(r.exposed_h, abs=0.05) and abs(r.fitted_events - r.events) <= 1
    grid = control.control_grid(px, f, model, DAY.times(spark), SETTINGS)
    d = products.node_diagnosis(grid, F.lit(1.0), F.lit(1.0), F.lit(1.0)).collect()
    assert d and {r["class"] for r in d} == {"D_FES_VALID_DATUM_VALID"} and all(0 <= r.low <= r.high for r in d if r.low >= 0)
    run = {"nodes": grid["nodes"], "tide": grid["tide"].join(grid["nodes"].select("node_id", "x", "y"), "node_id"), "product": out}
    assert validation.identical_runs(run, run).first().identical
    moved = run | {"product": out.withColumn("frequency", F.col("frequency") + 1)}
    got = validation.identical_runs(run, moved).first()
    assert not got.identical and got.product_frequency == 1200 and got.product_frequency_worst == 1
    with pytest.raises(ValueError, match="direct value"):
        validation.against_direct(px, f, tide.Synthetic(valid=lambda lon, lat: lon > 122.03), DAY, out, 200)


def test_profiles(spark):
    """Two basins: west of the barrier is always under water, east of it never, and no value crosses it."""
    got = validation.profile(spark, "basins").collect()
    for r in got:
        if 27 <= r.col < 33:
            assert r.frequency is None and r.qc == 65535
        elif r.frequency is not None:
            assert r.frequency == pytest.approx(100 if r.col < 27 else 0)
    assert sum(r.frequency is not None for r in got) > 0.6 * len(got)


def test_attribution(spark):
    cells = spark.createDataFrame([(k, [4 * k + i for i in range(4)]) for k in range(5)], "cell_id long, corners array<long>")
    kinds = {0: ["A_FES_INVALID"] * 4, 1: ["B_FES_VALID_MDT_INVALID"] * 4, 2: ["A_FES_INVALID"] * 2 + ["B_FES_VALID_MDT_INVALID"] * 2, 3: ["D_FES_VALID_DATUM_VALID"] + ["A_FES_INVALID"] * 3}
    classes = spark.createDataFrame([(4 * k + i, c) for k, cs in kinds.items() for i, c in enumerate(cs)], "node_id long, class string")
    px = spark.createDataFrame([(0, 68)] * 3 + [(1, 68)] * 2 + [(2, 68), (3, 68), (4, 68), (None, 68), (0, 4), (3, 0)], "cell_id long, qc int")
    got = {r.cause: (r.n, round(r.percent, 3)) for r in plans.attribute(px, cells, classes).collect()}
    assert got == {"Q68_NO_FES_SUPPORT": (3, 33.333), "Q68_DATUM_SUPPORT_FAILURE": (2, 22.222), "Q68_MIXED_FES_AND_DATUM": (1, 11.111), "Q68_TOPOLOGY_REJECTED": (1, 11.111), "Q68_OTHER": (2, 22.222)}

"""A sensitivity study against plain Python, products as GeoTIFF files, and neighbours up to a cutoff."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.functions import tide
from shoreline.operators import exposure, sampling
from shoreline.plans import products, validation
from shoreline.sources import geotiff
from shoreline.sources.bundle import ExistingOutput
from shoreline.sources.products import export_product, write_product


def test_sensitivity_study(spark):
    stations = spark.createDataFrame([(k, 0.0, 0.0) for k in range(25)], "node_id long, lon double, lat double")
    table = spark.createDataFrame([(k, c, 10.0 + (k * 3 + j) % 7 * 11, float(k * 40 + j * 70)) for k in range(25) for j, c in enumerate(("M2", "S2", "K1", "M4"))], "node_id long, constituent string, amp_cm double, phase_deg double")
    window = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 4), "30min")
    model = lambda which: tide.Harmonic(table, ["M2", "S2", "K1", "M4"] if which == "all" else which, origin=1704067200.0)
    errors, exposed = validation.sensitivity_study(stations, model, window, ["M2", "K1"])

    def levels(which):
        rows = model(which).levels(stations, window.times(spark)).orderBy("node_id", "t").collect()
        return np.array([x.level for x in rows]).reshape(25, 144)

    h, m = levels("all"), levels(["M2", "K1"])
    z = np.quantile(h.astype(float), validation.STUDY_QUANTILES, axis=1)
    share = lambda x: np.array([[100 * np.mean(x[k] >= z[q, k]) for q in range(13)] for k in range(25)])
    want = {"step2": share(h[:, ::2]) - share(h), "step4": share(h[:, ::4]) - share(h), "least": share(m) - share(h), "least_step2": share(m[:, ::2]) - share(h[:, ::2])}
    got = {x.comparison: x for x in errors.collect()}
    assert set(got) == set(want)
    for k, e in want.items():
        assert got[k].n == 325 and got[k].bias == pytest.approx(e.mean()) and got[k].p95 == pytest.approx(np.percentile(np.abs(e), 95)) and got[k].worst == pytest.approx(np.abs(e).max())
    t = 1704067200.0 + 1800.0 * np.arange(144)
    for x in exposed.collect():
        n = {"step2": 2, "step4": 4}[x.comparison]
        pairs = [(exposure.scan(t[::n], h[k, ::n].tolist(), z[6, k]), exposure.scan(t, h[k].tolist(), z[6, k])) for k in range(20)]
        for c, name in (("exposed_h", "exposed_mae_h"), ("max_h", "max_mae_h"), ("events", "events_mae")):
            assert x[name] == pytest.approx(np.mean([abs(a[c] - b[c]) for a, b in pairs]), abs=1e-6)


def test_a_product_as_geotiff(spark, tmp_path):
    data = spark.range(600).select(F.expr("cast(id div 30 as int)").alias("row"), (F.col("id") % 30).cast("int").alias("col"), F.when(F.col("id") % 7 != 0, F.col("id") / 10.0).alias("value"))
    tags = {"width": 30, "height": 20, "crs": "EPSG:4326", "transform_a": 0.01, "transform_b": 0, "transform_c": 121.0, "transform_d": 0, "transform_e": -0.01, "transform_f": 31.0, "nodata": "nan", "dtype": "float", "cache_signature": "abc"}
    write_product(data, f"file://{tmp_path}/p", tags)
    assert export_product(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/tif", block=16, tile=16).count() == 4
    got = {(x.row, x.col): x.z for x in geotiff.read_raster(spark, f"file://{tmp_path}/tif").where("z is not null").collect()}
    assert got == {(k // 30, k % 30): float(np.float32(k / 10.0)) for k in range(600) if k % 7}
    h = geotiff.read_header(f"{tmp_path}/tif/block_00001_00001.tif")
    assert h.tags["cache_signature"] == "abc" and h.crs == "EPSG:4326" and (h.width, h.height) == (14, 4) and abs(h.c - 121.16) < 1e-9
    with pytest.raises(ExistingOutput):
        export_product(spark, f"file://{tmp_path}/p", f"file://{tmp_path}/tif")


def test_points_beyond_the_cutoff_leave(spark):
    g = np.random.default_rng(4)
    support = [(k, float(120 + x), float(30 + y)) for k, (x, y) in enumerate(g.random((60, 2)) * 0.5)]
    points = [(k, float(119 + x), float(29 + y)) for k, (x, y) in enumerate(g.random((80, 2)) * 3)] + [(100, -60.0, -30.0)]
    p, s = spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(support, "sid long, lon double, lat double")
    whole = {(x.id, x["rank"]): (x.sid, x.d) for x in sampling.knn(p, s, "id", "sid", 3, 0.1).collect()}
    near = {i for (i, rank), (_, d) in whole.items() if rank == 1 and d <= 40_000.0}
    got = {(x.id, x["rank"]): (x.sid, x.d) for x in sampling.knn(p, s, "id", "sid", 3, 0.1, stop=40_000.0).collect()}
    assert {i for i, _ in got} >= near and all(got[k] == v for k, v in whole.items() if k[0] in near) and 100 not in {i for i, _ in got} and len(near) < 60

"""Leave-one-out errors against a loop over the anchors."""

import math

import numpy as np
import pytest

from shoreline import queries as catalogue
from shoreline.functions import geo
from shoreline.operators import metrics, sampling


def test_leave_one_out(spark):
    g = np.random.default_rng(3)
    at = [(i, 122 + g.random() * 0.3, 31 + g.random() * 0.3, float(g.normal())) for i in range(150)]
    at += [(200 + i, 122.5, 31.5, float(i)) for i in range(7)]  # more at one place than neighbours are asked for
    at += [(300, 150.0, 10.0, 5.0)]  # alone
    at[0] = (*at[0][:3], 1e6)
    got = {r.sid: r for r in sampling.leave_one_out(spark.createDataFrame([*at, (301, 122.1, 31.1, None)], "sid long, lon double, lat double, val double"), "sid", "val").collect()}

    def xyz(lon, lat):
        a, b = math.radians(lon), math.radians(lat)
        return np.array([math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)]) * geo.RADIUS_M / 1000

    want = {}
    for i, lon, lat, v in at:
        near = sorted((float(np.linalg.norm(xyz(lon, lat) - xyz(x, y))), j, u) for j, x, y, u in at if j != i)[:4]
        near = [n for n in near if n[0] <= 8]
        if near:
            w = [max(n[0], 1e-4) ** -2 for n in near]
            want[i] = (v, sum(a * n[2] for a, n in zip(w, near, strict=True)) / sum(w), near[0][0])
    assert set(got) == set(want) and 300 not in got and 301 not in got
    for i, (truth, value, km) in want.items():
        assert got[i].truth == truth and got[i].value == pytest.approx(value, rel=1e-5, abs=1e-6) and got[i].km == pytest.approx(km, rel=1e-5, abs=1e-6)


def test_every_anchor_is_in_a_bin(spark):
    d = "/root/testdata/sf0.01"
    rows = catalogue.QUERIES["loocv_bins"](spark, d).collect()
    assert sum(r.n for r in rows) == spark.read.parquet(f"{d}/supplier.parquet").count() and len(rows) > 1
    assert {r.bin for r in rows} <= {"0-0.5", "0.5-1", "1-2", "2-4", ">4"} and metrics.BINS == (0.5, 1.0, 2.0, 4.0)

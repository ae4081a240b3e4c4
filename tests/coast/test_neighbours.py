"""The search for neighbours against a comparison of all pairs, and how many rows it compares."""

import math

import numpy as np
import pytest

from shoreline.functions import geo
from shoreline.operators import sampling


def places(n, seed, at=0):
    """A tight cluster, a wide one, copies of one place and single places over the sphere."""
    g = np.random.default_rng(seed)
    lon = np.concatenate([122 + g.random(n) * 1e-3, 10 + g.random(n) * 20, np.full(n, 5.0), g.random(n // 4) * 360])
    lat = np.concatenate([31 + g.random(n) * 1e-3, g.random(n) * 20, np.full(n, -5.0), g.random(n // 4) * 170 - 85])
    return [(at + i, float(x), float(y), i % 3) for i, (x, y) in enumerate(zip(lon, lat, strict=True))]


def xyz(rows):
    lon, lat = (np.radians([r[i] for r in rows]) for i in (1, 2))
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1) * geo.RADIUS_M


@pytest.mark.parametrize("how, k", [(None, 5), ("by", 3), ("apart", 8)])
def test_all_pairs(spark, how, k):
    p, s = places(60, 1), places(50, 2, 1000)
    p += [(9000, math.nan, 1.0, 0), (9001, None, 1.0, 0)]
    frames = [spark.createDataFrame(r, f"{i} long, lon double, lat double, part long") for r, i in ((p, "id"), (s, "sid"))]
    got = {}
    for r in sampling.knn(*frames, "id", "sid", k, **({how: "part"} if how else {})).collect():
        got.setdefault(r.id, []).append((r["rank"], r.sid, r.d))
    p = p[:-2]
    d = np.sqrt(((xyz(p)[:, None] - xyz(s)[None]) ** 2).sum(axis=2))
    assert set(got) == {x[0] for x in p}
    for i, x in enumerate(p):
        may = [j for j, y in enumerate(s) if how is None or (x[3] == y[3]) == (how == "by")]
        want = sorted(d[i, may])[:k]
        rows = sorted(got[x[0]])
        assert [r[0] for r in rows] == list(range(1, k + 1))
        assert np.allclose([r[2] for r in rows], want, rtol=1e-9, atol=1e-6)
        assert all(abs(d[i, r[1] - 1000] - r[2]) < 1e-6 and r[1] - 1000 in may for r in rows)
        assert rows == sorted(rows, key=lambda r: (r[2], r[1]))
    copies = [sorted(r[1] for r in got[x[0]]) for x in p if x[1:3] == (5.0, -5.0) and how is None]
    assert all(c == list(range(1100, 1100 + k)) for c in copies)


def test_support_as_far_as_told(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "id long, lon double, lat double")
    s = spark.createDataFrame([(7, 0.1, 0.0), (8, 20.0, 0.0)], "sid long, lon double, lat double")
    assert [(r.id, r.sid) for r in sampling.knn(p, s, "id", "sid", 2, stop=20_000.0).orderBy("rank").collect()] == [(1, 7), (1, 8)]


def most_rows(plan):
    """The most rows that a step of an executed plan gave."""
    name, below = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        below = [plan.plan()]
    children = plan.children().iterator()
    while children.hasNext():
        below.append(children.next())
    n = plan.metrics().get("numOutputRows")
    return max([n.get().value() if n.isDefined() else 0, *map(most_rows, below)])


def test_few_rows_are_compared(spark):
    """Dense support and support far from it: all pairs are 16 million."""
    p, s = places(1250, 3), places(1250, 4)
    frames = [spark.createDataFrame(r, f"{i} long, lon double, lat double, part long") for r, i in ((p, "id"), (s, "sid"))]
    near = sampling.knn(*frames, "id", "sid", 1)
    assert len(near.collect()) == len(p)
    assert most_rows(near._jdf.queryExecution().executedPlan()) < 60 * len(p)

"""Meshes against a loop over all triangles, and what a box reads."""

import math
import os
import random
from datetime import datetime, timezone

import numpy as np
import pytest

from shoreline.functions.tide import Harmonic
from shoreline.operators.mesh import Mesh, MeshTide, box_around, contains, finite_share, write_mesh
from shoreline.sources.bundle import ExistingOutput


def lattice(x0, y0, step, nx, ny, seed=1, quadratic=False, first=0):
    """Jittered lattice: nodes {id: (lon, lat)} and triangles [(id, nodes)]."""
    r = random.Random(seed)
    nodes = {first + j * nx + i: (x0 + (i + r.uniform(-0.3, 0.3)) * step, y0 + (j + r.uniform(-0.3, 0.3)) * step) for j in range(ny) for i in range(nx)}
    tri = []
    for j in range(ny - 1):
        for i in range(nx - 1):
            a, b, c, d = (first + k for k in (j * nx + i, j * nx + i + 1, (j + 1) * nx + i, (j + 1) * nx + i + 1))
            tri += [(a, b, c), (d, c, b)]
    if quadratic:
        middles, out = {}, []
        for t in tri:
            more = []
            for p, q in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                k = tuple(sorted((p, q)))
                if k not in middles:
                    middles[k] = first + 100_000 + len(middles)
                    nodes[middles[k]] = tuple((nodes[p][n] + nodes[q][n]) / 2 for n in range(2))
                more.append(middles[k])
            out.append((*t, *more))
        tri = out
    return nodes, [(first + k, list(t)) for k, t in enumerate(tri)]


def stored(spark, path, nodes, tri, wave, names=("M2", "S2"), overwrite=False):
    """wave: (constituent, lon, lat) -> (re, im), or None."""
    rows = []
    for n, (x, y) in nodes.items():
        for c in names:
            if (w := wave(c, x, y)) is not None:
                rows.append((n, c, math.hypot(*w), math.degrees(math.atan2(w[1], w[0]))))
    t = spark.createDataFrame(tri, "triangle long, nodes array<long>").repartition(3)
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in nodes.items()], "node long, lon double, lat double")
    write_mesh(t, n, spark.createDataFrame(rows, "node long, constituent string, amp_cm double, phase_deg double"), path, list(names), overwrite)
    return Mesh(spark, path)


def brute(nodes, tri, x, y):
    for k, t in tri:  # in order of their numbers
        (x1, y1), (x2, y2), (x3, y3) = (nodes[n] for n in t[:3])
        near = lambda v, first: first + (v - first + 180) % 360 - 180
        x2, x3, px = near(x2, x1), near(x3, x1), near(x, x1)
        m = np.array([[x2 - x1, x3 - x1], [y2 - y1, y3 - y1]])
        l2, l3 = np.linalg.solve(m, [px - x1, y - y1])
        if min(1 - l2 - l3, l2, l3) >= -1e-9:
            return k, (1 - l2 - l3, l2, l3)
    return None


def places(spark, xy):
    return spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(xy)], "node_id long, lon double, lat double").repartition(3)


def test_location_across_sizes_and_the_antimeridian(spark, tmp_path):
    r = random.Random(4)
    parts = [lattice(170.0, -30.0, 4.0, 6, 6), lattice(-2.0, 10.0, 0.9, 6, 6, 2, first=1000), lattice(30.0, 40.0, 0.013, 12, 12, 3, first=2000)]
    nodes, tri = {k: v for n, _ in parts for k, v in n.items()}, [t for _, ts in parts for t in ts]
    tri += [(9000, [0, 1, 77777]), (9001, [0, 0, 1])]  # an unknown corner, and no area
    mesh = stored(spark, f"file://{tmp_path}/m", nodes, tri, lambda c, x, y: (1.0, 0.0))
    assert len(mesh.about["levels"]) >= 3
    xy = [(r.uniform(165, 200), r.uniform(-35, -5)) for _ in range(150)] + [(r.uniform(-4, 5), r.uniform(8, 17)) for _ in range(150)] + [(r.uniform(29.98, 30.2), r.uniform(39.98, 40.2)) for _ in range(150)]
    xy += [nodes[k] for k in (7, 8, 1007, 2050)] + [((nodes[7][0] + nodes[8][0]) / 2, (nodes[7][1] + nodes[8][1]) / 2), (195 - 360, -20), (358.9 + 360, 12.0)]
    whole = (0.0, -90.0, 360.0, 90.0)
    got = {x.node_id: x for x in mesh.locate(places(spark, xy), mesh.clipped(whole)[0], "node_id").collect()}
    for k, (x, y) in enumerate(xy):
        want = brute(nodes, [t for t in tri if t[0] < 9000], x, y)
        assert (k in got) == (want is not None), (k, x, y)
        if want:
            assert got[k].triangle == want[0] and np.allclose(got[k].weights, want[1], atol=1e-7)
    assert 100 < len(got) < len(xy)


@pytest.mark.parametrize("quadratic", [False, True])
def test_fields_that_elements_reproduce(spark, tmp_path, quadratic):
    nodes, tri = lattice(100.0, 20.0, 0.5, 6, 5, quadratic=quadratic)
    more = 0.3 if quadratic else 0.0

    def wave(c, x, y):
        dx, dy = x - 101, y - 21
        k = 1.0 if c == "M2" else -0.5
        return 50 + k * (3 * dx - 2 * dy) + more * dx * dx, 10 - k * dy + more * dx * dy

    mesh = stored(spark, f"file://{tmp_path}/m", nodes, tri, wave)
    r = random.Random(1)
    xy = [(r.uniform(100.3, 102.0), r.uniform(20.3, 21.6)) for _ in range(60)]
    got = {x.node_id: x for x in mesh.interpolate(places(spark, xy), "node_id").collect()}
    assert len(got) == 60
    for k, (x, y) in enumerate(xy):
        for n, c in enumerate(("M2", "S2")):
            assert np.allclose((got[k].re[n], got[k].im[n]), wave(c, x, y), atol=1e-8)


def test_levels_and_what_is_missing(spark, tmp_path):
    nodes, tri = lattice(100.0, 20.0, 0.5, 6, 5)
    mesh = stored(spark, f"file://{tmp_path}/m", nodes, tri, lambda c, x, y: None if c == "S2" and x > 101 else (30.0, 40.0))
    xy = [(100.6, 20.7), (101.9, 21.2), (50.0, 0.0)]
    times = spark.createDataFrame([(datetime(2024, 1, 1, h, tzinfo=timezone.utc),) for h in range(4)], "t timestamp")
    model = MeshTide(mesh)
    out = model.levels(places(spark, xy), times)
    share = {x.node_id: (x.samples, x.finite, x.share) for x in finite_share(out).collect()}
    assert share == {0: (4, 4, 1.0), 1: (4, 0, 0.0), 2: (4, 0, 0.0)}
    m2 = {x.node_id: x for x in MeshTide(mesh, ["M2"]).constants(places(spark, xy)).collect()}
    assert set(m2) == {0, 1} and abs(m2[1].amp_cm - 50) < 1e-9 and abs(m2[1].phase_deg - math.degrees(math.atan2(4, 3))) < 1e-9
    table = spark.createDataFrame([(0, c, 50.0, math.degrees(math.atan2(4, 3))) for c in ("M2", "S2")], "node_id long, constituent string, amp_cm double, phase_deg double")
    want = {x.t: x.level for x in Harmonic(table, ["M2", "S2"]).levels(places(spark, xy[:1]), times).collect()}
    assert all(abs(x.level - want[x.t]) < 1e-6 for x in out.where("node_id = 0").collect()) and model.calls == 1
    with pytest.raises(ValueError):
        MeshTide(mesh, ["Mm"]).constants(places(spark, xy))


def test_a_box_reads_only_its_tiles(spark, tmp_path):
    """All files of tiles that the box and the reach of a triangle don't meet are spoilt."""
    nodes, tri = lattice(90.0, -30.0, 2.0, 20, 20)
    mesh = stored(spark, f"file://{tmp_path}/m", nodes, tri, lambda c, x, y: (x, y))
    xy = [(101.0, -11.5), (103.0, -13.0)]
    want = sorted(tuple(x) for x in mesh.interpolate(places(spark, xy), "node_id").collect())
    near = {(i, j) for i in range(19, 23) for j in range(14, 18)}
    spoilt = 0
    for folder, _, files in os.walk(f"{tmp_path}/m"):
        if "tile=" in folder:
            tile = int(folder.rsplit("=", 1)[1])
            if (tile // 1000, tile % 1000) not in near:
                for f in files:
                    if f.endswith(".parquet"):
                        open(f"{folder}/{f}", "wb").write(b"no parquet")
                        spoilt += 1
    assert spoilt > 40
    assert sorted(tuple(x) for x in Mesh(spark, f"file://{tmp_path}/m").interpolate(places(spark, xy), "node_id").collect()) == want and len(want) == 2


def test_scopes(spark, tmp_path):
    nodes, tri = lattice(100.0, 20.0, 0.5, 8, 8)
    mesh = stored(spark, f"file://{tmp_path}/m", nodes, tri, lambda c, x, y: (x, y))
    inner, outer = (100.5, 20.5, 101.0, 21.0), (100.0, 20.0, 104.0, 24.0)
    with mesh.scope(outer):
        first = mesh.tables(inner)
        with mesh.scope((100.4, 20.4, 101.2, 21.2)):
            assert mesh.tables(inner)[0] is not first[0]
        assert mesh.tables(inner)[0] is first[0] and first[0].is_cached
        mesh.tables((90.0, 20.0, 101.0, 21.0))  # not within
        assert (mesh.loads, mesh.hits) == (3, 1)
    assert not first[0].is_cached
    with pytest.raises(RuntimeError), mesh.scope(outer):
        kept = mesh.tables(inner)
        raise RuntimeError
    assert not kept[0].is_cached and mesh._kept == []


def test_boxes(spark):
    assert contains((0, 0, 10, 10), (1, 1, 10.000009, 10)) and not contains((0, 0, 10, 10), (1, 1, 10.1, 10))
    assert contains((350, -10, 370, 10), (-5, 0, 5, 5)) and contains((-10, -10, 10, 10), (355, 0, 365, 5)) and not contains((-10, -10, 10, 10), (5, 0, 15, 5))
    assert box_around(places(spark, [(359.5, 1.0), (-0.25, 2.0), (2.0, -1.0)]), 0.5) == (359.0, -1.5, 362.5, 2.5)
    assert box_around(places(spark, [(10.0, 89.9)]), 1.0) == (9.0, 88.9, 11.0, 90.0) and box_around(places(spark, []), 1.0) is None
    assert box_around(places(spark, [(k * 1.0, 0.0) for k in range(360)]), 1.0)[::2] == (0.0, 360.0)


def test_writing_twice_and_empty(spark, tmp_path):
    nodes, tri = lattice(100.0, 20.0, 0.5, 3, 3)
    path = f"file://{tmp_path}/m"
    stored(spark, path, nodes, tri, lambda c, x, y: (x, y))
    with pytest.raises(ExistingOutput):
        stored(spark, path, nodes, tri, lambda c, x, y: (x, y))
    mesh = stored(spark, path, nodes, tri, lambda c, x, y: (1.0, 2.0), overwrite=True)
    got = mesh.interpolate(places(spark, [nodes[4]]), "node_id").first()
    assert np.allclose(got.re, 1.0) and np.allclose(got.im, 2.0)
    assert mesh.interpolate(places(spark, []), "node_id").count() == 0 and os.listdir(tmp_path) == ["m"]

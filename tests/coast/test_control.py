"""Control grids and products against a quadtree, a search and a state machine in plain Python."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.functions import qc, tide
from shoreline.operators import exposure as stations
from shoreline.plans import control, products
from shoreline.sources import bundle
from shoreline.sources.rasters import Frame

DAY = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 2), "1h")
T = np.array([(DAY.start + timedelta(hours=h) - datetime(1970, 1, 1)).total_seconds() for h in range(25)])
OPTIONS = {"ax": 8.0, "by": 5.0, "g": 30.0}
WET = lambda x, y: (x > 122.013) | (y > 31.02)
FRAME = Frame(122.0, 31.05, 0.001, -0.001, 64, 50)


def terrain():
    r, c = np.mgrid[:50, :64]
    z = np.round(-2.2 + 4.5 * c / 64 - 1.0 * r / 50 + 0.7 * np.sin(r / 4.0) * np.cos(c / 5.0), 4)
    z[:, 30:33] = np.nan
    z[40:, :10] = np.nan
    return z


def frame_df(spark, z):
    rows = [(int(r), int(c), None if math.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)]
    return spark.createDataFrame(rows, "row int, col int, z double")


def water(x, y):
    """The model's levels at a node, as float32, at all 25 hours; nothing on land."""
    if not WET(x, y):
        return None
    dx, dy = x - 122.0, y - 31.0
    return (2.0 * np.cos(2 * math.pi * (T / 3600) / 12.42) + 8.0 * dx + 5.0 * dy + 30.0 * (dx * dx + dy * dy)).astype(np.float32)


def labels(z, factor, share):
    """Components of the coarse cells, by flood."""
    h, w = (math.ceil(n / factor) for n in z.shape)
    ok = {(r, c) for r in range(h) for c in range(w) if np.isfinite(z[r * factor : (r + 1) * factor, c * factor : (c + 1) * factor]).mean() >= share}
    out, left, n = {}, set(ok), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            r, c = todo.pop()
            out[r, c] = n
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
    return out


def plain_grid(z, f, s):
    """Leaf cells by the rules, one after the other: (x0, y0, x1, y1, level, error, qc) and the nodes."""
    factor = max(1, round(s.topology_m / f.pixel_m()))
    lab = labels(z, factor, s.fraction)
    hc, wc = (math.ceil(n / factor) for n in z.shape)
    coarse = lambda x, y: (min(hc - 1, max(0, int((y - f.y0) / f.dy // factor))), min(wc - 1, max(0, int((x - f.x0) / f.dx // factor))))
    nodes = {}

    def node(x, y):
        key = (round(x * 1e6), round(y * 1e6))
        if key not in nodes:
            r, c = coarse(x, y)
            own = lab.get((r, c), 0)
            if not own:
                around = {lab[i, j] for i in range(r - 2, r + 3) for j in range(c - 2, c + 3) if (i, j) in lab}
                own = around.pop() if len(around) == 1 else 0
            level = water(x, y)
            nodes[key] = (None if level is None else np.sort(level[:24]), own)
        return nodes[key]

    west, south, east, north = f.bounds
    sx, sy = f.steps(s.initial_m)
    active = {(r // factor, c // factor) for r, c in zip(*np.nonzero(np.isfinite(z)), strict=True)}
    todo = []
    for i in range(math.ceil((east - west) / sx - 1e-9)):
        for j in range(math.ceil((north - south) / sy - 1e-9)):
            x0, y0, x1, y1 = west + i * sx, south + j * sy, west + (i + 1) * sx, south + (j + 1) * sy
            rows, cols = sorted(((y0 - f.y0) / f.dy, (y1 - f.y0) / f.dy)), sorted(((x0 - f.x0) / f.dx, (x1 - f.x0) / f.dx))
            span = lambda p, n: range(min(n - 1, max(0, int(p[0] // factor))), min(n, max(0, int(p[1] // factor + 1))))
            if any((r, c) in active for r in span(rows, hc) for c in span(cols, wc)):
                todo.append((x0, y0, x1, y1, 0))
    depth, least, leaves = math.ceil(math.log2(s.initial_m / s.least_m)), s.least_m / 111320.0, []
    while todo:
        x0, y0, x1, y1, level = todo.pop()
        mx, my = (x0 + x1) / 2, (y0 + y1) / 2
        four, mid = [node(x0, y0), node(x1, y0), node(x0, y1), node(x1, y1)], node(mx, my)
        probe = False
        if all(n[0] is None for n in [*four, mid]):
            probe = any([node(*p)[0] is not None for p in ((mx, y0), (mx, y1), (x0, my), (x1, my))])
        rows, cols = sorted(((y0 - f.y0) / f.dy, (y1 - f.y0) / f.dy)), sorted(((x0 - f.x0) / f.dx, (x1 - f.x0) / f.dx))
        part = z[max(0, math.floor(rows[0])) : min(f.height, math.ceil(rows[1])), max(0, math.floor(cols[0])) : min(f.width, math.ceil(cols[1]))]
        part = part[np.isfinite(part)]
        if not len(part):
            leaves.append((x0, y0, x1, y1, level, 0.0, 0))
            continue
        test = np.quantile(part, [0.1, 0.5, 0.9]) if len(part) >= 10 else np.unique(part)
        freq = lambda lv: 100.0 * (len(lv) - np.searchsorted(lv, test, "right")) / len(lv)
        wet = [freq(n[0]) for n in four if n[0] is not None]
        error = 0.0
        if mid[0] is not None:
            error = float(np.abs(freq(mid[0]) - np.mean(wet, 0)).max()) if wet else 0.0
        elif len(wet) > 1:
            error = float(max(np.abs(a - b).max() for a in wet for b in wet))
        conflict = len({n[1] for n in four if n[0] is not None and n[1] > 0}) > 1
        broken = 0 < len(wet) < 4 or (len(wet) == 4) != (mid[0] is not None) or probe or conflict
        want = conflict or error > s.tolerance or (not wet and (mid[0] is not None or probe)) if s.mode == "intertidal" else error > s.tolerance or broken
        room = min(x1 - x0, y1 - y0) / 2 >= least - 1e-6
        if want and room and level < depth:
            todo += [(x0, y0, mx, my, level + 1), (mx, y0, x1, my, level + 1), (x0, my, mx, y1, level + 1), (mx, my, x1, y1, level + 1)]
        else:
            bits = (qc.MIN_SPACING if want and not room else 0) | (qc.MAX_REFINEMENT if want and room else 0) | (qc.VALIDITY_BOUNDARY if broken else 0)
            leaves.append((x0, y0, x1, y1, level, error, bits))
    return leaves, nodes


@pytest.mark.parametrize("mode", control.MODES)
def test_grid(spark, mode):
    z = terrain()
    s = control.Settings(2000.0, 250.0, 2.0, mode, 400.0, 0.5)
    got = control.control_grid(frame_df(spark, z), FRAME, tide.Synthetic(OPTIONS, WET), DAY.times(spark), s)
    want, nodes = plain_grid(z, FRAME, s)
    place = lambda *v: tuple(round(x, 7) for x in v)
    mine = {place(c.x_min, c.y_min, c.x_max, c.y_max): (c.level, round(c.error, 4), c.cell_qc) for c in got["cells"].collect()}
    assert mine == {place(*c[:4]): (c[4], round(c[5], 4), c[6]) for c in want} and len({c[4] for c in want}) > 2
    n = got["nodes"].collect()
    assert len(n) == len(nodes) == got["node_count"] and len({x.node_id for x in n}) == len(n)
    assert {(round(x.x * 1e6), round(x.y * 1e6)): x.valid for x in n} == {k: v[0] is not None for k, v in nodes.items()}
    with pytest.raises(control.TooManyNodes):
        control.control_grid(frame_df(spark, z), FRAME, tide.Synthetic(OPTIONS, WET), DAY.times(spark), control.Settings(2000.0, 250.0, 2.0, mode, 400.0, 0.5, max_nodes=10))


def plain_products(z, f, s):
    """frequency, exposure (valid, exposed, longest, events) of each pixel that has corners, by hand."""
    leaves, nodes = plain_grid(z, f, s)
    factor = max(1, round(s.topology_m / f.pixel_m()))
    lab = labels(z, factor, s.fraction)
    out = {}
    for (r, c), h in np.ndenumerate(z):
        if math.isnan(h):
            continue
        x, y = f.x0 + (c + 0.5) * f.dx, f.y0 + (r + 0.5) * f.dy
        cell = next(k for k in leaves if k[0] <= x < k[2] and k[1] <= y < k[3])
        u, v = (x - cell[0]) / (cell[2] - cell[0]), (y - cell[1]) / (cell[3] - cell[1])
        at = [(cell[0], cell[1]), (cell[2], cell[1]), (cell[0], cell[3]), (cell[2], cell[3])]
        w = [(1 - u) * (1 - v), u * (1 - v), (1 - u) * v, u * v]
        four = [nodes[round(a * 1e6), round(b * 1e6)] for a, b in at]
        p, ok = lab.get((r // factor, c // factor), 0), [n[0] is not None for n in four]
        comps = {n[1] for n, k in zip(four, ok, strict=True) if k and n[1] > 0}
        if p > 0:
            use = [k and n[1] == p for n, k in zip(four, ok, strict=True)]
            if not any(use) and not comps:
                use = ok
        else:
            use = ok if len(comps) <= 1 else [False] * 4
        if not any(use):
            out[r, c] = None
            continue
        total = sum(a for a, k in zip(w, use, strict=True) if k)
        share = [a / total if k else 0.0 for a, k in zip(w, use, strict=True)]
        f_ = sum(a * 100.0 * (24 - np.searchsorted(n[0], h, "right")) / 24 for a, n in zip(share, four, strict=True) if a)
        series = sum(a * water(*q).astype(float) for a, q in zip(share, at, strict=True) if a)
        out[r, c] = f_, stations.scan(T.tolist(), series.tolist(), h), sum(use)
    return out


def test_products_from_cache(spark, tmp_path):
    z = terrain()
    s = control.Settings(2000.0, 500.0, 2.0, "standard", 400.0, 0.5)
    px, model, path = frame_df(spark, z), tide.Synthetic(OPTIONS, WET), f"file://{tmp_path}/cache"
    tags = products.build_cache(path, px, FRAME, model, DAY, s)
    assert bundle.validate(spark, path) == [] and int(tags["time_samples"]) == 24
    want = plain_products(z, FRAME, s)
    freq = {(x.row, x.col): x for x in products.inundation_from_cache(px, FRAME, path).collect()}
    direct = {(x.row, x.col): x for x in products.inundation(px, FRAME, model, DAY, s).collect()}
    dry = {(x.row, x.col): x for x in products.exposure_from_cache(px, FRAME, path).collect()}
    assert len(freq) == z.size == len(dry)
    some = 0
    for (r, c), h in np.ndenumerate(z):
        a, d, b = freq[r, c], direct[r, c], dry[r, c]
        assert (a.frequency, a.qc) == (d.frequency, d.qc)
        if math.isnan(h):
            assert a.frequency is None and a.qc == b.qc == qc.NODATA and b.exposed_h is None
        elif want[r, c] is None:
            assert a.frequency is None and a.qc & (qc.INSUFFICIENT | qc.CONNECTIVITY) == 68 and b.exposed_h is None and b.qc == qc.X_INSUFFICIENT
        else:
            f, e, n = want[r, c]
            some += 1
            assert a.frequency == pytest.approx(f, abs=1e-4)
            assert (b.valid_h, b.exposed_h, b.max_h) == pytest.approx((e["valid_h"], e["exposed_h"], e["max_h"]), abs=1e-3) and abs(b.events - e["events"]) <= 1
            assert b.valid_time == pytest.approx(100.0) and bool(b.qc & qc.X_DEGRADED) == (n < 4) and not b.qc & (qc.X_NO_TERMINAL | qc.X_PARTIAL)
            assert bool(b.qc & qc.X_SUBMERGED) == (b.exposed_h <= 1e-6) and bool(b.qc & qc.X_EXPOSED) == (abs(b.exposed_h - b.valid_h) <= 1e-4)
    assert some > 1500 and any(v is None for v in want.values())
    with pytest.raises(ValueError, match="width"):
        products.inundation_from_cache(px, Frame(122.0, 31.05, 0.001, -0.001, 65, 50), path)
    with pytest.raises(bundle.ExistingOutput):
        products.build_cache(path, px, FRAME, model, DAY, s)


def test_closed_windows_and_empty_rasters(spark, tmp_path):
    s = control.Settings(2000.0, 1000.0, 2.0, topology_m=400.0)
    px = frame_df(spark, terrain())
    closed = products.Window(DAY.start, DAY.end, "1h", "both")
    products.build_cache(f"file://{tmp_path}/c", px, FRAME, tide.Synthetic(), closed, s)
    with pytest.raises(ValueError, match="half-open"):
        products.exposure_from_cache(px, FRAME, f"file://{tmp_path}/c")
    none = products.inundation(px.withColumn("z", F.lit(None).cast("double")), FRAME, tide.Synthetic(), DAY, s)
    assert none.where("frequency is null and qc = 65535").count() == 3200


def test_offsets(spark):
    """An offset moves the water; a node without one isn't valid."""
    px = frame_df(spark, np.full((50, 64), 0.5))
    s = control.Settings(8000.0, 8000.0, 1.0, topology_m=400.0)
    at = lambda off: products.inundation(px, FRAME, tide.Synthetic(), DAY, s, lambda n: n.select("node_id", F.lit(off).cast("double").alias("offset"), F.lit(True).alias("approx")))
    high, gone = at(10.0).collect(), at(None).collect()
    assert all(x.frequency == pytest.approx(100) and x.qc & qc.DATUM_APPROX for x in high) and all(x.frequency is None and x.qc & 68 == 68 for x in gone)

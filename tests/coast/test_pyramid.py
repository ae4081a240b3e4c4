"""Test heights of the cells of all levels, against the windows of the cells one by one, and how often pixels are read."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.functions.tide import Synthetic
from shoreline.functions.timegrid import time_grid
from shoreline.plans.control import Settings, control_grid
from shoreline.plans.pyramid import deciles, line, pyramid
from shoreline.sources.rasters import Frame


def plain(z, f, step, depth):
    """Cell by cell, from bounds halved as the quadtree halves them."""
    west, south, east, north = f.bounds
    out = {}

    def visit(mr, mc, level, pr, pc, x0, y0, x1, y1):
        rows, cols = sorted(((y0 - f.y0) / f.dy, (y1 - f.y0) / f.dy)), sorted(((x0 - f.x0) / f.dx, (x1 - f.x0) / f.dx))
        r0, r1 = max(0, math.floor(rows[0])), min(f.height, math.ceil(rows[1]))
        c0, c1 = max(0, math.floor(cols[0])), min(f.width, math.ceil(cols[1]))
        v = z[r0:r1, c0:c1] if r1 > r0 and c1 > c0 else np.zeros(0)
        v = np.sort(v[~np.isnan(v)])
        if len(v):
            out[mr, mc, level, pr, pc] = list(np.percentile(v, [10, 50, 90])) if len(v) >= 10 else sorted(set(v))
        if level < depth:
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            for a, (ya, yb) in enumerate(((y0, my), (my, y1))):
                for b, (xa, xb) in enumerate(((x0, mx), (mx, x1))):
                    visit(mr, mc, level + 1, pr * 2 + a, pc * 2 + b, xa, ya, xb, yb)

    for i in range(max(1, math.ceil((north - south) / step[1] - 1e-9))):
        for j in range(max(1, math.ceil((east - west) / step[0] - 1e-9))):
            visit(i, j, 0, 0, 0, west + j * step[0], south + i * step[1], west + (j + 1) * step[0], south + (i + 1) * step[1])
    return out


FRAMES = [
    (Frame(100.0, 200.0, 1.0, -1.0, 37, 29), (16.0, 10.0), 2), (Frame(100.0, 200.0, 1.0, 1.0, 20, 25), (7.3, 11.1), 3), (Frame(0.0, 0.0, -0.7, 0.3, 23, 31), (5.0, 4.0), 1),
    (Frame(10.0, 10.0, 3.0, -3.0, 6, 5), (4.0, 4.0), 3), (Frame(0.0, 0.0, 1.0, -1.0, 16, 16), (16.0, 16.0), 4), (Frame(5.0, 5.0, 0.1, -0.1, 30, 20), (100.0, 100.0), 0),
]


@pytest.mark.parametrize(("frame", "step", "depth"), FRAMES)
def test_all_cells(spark, frame, step, depth):
    """Cells that pixels straddle, cells smaller than a pixel, and axes in both directions; blocks of all cells, and of the deepest only."""
    z = np.round(np.random.default_rng(depth).normal(size=(frame.height, frame.width)), 1)
    z[:4, :9] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(frame.height) for c in range(frame.width)]
    df, want = spark.createDataFrame(rows, "row int, col int, z double").repartition(3), plain(z, frame, step, depth)
    for block in (1 << 20, 20):
        got = {(x.mr, x.mc, x.level, x.pr, x.pc): x.heights for x in pyramid(df, frame, step, depth, block).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k], rtol=1e-12, atol=1e-12) for k in want)


def test_deciles():
    assert list(deciles(np.array([1.0, 1.0, 2.0]))) == [1.0, 2.0]
    v = np.sort(np.random.default_rng(1).normal(size=57))
    assert np.allclose(deciles(v), np.percentile(v, [10, 50, 90]))


def test_a_line_is_refused_that_is_too_long():
    with pytest.raises(ValueError):
        line(0.0, 1e6, 1.0, 0.0, 1.0, 10, 12)


def test_pixels_are_read_once_however_deep(spark):
    z = np.linspace(-2, 2, 48)[None, :] * np.ones((48, 1))
    frame = Frame(122.0, 31.0, 0.002, -0.002, 48, 48)
    rows = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(48) for c in range(48)], "row int, col int, z double").repartition(2)
    times = time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 6), "1h")
    read = []
    for least in (2000.0, 250.0):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        grid = control_grid(rows.mapInArrow(count, rows.schema), frame, Synthetic(), times, Settings(4000.0, least, 0.001))
        grid["cells"].agg(F.max("level")).collect()
        read.append(seen.value)
    assert read[0] == read[1] and read[0] % (48 * 48) == 0

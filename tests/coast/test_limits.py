"""Runs over rasters that grow with their table have no limit of nodes; a limit that settings give holds."""

import math
from datetime import datetime

import numpy as np
import pytest

from shoreline import queries_runs
from shoreline.functions import tide
from shoreline.plans import control, products
from shoreline.queries import WIDTH, pixels
from shoreline.sources import rasters
from shoreline.sources.rasters import Frame

D = "/root/testdata/sf0.001"


@pytest.fixture
def many(monkeypatch):
    """As if as many nodes as the default allows had been evaluated before."""
    begin = control.Nodes.__init__

    def counted(self, *a, **k):
        begin(self, *a, **k)
        self.count = control.MAX_NODES

    monkeypatch.setattr(control.Nodes, "__init__", counted)


def test_basins_beyond_the_most_nodes(spark, many):
    """All pixels outside the barrier, with the frequency of their basin where they have one."""
    z = {(p.row, p.col): p.z for p in pixels(spark, D).where("z is not null").collect() if not int(0.45 * WIDTH) <= p.col < int(0.55 * WIDTH)}
    got = queries_runs.profile_basins(spark, D).collect()
    assert len(got) == len(z) and {(p.row, p.col) for p in got} == set(z)
    wave = 0.5 * np.cos(2 * math.pi * np.arange(24) / 12)
    known = [p for p in got if p.frequency is not None]
    assert len(known) > 0.7 * len(got)
    for p in known:
        level = (wave + (1.5 if p.col < WIDTH / 2 else -1.5)).astype(np.float32)
        assert p.frequency == pytest.approx(100 * np.mean(level > z[p.row, p.col]), abs=1e-4)


def test_orders_beyond_the_most_nodes(spark, many):
    assert len(queries_runs.control_grid(spark, D).collect())


def test_more_nodes_than_the_default_allows(spark):
    """A macro cell for each of 160 x 160 pixels: 161 x 161 corners and the middles. A coarse cell is 18 x 18 pixels, of which one has a height."""
    f = Frame(122.0, 0.8, 0.01, -0.01, 160, 160)
    spacing = 0.01 / f.steps(1.0)[1]
    times = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 1, 2), "1h").times(spark)
    px = rasters.terrain(spark, "ramp", 160, 160).where("row % 18 = 9 and col % 18 = 9 or row = 159 or col = 159")
    grid = lambda **more: control.control_grid(px, f, tide.Synthetic(), times, control.Settings(spacing, spacing, topology_m=20_000.0, **more))
    got = grid(max_nodes=None)
    assert got["node_count"] == got["nodes"].count() >= 161 * 161 + 160 * 160 > control.MAX_NODES
    with pytest.raises(control.TooManyNodes):
        grid()

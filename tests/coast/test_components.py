"""Components meet however long the chain is; no bound on rounds can be set."""

import inspect

from shoreline.operators import topology


def test_long_chain(spark):
    cells = [(0, c) for c in range(400)] + [(r, 400 + r % 2) for r in range(0, 40)]
    got = topology.components(spark.createDataFrame(cells, "r long, c long")).collect()
    assert len(got) == 440 and {r.component for r in got} == {0}
    assert list(inspect.signature(topology.components).parameters) == ["cells"]

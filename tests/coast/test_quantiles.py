"""Exact quantiles against numpy, with groups cut at a few values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.operators import metrics
from shoreline.operators.quantiles import percentiles, select

PROBS = [0.0, 0.01, 0.05, 0.1, 0.25, 0.333, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999, 1.0]


def groups():
    g = np.random.default_rng(8)
    return {
        "normal": g.normal(size=6000), "ties": g.integers(0, 3, 5000) * 1.0, "one": np.full(4000, 7.25), "half": np.concatenate((np.zeros(3000), g.random(3000))),
        "wide": np.exp(g.normal(size=5000) * 150), "tail": np.concatenate((g.random(5000), [1e300, -1e300])), "few": g.random(40), "single": np.array([3.5]),
        None: g.random(3000) * 1e-300, "sorted": np.arange(7000) / 3.0,
    }


@pytest.mark.parametrize(("most", "leaf"), [(1000, 16), (50, 500), (1 << 20, 1 << 14)])
def test_groups(spark, most, leaf):
    data = groups()
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("few", None), ("few", math.nan), ("few", math.inf), ("nothing", None), ("nothing", math.nan)]
    got = percentiles(spark.createDataFrame(rows, "k string, x double").repartition(5), "x", PROBS, "k", most=most, leaf=leaf).collect()
    assert {x.k for x in got} == set(data)
    for x in got:
        v = data[x.k]
        assert x.n == len(v)
        order = np.sort(v)
        for p, q in zip(PROBS, x.q, strict=True):
            at = p * (len(v) - 1)
            lo, hi = order[math.floor(at)], order[math.ceil(at)]
            assert q == lo if lo == hi or at == math.floor(at) else math.isclose(q, (math.ceil(at) - at) * lo + (at - math.floor(at)) * hi, rel_tol=1e-12), (x.k, p)


def test_no_keys_and_several(spark):
    v = np.random.default_rng(2).normal(size=3000)
    df = spark.createDataFrame([(k % 2, None if k % 3 == 0 else k % 3, float(x)) for k, x in enumerate(v)], "a int, b int, x double")
    for most in (10, 10_000):
        assert np.allclose(percentiles(df, F.col("x"), [0.5, 0.95], most=most, leaf=20).first().q, np.percentile(v, [50, 95]))
        got = {(x.a, x.b): x.q for x in percentiles(df, "x", [0.5], "a", "b", most=most, leaf=20).collect()}
        for a in (0, 1):
            for b in (None, 1, 2):
                assert np.allclose(got[a, b], np.median([x for k, x in enumerate(v) if k % 2 == a and (k % 3 or None) == b]))
    assert percentiles(df.limit(0), "x", [0.5]).count() == 0
    with pytest.raises(ValueError):
        percentiles(df, "x", [1.5])


def test_selection(spark):
    v = np.random.default_rng(3).integers(0, 500, 20_000) * 0.5
    df = spark.createDataFrame([("k", float(x)) for x in v], "_k string, _x double").repartition(4)
    ranks = [0, 1, 777, 10_000, 19_998, 19_999]
    got = {x["rank"]: x.value for x in select(df, spark.createDataFrame([("k", ranks)], "_k string, ranks array<long>"), leaf=10).collect()}
    assert got == {r: np.sort(v)[r] for r in ranks}


def test_errors_leave_out_what_is_not_finite(spark):
    rows = [("a", 1.0, 3.0), ("a", 2.0, 2.5), ("a", math.nan, 1.0), ("a", 1.0, None), ("a", math.inf, 1.0), ("b", 5.0, 1.0), (None, 0.0, 1.0), ("c", None, 1.0)]
    for most in (1, 100):
        got = {x.k: x for x in metrics.errors(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", "k", most=most).collect()}
        assert set(got) == {"a", "b", None}
        a = got["a"]
        assert (a.n, a.bias, a.mae, a.worst) == (2, -1.25, 1.25, 2.0) and math.isclose(a.rmse, math.sqrt((4 + 0.25) / 2)) and math.isclose(a.p50, 1.25) and math.isclose(a.p90, 1.85)
    assert metrics.errors(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b").first().n == 4
    assert metrics.errors(spark.createDataFrame([], "a double, b double"), "a", "b").first().n == 0

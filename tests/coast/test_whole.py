"""Queries over whole tables keep every pixel, node and place: a raster of 140 rows and 700 places, past all fixed prefixes."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from shoreline import queries as catalogue

WHOLE = ["circular_span", "tide_synthetic_field", "tide_two_basin", "decision_equivalence", "idw_extrapolate", "nearest_support", "inundation_raster", "exposure_raster", "exposure_raster_packed", "support_topology", "connected_components", "mask_geometry"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, g = str(tmp_path_factory.mktemp("raster")), np.random.default_rng(5)
    k = np.arange(140 * 128)
    row, col = k // 128, k % 128
    price = 250_000 + 240_000 * np.sin(row / 5) * np.cos(col / 7) + g.integers(0, 3_000_000, len(k)) / 100
    pd.DataFrame({"o_orderkey": k, "o_custkey": k % 700, "o_totalprice": price.round(2)})[k % 37 != 5].to_parquet(f"{d}/orders.parquet")
    c = np.arange(700)
    pd.DataFrame({"c_custkey": c, "c_nationkey": c % 25, "c_acctbal": (c * 13.7 % 9000).round(2)}).to_parquet(f"{d}/customer.parquet")
    pd.DataFrame({"s_suppkey": np.arange(60)}).to_parquet(f"{d}/supplier.parquet")
    return d


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in ("orders", "customer", "supplier"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(3)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def flood(duck):
    """Components by hand."""
    left = set(duck.sql(f"with {catalogue.PIXELS} select distinct (row // 4)::bigint, (col // 4)::bigint from pixels where z > 2.2").fetchall())
    rows = []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            r, c = todo.pop()
            part.add((r, c))
            near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        rows += [(r, c, min(x * (1 << 32) + y for x, y in part)) for r, c in part]
    return pd.DataFrame(rows, columns=["r", "c", "component"])


@pytest.mark.parametrize("name", WHOLE)
def test_whole(spark, duck, folder, name):
    got = catalogue.QUERIES[name](spark, folder).toPandas()
    sql = catalogue.ORACLE.get(name)
    want = duck.sql(sql).df() if sql else flood(duck)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-3)
    assert len(want)


def test_every_pixel(spark, duck, folder):
    """Every pixel with a height is in the results, on rows that the prefixes left out too."""
    n = duck.sql(f"with {catalogue.PIXELS} select count(z) from pixels").fetchall()[0][0]
    assert catalogue.QUERIES["inundation_raster"](spark, folder).count() == n
    assert sum(r.valid_n for r in catalogue.QUERIES["support_topology"](spark, folder).collect()) == n
    assert catalogue.QUERIES["decision_equivalence"](spark, folder).first().n == 24 * n

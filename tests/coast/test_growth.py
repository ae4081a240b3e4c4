"""Rounding as SQL has it, and queries that make no row for each pixel and time or for each sample and quantile."""

from datetime import datetime

import duckdb
from pyspark.sql import functions as F
from test_neighbours import most_rows

from shoreline import queries as catalogue
from shoreline.functions import tide
from shoreline.plans import products, validation

D = "/root/testdata/sf0.001"


def test_halves_are_rounded_as_by_sql(spark):
    x = [(float(k) / 10000.0 - 2.0) - 2.609375 for k in range(18000, 19000)] + [-0.1533 - 2.609375, -1e-9]
    got = [v.r for v in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", catalogue.r("x", 5).alias("r")).orderBy("i").collect()]
    assert got == [duckdb.execute("select round(?::double, 5) + 0.0", [v]).fetchone()[0] for v in x]


def test_exposure_makes_no_row_for_each_time(spark):
    n = catalogue.pixels(spark, D).where("z is not null").count()
    m = catalogue.QUERIES["exposure_raster"](spark, D)
    assert len(m.collect()) > 0.9 * n
    assert most_rows(m._jdf.queryExecution().executedPlan()) < 8 * n


def test_study_makes_no_row_for_each_quantile(spark):
    """4 stations and 480 times: 1,920 samples a model, times 13 quantiles."""
    s = spark.range(4).select(F.col("id").alias("node_id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    table = s.select("node_id", F.explode(F.array(F.lit("M2"), F.lit("K1"))).alias("constituent"), (F.col("node_id") * 7 + 20.0).alias("amp_cm"), (F.col("node_id") * 50.0).alias("phase_deg"))
    window = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 11), "30min")
    e, _ = validation.sensitivity_study(s, lambda which: tide.Harmonic(table, which, origin=1704067200.0), window, ["M2"])
    assert {x.n for x in e.collect()} == {52}
    assert most_rows(e._jdf.queryExecution().executedPlan()) <= 2 * 1920

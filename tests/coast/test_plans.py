"""Plans, policies and streams."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shoreline.functions import tide
from shoreline.operators import exposure, quadtree
from shoreline.plans import batch, conversion, predict
from shoreline.streaming.exposure_stream import exposure_stream


def test_series(spark):
    table = spark.createDataFrame([(1, "M2", 100.0, 0.0), (1, "Sa", 10.0, 0.0)], "node_id long, constituent string, amp_cm double, phase_deg double")
    m = tide.Harmonic(table, origin=datetime(2024, 1, 1).timestamp())
    got = predict.series(spark, m, 1, 122.0, 31.0, datetime(2024, 1, 1), datetime(2024, 1, 2), "1h").orderBy("datetime_utc").collect()
    assert len(got) == 25 and got[0].tide_short_period_cm == pytest.approx(100) and got[0].tide_total_m == pytest.approx(1.1)
    assert predict.year(spark, m, 1, 122.0, 31.0, 2024).count() == 17568


def test_batch_points(spark):
    p = spark.createDataFrame([("122", "31", "2024-01-01 00:00:00", "a"), ("x", "31", "2024-01-01", "b"), ("122", "95", "2024-01-01", "c"), ("122", "31", "soon", "d")], "lo string, la string, at string, note string")
    got = {r.note: r for r in predict.batch(p, lambda t, x, y: tide.synthetic_level(t / 3600, x, y), "lo", "la", "at").collect()}
    assert got["a"].quality_flag == 1 and [got[k].qc_warning for k in "bcd"] == ["QC_COORDINATE_INVALID", "QC_COORDINATE_INVALID", "QC_TIME_INVALID"]


def test_conversion(spark):
    grid = spark.range(25).select((F.col("id") % 5).alias("i"), F.expr("id div 5").alias("j"), F.lit(0.5).alias("val"))
    dn = grid.withColumn("val", F.lit(0.1))
    sup = grid.select((F.col("i") * 10 + F.col("j")).alias("sid"), (F.lit(120.0) + F.col("i") * 0.1).alias("lon"), (F.lit(30.0) + F.col("j") * 0.1).alias("lat"), F.col("val").alias("v"))
    px = spark.createDataFrame([(1, 5.0, 120.15, 30.15), (2, 5.0, 120.6, 30.2), (3, None, 120.2, 30.2), (4, 5.0, 140.0, 0.0)], "id long, z double, lon double, lat double")
    px = px.withColumns({"mx": (F.col("lon") - 120) / 0.1, "my": (F.col("lat") - 30) / 0.1, "dx": F.lit(1.5), "dy": F.lit(1.5)})
    out = conversion.convert(px, grid, dn, sup, "id")
    got = {r.id: (r.z_msl and round(r.z_msl, 6), r.qc) for r in out.collect()}
    assert got == {1: (4.4, 0), 2: (4.4, 1), 3: (None, 2), 4: (None, 2)}
    assert tuple(conversion.counts(out).first()) == (4, 1, 1, 2)


def test_policies(spark):
    assert batch.policy_of(resume=True) == "RESUME" and batch.policy_of("force") == "OVERWRITE" and batch.mode_of("Build_Cache") == ("cache",)
    for bad in ({"name": "x"}, {"resume": True, "overwrite": True}):
        with pytest.raises(ValueError):
            batch.policy_of(**bad)
    yes, no = F.lit(True), F.lit(False)
    act = lambda *x: spark.range(1).select(batch.action(*x)).first()[0]
    assert act("RESUME", False, yes, yes, yes, yes) == "SKIPPED" and act("RESUME", False, yes, no, yes, yes) == "FAILED"
    assert act("RESUME", False, no, no, no, no) == "RUN" and act("RESUME", False, yes, yes, no, no) == "FROM_CACHE"
    assert act("ERROR_IF_EXISTS", False, no, no, yes, yes) == "FAILED" and act("ERROR_IF_EXISTS", True, yes, yes, no, no) == "FROM_CACHE"
    assert act("OVERWRITE", True, no, no, no, no) == "FAILED" and act("OVERWRITE", False, yes, no, yes, no) == "RUN"
    assert spark.range(1).select(batch.output_name(F.lit("a/b.tif"))).first()[0] == "a/b_MSL.tif"


def test_quadtree_depth():
    assert quadtree.depth_cap(4000, 500) == 3


def test_stream_gives_the_batch_numbers(spark, tmp_path):
    rows = [(k, float(i * 600), None if (i * k) % 11 == 5 else float((i * (k + 3)) % 5), 1.5) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t double, h double, z double")
    for n in range(3):
        df.where((F.col("t") >= n * 12000) & (F.col("t") < (n + 1) * 12000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = exposure_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("exposed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.sql("select k, max_by(struct(*), valid_h) r from exposed group by k").select("r.*").collect()
    want = {r.k: r for r in exposure.metrics(df, "k").collect()}
    for r in last:
        for c in ("valid_h", "exposed_h", "max_h", "events"):
            assert r[c] == pytest.approx(want[r.k][c]), (r.k, c)

"""Predictions, sources and streams beyond the catalogue."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shoreline.functions import tide, timegrid
from shoreline.operators import datum, exposure, metrics, sampling
from shoreline.plans import predict, validation
from shoreline.sources import tables
from shoreline.streaming import exposure_stream as streams
from shoreline.streaming import ordered


def test_series_with_heights(spark):
    table = spark.createDataFrame([(1, "M2", 100.0, 0.0)], "node_id long, constituent string, amp_cm double, phase_deg double")
    m = tide.Harmonic(table, origin=datetime(2024, 1, 1).timestamp())
    at = spark.createDataFrame([(0.5, 0.1, 10.0, datum.EIGEN)], "mdt_m double, delta_n_m double, n_egm2008_m double, geoid string")
    run = lambda **k: predict.series(spark, m, 1, 122.0, 31.0, datetime(2024, 1, 1), datetime(2024, 1, 1, 1), "1h", **k).orderBy("datetime_utc").first()
    r = run(target="wgs84", heights=at)
    assert (round(r.tide_msl_m, 6), round(r.h_mdt_ref_m, 6), r.h_goco06s_m, round(r.h_egm2008_m, 6), round(r.h_wgs84_m, 6)) == (1.0, 1.5, None, 1.6, 11.6)
    assert run().tide_msl_m == pytest.approx(1.0)
    with pytest.raises(ValueError, match="heights"):
        run(target="egm2008")


def test_models_by_time(spark):
    nodes = spark.createDataFrame([(1, 122.0, 31.0), (2, 120.2, 31.0)], "node_id long, lon double, lat double")
    m = predict.Counted(tide.TwoBasin())
    one = {r.node_id: r.level for r in predict.points_at_time(nodes, m, datetime(2024, 1, 1)).collect()}
    assert one[2] is None and one[1] == pytest.approx(0.5 * math.cos(2 * math.pi * (1704067200 / 3600 % 12) / 12) - 1.5) and m.calls == 1 and m.last.get == {"samples": 2, "finite": 1}
    halves = [timegrid.time_grid(spark, datetime(2024, 1, 1), datetime(2024, 1, 1, 6), "1h"), timegrid.time_grid(spark, datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 12), "1h")]
    assert predict.joined_in_time([predict.points_period(nodes, t, m) for t in halves]).count() == 26 and m.calls == 3
    with pytest.raises(ZeroDivisionError):
        with predict.scope(nodes) as held:
            assert held.is_cached
            1 / 0
    assert not nodes.is_cached
    stored = tide.Table(spark.createDataFrame([(1, datetime(2024, 1, 1), 0.5)], "node_id long, t timestamp, level double"))
    assert {(r.node_id, r.level) for r in stored.levels(nodes, spark.sql("select timestamp '2024-01-01 00:00:00' t")).collect()} == {(1, 0.5), (2, None)}


def test_geoid_of_points(spark):
    seas = datum.edges_of({"sea": [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]}, spark)
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 5.0), (3, 5.0, 95.0), (4, 2.0, 2.0), (5, 30.0, 30.0)], "id int, lon double, lat double").withColumns({"fx": F.col("lon") / 10, "fy": F.col("lat") / 10})
    got = {r.id: (r.geoid, r.quality) for r in datum.geoid_of_points(p, seas, "id").collect()}
    assert got == {1: (datum.EIGEN, datum.APPROX), 2: (datum.GOCO, datum.NORMAL), 3: (datum.INVALID, datum.BAD), 4: (datum.EIGEN, datum.APPROX), 5: (datum.GOCO, datum.NORMAL)}
    mask = spark.createDataFrame([(0, 0, 1), (2, 0, 2), (3, 3, 0)], "i int, j int, val int")
    got = {r.id: (r.geoid, r.quality) for r in datum.geoid_of_points(p, seas, "id", mask, "fx", "fy").collect()}
    assert got == {1: (datum.GOCO, datum.MASKED), 2: (datum.EIGEN, datum.MASKED), 3: (datum.INVALID, datum.BAD), 4: (datum.GOCO, datum.MASKED), 5: (datum.GOCO, datum.APPROX)}
    rows = predict.batch(p.withColumn("at", F.lit("2024-01-01")), lambda t, x, y: x * 0 + 1.0, "lon", "lat", "at", seas).collect()
    assert {r.id: (r.reference_geoid, r.qc_warning) for r in rows if r.id < 3} == {1: (datum.EIGEN, datum.APPROX), 2: (datum.GOCO, "NORMAL")}
    assert sampling.idw(p.select("id", "lon", "lat"), p.select(F.col("id").alias("sid"), "lon", "lat", F.lit(1.0).alias("v")), "id", "sid", "v", cutoff_m=None).count() == 5


def test_tables_of_points(spark, tmp_path):
    path = str(tmp_path / "p.csv")
    tables.export_table(spark.createDataFrame([(1, "\u00e9"), (2, "b")], "id int, name string"), path)
    assert (tmp_path / "p.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    assert tables.read_points(spark, f"file://{path}", typed=True).dtypes[0][1] == "int" and len(tables.head(spark, f"file://{path}", 1)) == 1
    with pytest.raises(ValueError):
        tables.export_table(spark.range(10), path, 5)
    tables.write_csv(spark.range(3), f"file://{tmp_path}/w")
    with pytest.raises(Exception, match="(?i)exist"):
        tables.write_csv(spark.range(3), f"file://{tmp_path}/w")


def test_evidence(spark, tmp_path):
    e = validation.evidence({"a": spark.range(3), "b": metrics.errors(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), "a", "b")}, f"file://{tmp_path}/e").collect()
    assert len(e) == 2 and all(len(r.sha256) == 64 and r.bytes > 0 for r in e)
    assert [(n, r) for n, s, r in validation.timed({"x": lambda: spark.range(4)}) if s >= 0] == [("x", 4)]


def test_streams(spark, tmp_path):
    rows = [(k, float(i * 600), float((i + k) % 5), 1.5) for k in range(3) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, t double, h double, z double")
    end = df.groupBy("k").agg(F.lit(0.0).alias("h"))
    closed = {r.k: r for r in exposure.metrics(streams.with_end(df, 20 * 600.0, end), "k").collect()}
    plain = {r.k: r for r in exposure.metrics(df, "k").collect()}
    assert all(closed[k].valid_h == pytest.approx(plain[k].valid_h + 1 / 6) and closed[k].exposed_h >= plain[k].exposed_h for k in plain)
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    schema = "path string, status string, seq long"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    put([("a", "FAILED", 1), ("b", "DONE", 2)])
    told = []
    listener = streams.Progress(lambda batch, n: told.append((batch, n)))
    spark.streams.addListener(listener)
    run = lambda: streams.run_available(spark.readStream.schema(schema).parquet(src), ck, ordered.log_sink(f"file://{out}"))
    last = lambda: ordered.newest(spark.read.parquet(f"file://{out}"), "path", "seq")
    run()
    put([("a", "DONE", 3)])
    run()
    run()  # nothing new
    spark.streams.removeListener(listener)
    assert {r.path: r.status for r in last().collect()} == {"a": "DONE", "b": "DONE"}
    sink = ordered.log_sink(f"file://{out}")
    sink(spark.createDataFrame([("a", "DONE", 3)], schema), 1)  # a batch that is repeated
    assert last().count() == 2
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 60, 10)], "k long, ts timestamp, value double")
    w = sorted(tuple(r)[1:] for r in streams.calendar(ev, "30 minutes").collect())
    assert [(x[2], x[3], x[4]) for x in w] == [(3, 0.0, 20.0), (3, 30.0, 50.0)]
    assert streams.calendar(ev, "30 minutes", "10 minutes").count() == 8
    assert streams.dead_letters(ev, 1704070200.0, 1800.0).count() == 2
    late = spark.createDataFrame([(1, datetime(2024, 1, 1, h), 0.0) for h in (3, 6)], "k long, ts timestamp, value double")
    for k, part in enumerate((ev.union(ev), late.limit(1), late.where("hour(ts) = 6"))):  # repeated samples count once
        part.coalesce(1).write.parquet(f"{tmp_path}/ts/{k}")
    source = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/ts")
    q = streams.resampled(source, "30 minutes").writeStream.outputMode("append").format("memory").queryName("means").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {str(r.start)[11:16]: (r.mean, r.n) for r in spark.table("means").collect()}
    assert got["00:00"] == (10.0, 3) and got["00:30"] == (40.0, 3)


def test_master_verification(spark, tmp_path):
    from shoreline.operators import gridcells
    from shoreline.plans import control, products
    from shoreline.sources import rasters

    f = rasters.Frame(122.0, 31.03, 0.001, -0.001, 40, 30)
    g = spark.range(400).select((F.col("id") % 20).alias("i"), F.expr("id div 20").alias("j"), F.when(F.col("id") % 20 > 8, F.col("id") % 7 / 10.0 + 0.1).alias("val"))
    x, y = gridcells.Axis(121.99, 0.0035, 20), gridcells.Axis(30.99, 0.0035, 20)
    s = control.Settings(1000.0, 1000.0, 0.5, topology_m=300.0)
    day = products.Window(datetime(2024, 1, 1), datetime(2024, 1, 2), "1h")
    got = validation.master(f"file://{tmp_path}/m", rasters.terrain(spark, "beach", 40, 30), f, tide.Synthetic(valid=lambda lon, lat: lon > 122.006), day, s, g, x, y, lambda lon, lat: lon * 0 + 0.3, [0.1, 0.5, 0.9])
    c = {r["class"][0]: r.n for r in got["classes"].where("class is not null and level is not null").groupBy("class").agg(F.sum("n").alias("n")).collect()}
    assert set(c) == {"A", "B", "D"} and sum(r.n for r in got["geometry"].collect()) == c["B"]
    assert {r.method for r in got["holdout"].collect()} == {"nearest", "idw4", "idw8"} and got["sensitivity"].first().n == 3 * (c["B"] + c["D"])
    assert len(got["causes"].collect()) == 5 and got["register"].count() == 6

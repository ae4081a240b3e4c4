"""A stream of late and shuffled samples against the batch operator."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.operators import exposure
from shoreline.streaming.ordered import advance, figures, fresh, log_sink, newest, ordered_exposure, split_sink

FIGURES = ("valid_h", "exposed_h", "max_h", "events")


def test_arrays_take_samples_as_the_loop_does():
    r = random.Random(3)
    for case in range(400):
        n, z = r.randrange(1, 40), 1.0
        t = np.cumsum([r.choice([60.0, 600.0, 900.5]) for _ in range(n)])
        h = np.array([r.choice([0.0, 0.5, 1.0, 1.5, 2.0, float("nan")]) for _ in range(n)])
        want, got, k = exposure.scan(t, [None if np.isnan(x) else x for x in h], z), fresh(), 0
        while k < n:  # in pieces
            m = r.randrange(1, 8)
            advance(got, t[k : k + m], h[k : k + m], np.full(len(t[k : k + m]), z))
            k += m
        for c in FIGURES:
            assert figures(got)[c] == pytest.approx(want[c]), (case, c)


SCHEMA = "k long, t double, h double, z double"


def samples():
    return [(k, 600.0 * i, None if (i * k) % 11 == 5 else float((i * (k + 3)) % 5), 1.5) for k in range(5) for i in range(60)]


def run(spark, tmp_path, batches, delay, idle, wait=0.0):
    """Runs the batches one after the other, each as one file, with a pause after each."""
    out, seen = {}, {}
    (tmp_path / "in").mkdir()
    stream, sink = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), split_sink(f"{tmp_path}/figures", f"{tmp_path}/late")

    q = ordered_exposure(stream, delay, idle).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="200 milliseconds").start()
    try:
        for rows in batches:
            before = sum(seen.values())
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            until = time.time() + 60
            while sum(seen.values()) < before + len(rows) and time.time() < until and q.isActive:
                time.sleep(0.3)
                seen |= {p.batchId: p.numInputRows for p in q.recentProgress}
            time.sleep(wait)
    finally:
        q.stop()
    out["figures"] = spark.read.schema("k long, kind string, valid_h double, exposed_h double, max_h double, events long, late long, batch int").parquet(f"{tmp_path}/figures")
    out["late"] = spark.read.schema("k long, t double, h double, batch int").parquet(f"{tmp_path}/late")
    return out


def test_shuffled_within_the_delay_and_late(spark, tmp_path):
    rows, r = samples(), random.Random(1)
    rows.sort(key=lambda x: x[1] + r.uniform(0, 3000))  # at most 3000 s out of order
    third = len(rows) // 3
    parts = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    parts[2] = parts[2] + [(1, 600.0, 99.0, 1.5), (2, 1200.0, None, 1.5)] + [(k, 1e6, None, 1.5) for k in range(5)]  # two long past, and what lets all others go
    got = run(spark, tmp_path, parts, 3600.0, 3600.0)
    want = {x.k: x for x in exposure.metrics(spark.createDataFrame(samples(), SCHEMA), "k").collect()}
    last = newest(got["figures"].where("kind = 'state'"), "k").collect()
    assert len(last) == 5
    for x in last:
        for c in FIGURES:
            assert x[c] == pytest.approx(want[x.k][c]), (x.k, c)
    assert sorted((x.k, x.t, x.h) for x in got["late"].collect()) == [(1, 600.0, 99.0), (2, 1200.0, None)]
    assert {x.k: x.late for x in last} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0}


def test_idle_keys_leave(spark, tmp_path):
    one = [x for x in samples() if x[0] in (1, 2)]
    got = run(spark, tmp_path, [one, [(9, 0.0, 1.0, 1.5)]], 3600.0, 3.0, wait=5.0)
    want = {x.k: x for x in exposure.metrics(spark.createDataFrame(one, SCHEMA), "k").collect()}
    final = {x.k: x for x in got["figures"].where("kind = 'final'").collect()}
    assert set(final) == {1, 2, 9}
    for k in (1, 2):
        for c in FIGURES:
            assert final[k][c] == pytest.approx(want[k][c]), (k, c)
    state = spark.read.format("statestore").option("stateVarName", "machine").load(f"{tmp_path}/ck")
    assert state.select("key").collect() == []


def test_logs(spark, tmp_path):
    write = log_sink(f"file://{tmp_path}/log")
    put = lambda rows, n: write(spark.createDataFrame(rows, "path string, status string, seq long"), n)
    put([("a", "FAILED", 1), ("b", "DONE", 2)], 0)
    put([("a", "RUNNING", 3)], 1)
    put([("a", "DONE", 3)], 1)  # the batch again
    log = spark.read.parquet(f"file://{tmp_path}/log")
    assert {x.path: x.status for x in newest(log, "path", "seq").collect()} == {"a": "DONE", "b": "DONE"} and log.count() == 3
    assert newest(log.where(F.lit(False)), "path").count() == 0

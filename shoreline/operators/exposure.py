"""Exposure of a height above the water: intervals between samples, their crossing times, and events.

Between two samples the water line is straight. An interval is A (both at or below z: exposed), B (both above: submerged),
C (water falls to z), D (water rises over z) or N (a level is missing). An event is a run of exposed time; N, B and C begin a new
run, D ends one even where its exposed time is zero. Events count if they end in D or last; none count where
the whole exposure is 1e-6 hours or less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.functions import qc
from shoreline.operators.frequency import finite

LEAST_H, SAME_H, WHOLE = 1e-6, 1e-4, 0.9999


def with_terminal(series: DataFrame, terminal: DataFrame) -> DataFrame:
    """Adds the closing sample (key, t, h, z), which is in no sample grid, to each series."""
    return series.withColumn("is_terminal", F.lit(False)).unionByName(terminal.withColumn("is_terminal", F.lit(True)))


def intervals(series: DataFrame, key: str, t: str = "t", h: str = "h", z: str = "z") -> DataFrame:
    """key, z, t0, dt, state, exposed (seconds) of every pair of neighbouring samples; pairs that don't advance are dropped."""
    w = Window.partitionBy(key).orderBy(t)
    level = finite(F.col(h).cast("double"))
    p = series.select(key, F.col(z).alias("z"), F.col(t).alias("t0"), level.alias("h0"), F.lead(t).over(w).alias("t1"), F.lead(level).over(w).alias("h1")).where(F.col("t1") > F.col("t0"))
    h0, h1, zz = F.col("h0"), F.col("h1"), F.col("z")
    state = F.when(h0.isNull() | h1.isNull() | zz.isNull(), "N").when((h0 <= zz) & (h1 <= zz), "A").when((h0 > zz) & (h1 > zz), "B").when(h0 > zz, "C").otherwise("D")
    p = p.withColumns({"dt": F.col("t1") - F.col("t0"), "state": state})
    clip = lambda r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    down = clip((h0 - zz) / F.nullif(h0 - h1, F.lit(0.0)))
    up = clip((zz - h0) / F.nullif(h1 - h0, F.lit(0.0)))
    dt = F.col("dt")
    ex = F.when(F.col("state") == "A", dt).when(F.col("state") == "C", (1.0 - down) * dt).when(F.col("state") == "D", up * dt).otherwise(0.0)
    return p.select(key, "z", "t0", "dt", "state", ex.alias("exposed"))


def islands(iv: DataFrame, key: str) -> DataFrame:
    """key, island, seconds, has_d, valid: the runs of exposed time."""
    w = Window.partitionBy(key).orderBy("t0").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.sum(F.when(F.col("state").isin("N", "B", "C"), 1).otherwise(0)).over(w)
    return iv.withColumn("island", cut).groupBy(key, "island").agg(F.sum("exposed").alias("seconds"), F.max((F.col("state") == "D").cast("int")).alias("has_d"), F.sum(F.when(F.col("state") != "N", F.col("dt")).otherwise(0.0)).alias("valid"))


def metrics(series: DataFrame, key: str, window_s: Column | None = None, t: str = "t", h: str = "h", z: str = "z") -> DataFrame:
    """One row for every key of the series: valid_h, exposed_h, max_h, events, fraction, mean_h, valid_time (percent of the
    window, which is window_s of the key or the time that its samples span)."""
    run = islands(intervals(series, key, t, h, z), key)
    total = run.groupBy(key).agg(F.sum("valid").alias("v"), F.sum("seconds").alias("x"), F.max("seconds").alias("m"), F.count_if((F.col("has_d") == 1) | (F.col("seconds") > 0)).alias("e"))
    keys = series.groupBy(key).agg((F.max(window_s) if window_s is not None else F.max(t) - F.min(t)).alias("_w"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = keys.join(total, key, "left").select(key, "_w", (zero("v") / 3600.0).alias("valid_h"), (zero("x") / 3600.0).alias("exposed_h"), (zero("m") / 3600.0).alias("max_h"), F.coalesce("e", F.lit(0)).alias("e"))
    out = out.withColumn("events", F.when(F.col("exposed_h") <= LEAST_H, F.lit(0)).otherwise(F.col("e")).cast("long"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return out.select(key, "valid_h", "exposed_h", "max_h", "events", (100.0 * share("exposed_h", F.col("valid_h"))).alias("fraction"), share("exposed_h", F.col("events").cast("double")).alias("mean_h"), (100.0 * share("valid_h", F.col("_w") / 3600.0)).alias("valid_time"))


def quality(m: DataFrame) -> Column:
    """Exposure bits of a row of metrics()."""
    return (
        F.when(F.col("exposed_h") <= LEAST_H, qc.X_SUBMERGED).otherwise(0)
        .bitwiseOR(F.when(F.abs(F.col("exposed_h") - F.col("valid_h")) <= SAME_H, qc.X_EXPOSED).otherwise(0))
        .bitwiseOR(F.when(F.col("valid_time") < 100.0 * WHOLE, qc.X_PARTIAL).otherwise(0))
    )


def scan(t, h, z: float) -> dict:
    """The same for one series in one process, sample by sample: the form a stream keeps (see streaming/)."""
    state = {"h": None, "t": None, "now": 0.0, "open": False, "valid": 0.0, "exposed": 0.0, "max": 0.0, "events": 0}
    for a, b in zip(t, h, strict=True):
        step(state, a, b, z)
    return close(state)


def step(s: dict, t: float, h, z: float) -> None:
    """Takes one sample into the state."""
    if s["t"] is not None and t > s["t"]:
        dt, h0 = t - s["t"], s["h"]
        if h0 is None or h is None:
            _end(s, False)
        else:
            s["valid"] += dt
            if h0 <= z and h <= z:
                s["now"] += dt
            elif h0 > z and h > z:
                _end(s, False)
            elif h0 > z:
                _end(s, False)
                s["now"] += (1 - (h0 - z) / (h0 - h)) * dt
            else:
                s["now"] += (z - h0) / (h - h0) * dt
                _end(s, True)
    if s["t"] is None or t > s["t"]:
        s["t"], s["h"] = t, h


def _end(s: dict, crossed: bool) -> None:
    if crossed or s["now"] > 0:
        s["events"] += 1
        s["max"] = max(s["max"], s["now"])
        s["exposed"] += s["now"]
    s["now"] = 0.0


def close(s: dict) -> dict:
    s = dict(s)
    _end(s, False)
    if s["exposed"] / 3600 <= LEAST_H:
        s["events"] = 0
    return {"valid_h": s["valid"] / 3600, "exposed_h": s["exposed"] / 3600, "max_h": s["max"] / 3600, "events": s["events"]}

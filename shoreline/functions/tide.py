"""Tide models: anything with levels(nodes, times) -> (node_id, t, level, flag), and three of them.

nodes: node_id, lon, lat. times: t (timestamp). level in metres, null where the model has none; flag 1 or 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.functions import astro
from shoreline.functions.timegrid import seconds

#: All constituents, and the eight leading ones.
CONSTITUENTS = (
    "2N2", "Eps2", "J1", "K1", "K2", "L2", "Lambda2", "M2", "M3", "M4", "M6", "M8", "MKS2", "MN4", "MS4", "MSf", "Mf", "Mm", "Msqm", "Mtm", "Mu2", "N2", "N4", "Nu2",
    "O1", "P1", "Q1", "R2", "S1", "S2", "S4", "Sa", "Ssa", "T2",
)
MAJOR = ("M2", "S2", "K1", "O1", "N2", "K2", "P1", "Q1")
#: Constituents of half a month and more.
LONG_PERIOD = ("MSf", "Mf", "Mm", "Msqm", "Mtm", "Sa", "Ssa")
#: Degrees an hour and whether the period is long.
SPEEDS = {c: (round(astro.speed(c), 7), c in LONG_PERIOD) for c in CONSTITUENTS}
#: Samples of one time axis, which goes to every executor (8 bytes each), and samples evaluated at once.
MAX_TIMES, TIME_CHUNK = 1 << 21, 4096


def constituents(which="all") -> list[str]:
    """'all' (or None), 'major8' or a list of names, checked; names are exact but for blanks around them."""
    if which is None or which == "all":
        return list(CONSTITUENTS)
    if which == "major8":
        return list(MAJOR)
    if not isinstance(which, (list, tuple, set)):
        raise ValueError(f"constituents must be 'all', 'major8' or a list of names, not {which!r}")
    names = [str(c).strip() for c in which]
    if unknown := sorted(set(names) - set(CONSTITUENTS)):
        raise ValueError(f"unknown constituents: {', '.join(unknown)}")
    return names


class TideModel(Protocol):
    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame: ...


def synthetic_level(t_hours: Column, lon: Column, lat: Column, mean=0.0, amplitude=2.0, period=12.42, ax=0.05, by=0.03, g=0.01, lon0=122.0, lat0=31.0) -> Column:
    dx, dy = lon - lon0, lat - lat0
    return mean + amplitude * F.cos(2 * math.pi * t_hours / period) + ax * dx + by * dy + g * (dx * dx + dy * dy)


def two_basin_level(t_hours: Column, lon: Column, barrier=(120.155, 120.245), mean=1.5, amplitude=0.5, period=12.0) -> Column:
    """High water west of a barrier, low water east of it, nothing within it."""
    wave = amplitude * F.cos(2 * math.pi * t_hours / period)
    return F.when(lon < barrier[0], mean + wave).when(lon > barrier[1], wave - mean)


def _pairs(nodes: DataFrame, times: DataFrame) -> DataFrame:
    return nodes.crossJoin(F.broadcast(times))  # every node at every time is the result itself


@dataclass
class Synthetic:
    """The smooth synthetic tide; `valid` is a condition on (lon, lat)."""

    options: dict | None = None
    valid: object = None

    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        level = synthetic_level(seconds(F.col("t")) / 3600.0, F.col("lon"), F.col("lat"), **(self.options or {}))
        ok = self.valid(F.col("lon"), F.col("lat")) if self.valid else F.lit(True)
        return _pairs(nodes, times).select("node_id", "t", F.when(ok, level).cast("float").alias("level"), F.when(ok, 1).otherwise(0).alias("flag"))


class TwoBasin:
    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        level = two_basin_level(seconds(F.col("t")) / 3600.0, F.col("lon")).cast("float")
        return _pairs(nodes, times).select("node_id", "t", level.alias("level"), level.isNotNull().cast("int").alias("flag"))


@dataclass
class Harmonic:
    """Sum of f A cos(w t + V + u - G) over a table (node_id, constituent, amp_cm, phase_deg).

    With `astronomical`, arguments V and nodal corrections f and u are those of each time; without, w t counts from `origin` (seconds), f is 1
    and the table carries all else. What depends on time alone is computed once for all nodes, so that a batch of nodes is a matrix product."""

    table: DataFrame
    which: object = "all"
    origin: float = 0.0
    astronomical: bool = False

    def waves(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """f cos(w t + V + u) and f sin(w t + V + u), constituents x times."""
        names = constituents(self.which)
        if self.astronomical:
            f, u = astro.nodal(names, t)
            angle = np.radians(astro.equilibrium(names, t) + u)
            return f * np.cos(angle), f * np.sin(angle)
        angle = np.radians(np.outer([SPEEDS[c][0] for c in names], (t - self.origin) / 3600.0))
        return np.cos(angle), np.sin(angle)

    def parts(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        """node_id, t, short_cm, long_cm; null at nodes that the table lacks."""
        names = constituents(self.which)
        spark = self.table.sparkSession
        axis = times.select(F.unix_micros(F.col("t").cast("timestamp")).alias("u")).limit(MAX_TIMES + 1).toPandas()["u"].to_numpy(np.int64)
        if len(axis) > MAX_TIMES:
            raise ValueError(f"a time axis may have {MAX_TIMES} samples; cut the window")
        order = F.create_map(*(F.lit(x) for k, c in enumerate(names) for x in (c, k)))
        used = self.table.withColumn("k", F.try_element_at(order, F.col("constituent"))).where("k is not null").groupBy("node_id").agg(F.collect_list(F.struct("k", "amp_cm", "phase_deg")).alias("w"))
        chunks = spark.range(math.ceil(len(axis) / TIME_CHUNK)).select(F.col("id").cast("int").alias("chunk"))
        shared, is_long = spark.sparkContext.broadcast(axis), np.array([SPEEDS[c][1] for c in names])
        kind = nodes.schema["node_id"].dataType.simpleString()
        me = Harmonic(None, self.which, self.origin, self.astronomical)

        def run(batches):
            waves = {}
            for b in batches:
                ids, chunk, w = b.column(0), b.column(1).to_numpy(), b.column(2)
                known, flat = w.is_valid().to_numpy(zero_copy_only=False), w.flatten()
                row = np.repeat(np.arange(len(ids)), np.where(known, w.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64))
                c, s = np.zeros((2, len(ids), len(names)))
                k, amp, phase = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("k", "amp_cm", "phase_deg"))
                np.add.at(c, (row, k), amp * np.cos(np.radians(phase)))
                np.add.at(s, (row, k), amp * np.sin(np.radians(phase)))
                for x in np.unique(chunk):
                    here = np.flatnonzero(chunk == x)
                    t = shared.value[x * TIME_CHUNK : (x + 1) * TIME_CHUNK]
                    if x not in waves:
                        waves = {x: me.waves(t / 1e6)}
                    e, f = waves[x]
                    step = max(1, (1 << 20) // len(t))
                    for i in range(0, len(here), step):
                        rows = here[i : i + step]
                        gone = np.repeat(~known[rows], len(t))
                        out = [pa.array((c[rows][:, m] @ e[m] + s[rows][:, m] @ f[m]).ravel(), mask=gone) for m in (~is_long, is_long)]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(rows, len(t)))), pa.array(np.tile(t, len(rows)), pa.timestamp("us", "UTC")), *out], names=["node_id", "t", "short_cm", "long_cm"])

        each = nodes.select("node_id").join(used, "node_id", "left").crossJoin(F.broadcast(chunks)).select("node_id", "chunk", "w")
        return each.mapInArrow(run, f"node_id {kind}, t timestamp, short_cm double, long_cm double")

    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        level = ((F.col("short_cm") + F.col("long_cm")) / 100.0).cast("float")
        return self.parts(nodes, times).select("node_id", "t", level.alias("level"), level.isNotNull().cast("int").alias("flag"))


@dataclass
class Table:
    """Levels that exist already: node_id, t, level."""

    table: DataFrame

    def levels(self, nodes: DataFrame, times: DataFrame) -> DataFrame:
        found = _pairs(nodes.select("node_id"), times).join(self.table.select("node_id", "t", "level"), ["node_id", "t"], "left")
        return found.select("node_id", "t", F.col("level").cast("float").alias("level"), F.col("level").isNotNull().cast("int").alias("flag"))

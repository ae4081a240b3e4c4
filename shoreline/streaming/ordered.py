"""Exposure over a stream whose samples come late and out of order, with state that ends.

A key keeps the samples that are newer than its newest time less `delay_s`; older ones are taken into eight numbers, in order, by array operations over
all that a batch releases. A sample that comes after its time was passed is given out as a row of its own, and so is a second one of the same time that
does. A key without samples for `idle_s` gives its final figures, with all that it still kept, and leaves the state, by a timer; the time to live of
its state is the second line, for keys whose timer was lost. So input that is shuffled within the delay gives the numbers of the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shoreline.operators.exposure import LEAST_H

#: What a key keeps: last level and time taken in, open and summed seconds, the longest event, events, late samples, newest time seen, and when it has been
#: idle for too long (milliseconds of the clock).
MACHINE = "h double, t double, now double, valid double, exposed double, longest double, events long, late long, newest double, until long"
PENDING = "t double, h double, z double"
OUTPUT = "k long, kind string, t double, h double, valid_h double, exposed_h double, max_h double, events long, late long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def fresh() -> dict:
    return {"h": None, "t": None, "now": 0.0, "valid": 0.0, "exposed": 0.0, "longest": 0.0, "events": 0, "late": 0, "newest": -np.inf, "until": 0}


def advance(s: dict, t: np.ndarray, h: np.ndarray, z: np.ndarray) -> None:
    """Takes samples into a state: t rising and beyond s["t"], h NaN where there is no level."""
    if not len(t):
        return
    if s["t"] is not None:
        t, h, z = np.append(s["t"], t), np.append(np.nan if s["h"] is None else s["h"], h), np.append(z[0], z)
    h = np.where(np.isfinite(h), h, np.nan)
    if len(t) > 1:
        dt, a, b, z = np.diff(t), h[:-1], h[1:], z[1:]
        none = np.isnan(a) | np.isnan(b) | np.isnan(z)
        with np.errstate(divide="ignore", invalid="ignore"):
            below, above = (a <= z) & (b <= z), (a > z) & (b > z)
            falls, rises = ~none & (a > z) & (b <= z), ~none & (a <= z) & (b > z)
            part = np.select([none | above, below, falls, rises], [0.0, dt, (1 - (a - z) / (a - b)) * dt, (z - a) / (b - a) * dt], 0.0)
        begins = none | above | falls
        begins[1:] |= rises[:-1]  # a rise ends its run
        run = np.cumsum(begins)
        seconds, crossed = np.bincount(run, part), np.bincount(run, rises) > 0
        seconds[0] += s["now"]
        ended = np.ones(len(seconds), bool)
        ended[-1] = rises[-1]
        events = ended & (crossed | (seconds > 0))
        s["valid"] += float(dt[~none].sum())
        s["events"] += int(events.sum())
        s["exposed"] += float(seconds[events].sum())
        s["longest"] = max(s["longest"], float(seconds[events].max(initial=0.0)))
        s["now"] = 0.0 if ended[-1] else float(seconds[-1])
    s["t"], s["h"] = float(t[-1]), None if np.isnan(h[-1]) else float(h[-1])


def figures(s: dict) -> dict:
    """valid_h, exposed_h, max_h, events as if the series ended here."""
    more = s["now"] > 0
    exposed, events = s["exposed"] + s["now"], s["events"] + more
    return {"valid_h": s["valid"] / 3600, "exposed_h": exposed / 3600, "max_h": max(s["longest"], s["now"]) / 3600, "events": 0 if exposed / 3600 <= LEAST_H else int(events)}


def arranged(rows: pd.DataFrame, last: float | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Samples in order, one a time, and those that are too late: at or before `last`, or repeated."""
    rows = rows.sort_values("t", kind="stable")
    late = rows["t"].duplicated() | (rows["t"] <= (-np.inf if last is None else last))
    return rows[~late], rows[late]


class Ordered(StatefulProcessor):
    def __init__(self, delay_s: float, idle_s: float):
        self.delay, self.idle = delay_s, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        live = int((self.idle * 4 + 60) * 1000)
        self.machine = handle.getValueState("machine", MACHINE, ttlDurationMs=live)
        self.pending = handle.getListState("pending", PENDING, ttlDurationMs=live)

    def _loaded(self) -> tuple[dict, pd.DataFrame]:
        s = fresh()
        if self.machine.exists():
            s = dict(zip(s, self.machine.get(), strict=True))
        kept = [tuple(x) for x in self.pending.get()] if self.pending.exists() else []
        return s, pd.DataFrame(kept, columns=["t", "h", "z"], dtype=float)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        s, kept = self._loaded()
        new = pd.concat([r[["t", "h", "z"]].astype(float) for r in rows])
        good, late = arranged(pd.concat([kept, new]) if len(kept) else new, s["t"])
        s["late"] += len(late)
        s["newest"] = max(s["newest"], float(good["t"].max()) if len(good) else s["newest"])
        ready = good["t"] <= s["newest"] - self.delay
        advance(s, *(good.loc[ready, c].to_numpy() for c in ("t", "h", "z")))
        s["until"] = int(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)
        self.machine.update(tuple(s.values()))
        rest = good[~ready]
        if len(rest):
            self.pending.put([(float(t), None if np.isnan(h) else float(h), None if np.isnan(z) else float(z)) for t, h, z in rest[["t", "h", "z"]].itertuples(index=False)])
        else:
            self.pending.clear()
        self.handle.registerTimer(s["until"])
        if len(late):
            yield self._rows(key, "late", late["t"], late["h"], {}, s)
        yield self._rows(key, "state", [s["t"]], [s["h"]], figures(s), s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, kept = self._loaded()
        if s["until"] > expiredTimerInfo.getExpiryTimeInMs():
            return  # samples came since; a later timer is set
        good, _ = arranged(kept, s["t"])
        advance(s, *(good[c].to_numpy() for c in ("t", "h", "z")))
        self.machine.clear()
        self.pending.clear()
        yield self._rows(key, "final", [s["t"]], [s["h"]], figures(s), s)

    def _rows(self, key, kind: str, t, h, f: dict, s: dict) -> pd.DataFrame:
        n = len(t)
        every = {c: [f.get(c)] * n for c in ("valid_h", "exposed_h", "max_h", "events")}
        return pd.DataFrame({"k": [key[0]] * n, "kind": kind, "t": list(t), "h": list(h), **every, "late": s["late"]}).astype({"events": "Int64", "t": float, "h": float, "valid_h": float, "exposed_h": float, "max_h": float})

    def close(self) -> None:
        pass


def ordered_exposure(samples: DataFrame, delay_s: float, idle_s: float) -> DataFrame:
    """samples: k long, t double (seconds), h double, z double. Rows of kind `state` (the figures of each key that had samples, after every batch), `final`
    (those of a key that leaves) and `late` (a sample that changed nothing). Start it with a trigger by time: timers make batches without input, so a query
    with availableNow would not end."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return samples.groupBy("k").transformWithStateInPandas(Ordered(delay_s, idle_s), OUTPUT, "Update", "ProcessingTime")


def split_sink(figures_path: str, late_path: str):
    """A sink for ordered_exposure(): figures and late samples go to two logs (see log_sink)."""
    one, two = log_sink(figures_path), log_sink(late_path)

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            one(batch.where("kind <> 'late'").drop("t", "h"), number)
            two(batch.where("kind = 'late'").select("k", "t", "h"), number)
        finally:
            batch.unpersist()

    return write


def log_sink(path: str):
    """A sink that appends each batch as a partition of a table; a batch that is repeated after a failure takes its own place again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def newest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """The last record of each key of a log, by its batch and what else orders it."""
    rows = [c for c in log.columns if c != "batch"]
    return log.groupBy(key).agg(F.max_by(F.struct(*rows), F.struct("batch", *order)).alias("r")).select("r.*")

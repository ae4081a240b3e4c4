"""Exposure over a stream of samples: eight scalars a key, the same numbers as the batch operator for input in order.

A sample at or before the last one of its key is late or repeated; it is counted and changes nothing. dead_letters() gives what a
watermark would leave out. For samples out of order, late rows as an output and keys that leave, see ordered.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoreline.streaming.ordered import advance, arranged, figures, fresh

NAMES = ("h", "t", "now", "valid", "exposed", "longest", "events", "late")
STATE = "h double, t double, now double, valid double, exposed double, longest double, events long, late long"
OUTPUT = "k long, valid_h double, exposed_h double, max_h double, events long, late long"


def _update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    s = fresh()
    if state.exists:
        s |= dict(zip(NAMES, state.get, strict=True))
    good, late = arranged(pd.concat(list(batches))[["t", "h", "z"]].astype(float), s["t"])
    s["late"] += len(late)
    advance(s, *(good[c].to_numpy() for c in ("t", "h", "z")))
    state.update(tuple(s[c] for c in NAMES))
    yield pd.DataFrame({"k": [key[0]], **{c: [v] for c, v in figures(s).items()}, "late": [s["late"]]})


def exposure_stream(samples: DataFrame) -> DataFrame:
    """samples: k long, t double (seconds), h double, z double. The state of each key that had samples, after every batch."""
    return samples.groupBy("k").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def resampled(samples: DataFrame, width: str, ts: str = "ts", value: str = "value", key: str = "k", delay: str = "10 minutes") -> DataFrame:
    """Mean and number of values of half-open windows, each once its watermark has passed; repeated samples count once."""
    s = samples.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key, ts])
    return s.groupBy(F.window(ts, width), key).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(key, F.col("window.start").alias("start"), "mean", "n")


def dead_letters(batch: DataFrame, newest, delay_s: float, ts: str = "ts") -> DataFrame:
    """Rows of a batch that are older than the newest time seen less the delay."""
    return batch.where(F.unix_micros(F.col(ts).cast("timestamp")) < (F.lit(newest) - delay_s) * 1e6)


def with_end(samples: DataFrame, end_s: float, level: DataFrame) -> DataFrame:
    """A bounded source's samples and the terminal sample of each key (k, h) at the window's end, which closes its last interval."""
    z = samples.groupBy("k").agg(F.max("z").alias("z"))
    return samples.select("k", "t", "h", "z").unionByName(level.join(z, "k").select("k", F.lit(float(end_s)).alias("t"), "h", "z"))


def calendar(samples: DataFrame, width: str, slide: str | None = None, ts: str = "ts", value: str = "value", key: str = "k", delay: str = "10 minutes") -> DataFrame:
    """k, start, end, n, low, high of half-open calendar windows, tumbling or sliding, each once its watermark has passed."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = samples.withWatermark(ts, delay).groupBy(w, key).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "low", "high")


def run_available(stream: DataFrame, checkpoint: str, sink, timeout: int = 600) -> None:
    """Works off what a source has now, once: files that are in the checkpoint aren't read again, and what comes later waits for the next run."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout):
            raise TimeoutError(f"the stream was still running after {timeout} s")
    finally:
        q.stop()


class Progress(StreamingQueryListener):
    """Calls back with the rows and the batch of every step of a stream; a callback that gives False asks for the query to be stopped."""

    def __init__(self, tell):
        self.tell, self.stop_asked = tell, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if self.tell(event.progress.batchId, event.progress.numInputRows) is False:
            self.stop_asked = True

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

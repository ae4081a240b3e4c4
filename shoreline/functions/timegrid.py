"""Time grids in UTC, interval ends, and local times around clock changes."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the ends of a window are said.
INCLUSIVE = {"both": "[start, end]", "left": "[start, end)", "right": "(start, end]", "neither": "(start, end)"}
STEP = re.compile(r"^(\d+)\s*(min|h|m|s)$")


def step_seconds(freq: str) -> int:
    """'30min', '1h', '15 m' or '10s' in seconds; must be positive."""
    found = STEP.match(freq.strip())
    if not found or not int(found[1]):
        raise ValueError(f"not a fixed positive step: {freq!r}")
    return int(found[1]) * {"min": 60, "m": 60, "h": 3600, "s": 1}[found[2]]


def interval_semantics(inclusive: str) -> str:
    if inclusive not in INCLUSIVE:
        raise ValueError(f"inclusive must be one of {', '.join(INCLUSIVE)}")
    return INCLUSIVE[inclusive]


def validate_window(start: datetime, end: datetime, freq: str) -> int:
    if not start < end:
        raise ValueError("start must be before end")
    return step_seconds(freq)


def localize(t: datetime, tz: str, ambiguous: str = "standard") -> datetime:
    """A naive local time as UTC. A time in a gap is the instant the clock changes; one that comes twice is standard
    time (window ends) or daylight time (points)."""
    zone = ZoneInfo(tz)
    early, late = t.replace(tzinfo=zone, fold=0), t.replace(tzinfo=zone, fold=1)
    a, b = early.astimezone(timezone.utc), late.astimezone(timezone.utc)
    if a == b:
        return a
    if early.utcoffset() < late.utcoffset():  # a gap: search the change between the two readings
        low, high = b, a
        before = low.astimezone(zone).utcoffset()
        while high - low > timedelta(seconds=1):
            mid = low + (high - low) / 2
            low, high = (mid, high) if mid.astimezone(zone).utcoffset() == before else (low, mid)
        return high.replace(microsecond=0)
    return b if ambiguous == "standard" else a


def time_grid(spark: SparkSession, start: datetime, end: datetime, freq: str, inclusive: str = "both", tz: str = "UTC") -> DataFrame:
    """One row `t` (timestamp, UTC) a step of physical time; naive ends are local times of tz."""
    step = validate_window(start, end, freq)
    interval_semantics(inclusive)
    a, b = (int((localize(x, tz) if x.tzinfo is None else x).timestamp()) for x in (start, end))
    n = (b - a) // step + 1
    grid = spark.range(n).select((F.lit(a) + F.col("id") * step).alias("s"))
    if inclusive in ("right", "neither"):
        grid = grid.where(F.col("s") > a)
    if inclusive in ("left", "neither"):
        grid = grid.where(F.col("s") < b)
    return grid.select(F.timestamp_seconds("s").alias("t"))


def seconds(ts: Column) -> Column:
    """Epoch seconds of a timestamp or timestamp_ntz, as double."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def parse_epoch(text: Column) -> Column:
    """Epoch seconds from a number over 1e8 or from a time's text; null where it is neither."""
    number = text.try_cast("double")
    return F.coalesce(F.when(number > 1e8, number), F.unix_micros(text.try_cast("timestamp")) / F.lit(1e6))


def check_time_axis(times: DataFrame, step: float, t: str = "t_seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """n, not_increasing, worst_step (seconds off the cadence), ok (within a millisecond) of the axis of each key, in the order of `_seq`. Without
    keys there is one axis, which one task orders: an axis is bounded, a table of many series needs its keys."""
    from pyspark.sql.window import Window

    dt = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy("_seq"))
    rows = times.withColumn("_dt", dt)
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("_dt") <= 0).alias("not_increasing"), F.coalesce(F.max(F.abs(F.col("_dt") - step)), F.lit(0.0)).alias("worst_step"))
    return out.withColumn("ok", (F.col("not_increasing") == 0) & (F.col("worst_step") <= 1e-3))


def samples_in(start: datetime, end: datetime, freq: str, closed: bool) -> int:
    """How many samples a window has: half-open, or closed with one more."""
    return int((end - start).total_seconds()) // step_seconds(freq) + int(closed)

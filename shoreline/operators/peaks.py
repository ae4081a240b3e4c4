"""High and low water in a series: strict local extremes with plateau middles, thinned by distance from the highest down."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MISSING = -9999.0


def local_extremes(series: DataFrame, key: str, t: str, h: str) -> DataFrame:
    """key, t, h, kind of samples strictly above (high) or below (low) both neighbours."""
    w = Window.partitionBy(key).orderBy(t)
    p = series.select(key, F.col(t).alias("t"), F.col(h).alias("h"), F.lag(h).over(w).alias("a"), F.lead(h).over(w).alias("b"))
    kind = F.when((F.col("h") > F.col("a")) & (F.col("h") > F.col("b")), "high").when((F.col("h") < F.col("a")) & (F.col("h") < F.col("b")), "low")
    return p.withColumn("kind", kind).where("kind is not null").select(key, "t", "h", "kind")


def top_of_each(found: DataFrame, key: str, n: int = 2) -> DataFrame:
    """The n highest highs and lowest lows of each key."""
    order = F.when(F.col("kind") == "high", -F.col("h")).otherwise(F.col("h"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key, "kind").orderBy(order, "t"))).where(F.col("rank") <= n)


def find_peaks(x: np.ndarray, distance: int) -> np.ndarray:
    """Places of the maxima of x; of two nearer than `distance` samples the lower goes, starting from the highest."""
    n, i, out = len(x), 1, []
    while i < n - 1:
        if x[i] > x[i - 1]:
            j = i
            while j < n - 1 and x[j + 1] == x[i]:
                j += 1
            if j < n - 1 and x[j + 1] < x[i]:
                out.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    at = np.array(out, int)
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    return at[keep]


def high_low_water(series: DataFrame, key: str, step_h: float, t: str = "t", h: str = "h") -> DataFrame:
    """key, t, h, kind of high and low waters at least 10 hours apart. A series is one station's, so it fits a task."""
    distance = max(1, int(10 / step_h))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        parts = []
        for kind, sign in (("high", 1.0), ("low", -1.0)):
            x = (sign * pdf["h"]).fillna(MISSING).to_numpy()
            at = find_peaks(x, distance)
            at = at[x[at] != MISSING] if len(at) else at
            parts.append(pdf.iloc[at].assign(kind=kind))
        return pd.concat(parts)[[key, "t", "h", "kind"]]

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.select(key, F.col(t).alias("t"), F.col(h).alias("h")).groupBy(key).applyInPandas(one, f"{key} {kinds[key]}, t {kinds[t]}, h {kinds[h]}, kind string")

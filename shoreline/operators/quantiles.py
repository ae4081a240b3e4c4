"""Exact quantiles, of groups of any size, in tasks of bounded memory.

A group of up to SMALL values is one aggregate. The order statistics that the quantiles of a larger one need are found by selection: a sketch of
its values proposes cuts around the wanted ranks, one pass counts what lies between and at the cuts, and only the intervals that hold a wanted
rank go on, each with the sketch that the same pass made of it. Values at a cut are counted apart, so a value that is there very often is settled at once
and every round leaves out at least one distinct value; with usual data it leaves a twentieth of the rest. An interval of up to LEAF values is
sorted. The sketch only chooses cuts: results are exact whatever it says, and those of a group don't depend on which way it took."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.operators.frequency import finite
from shoreline.sources.tables import freed, small as if_small, stored

SMALL, LEAF = 1 << 20, 1 << 14
GRID, ACCURACY = 64, 4096
#: Intervals that may go to every executor (about 100 bytes each).
MOST_INTERVALS = 1 << 16


def between(n: Column, p: float, at) -> Column:
    """The quantile p of n values, from the order statistics at(rank from 0), linear between two of them."""
    position = F.lit(float(p)) * (n - 1)
    low, high = F.floor(position), F.ceil(position)
    a, b = at(low), at(high)
    return F.when((low == high) | (a == b), a).otherwise((high - position) * a + (position - low) * b)


def percentiles(rows: DataFrame, value: str | Column, probs: list[float], *keys: str, most: int = SMALL, leaf: int = LEAF) -> DataFrame:
    """keys, n, q (array, one for each of probs) over the finite values of each group; groups without any are left out. Groups of more than `most` values
    are selected from."""
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError("quantiles are between 0 and 1")
    value = F.col(value) if isinstance(value, str) else value
    x = rows.select(*keys, F.to_json(F.struct(*keys)).alias("_k") if keys else F.lit("").alias("_k"), finite(value.cast("double")).alias("_x")).where("_x is not null")
    whole = lambda t: t.groupBy("_k", *keys).agg(F.count("*").alias("n"), F.percentile("_x", F.array(*(F.lit(float(p)) for p in probs))).alias("q")).select(*keys, "n", "q")
    large = stored(x.groupBy("_k", *keys).agg(F.count("*").alias("n")).where(F.col("n") > most), "large-groups")
    if large.isEmpty():
        freed(large)
        return whole(x)
    names = if_small(large.select("_k"), MOST_INTERVALS)
    position = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_sort(F.array_distinct(F.array(*(f(p) for p in position for f in (F.floor, F.ceil)))))
    found = select(x.join(names, "_k", "left_semi").select("_k", "_x"), large.select("_k", ranks.alias("ranks")), leaf)
    at = found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    q = F.array(*(between(F.col("n"), p, lambda r: F.try_element_at("at", r)) for p in probs))
    return whole(x.join(names, "_k", "left_anti")).unionByName(large.join(at, "_k").select(*keys, "n", q.alias("q")))


def select(values: DataFrame, wanted: DataFrame, leaf: int = LEAF) -> DataFrame:
    """_k, rank, value: the order statistics (from 0) of values (_k, _x) that `wanted` (_k, ranks) names, as a written table."""
    grid = F.array(*(F.lit(k / GRID) for k in range(GRID + 1)))
    about = [F.count("*").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.percentile_approx("_x", grid, ACCURACY).alias("sketch")]
    state = values.groupBy("_k").agg(*about).join(wanted, "_k").withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "before": F.lit(0).cast("long")})
    settled, leaves, rounds = None, None, []
    while True:
        state = stored(state, "selection")
        rounds.append(state)
        one = state.where("low = high").select("_k", F.explode("ranks").alias("rank"), F.col("low").alias("value"))
        few = state.where((F.col("low") != F.col("high")) & (F.col("n") <= leaf)).select("_k", "lo", "hi", "before", "ranks")
        settled = one if settled is None else settled.unionByName(one)
        leaves = few if leaves is None else leaves.unionByName(few)
        more = state.where((F.col("low") != F.col("high")) & (F.col("n") > leaf))
        if more.isEmpty():
            break
        near = F.transform("ranks", lambda t: F.least(F.lit(GRID), F.floor((t - F.col("before")) * GRID / F.col("n")).cast("int")))
        cuts = F.flatten(F.transform(near, lambda i: F.array(F.element_at("sketch", F.greatest(F.lit(1), i)), F.element_at("sketch", F.least(F.lit(GRID + 1), i + 3)))))
        more = more.select("_k", "lo", "hi", "before", "ranks", F.array_sort(F.array_distinct(cuts)).alias("cuts"))
        place = 2 * F.size(F.filter("cuts", lambda c: c < F.col("_x"))) + F.array_contains("cuts", F.col("_x")).cast("int")
        parts = _inside(values, more).withColumn("part", place).groupBy("_k", "before", "part").agg(*about, F.first("cuts").alias("cuts"), F.first("ranks").alias("ranks"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        earlier = F.coalesce(F.sum("n").over(Window.partitionBy("_k", "before").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.withColumn("before", F.col("before") + earlier).withColumn("ranks", F.filter("ranks", lambda t: (t >= F.col("before")) & (t < F.col("before") + F.col("n")))).where(F.size("ranks") > 0)
        edge = lambda k, other: F.coalesce(F.get("cuts", k), F.col(other))
        half = F.expr("part div 2").cast("int")
        state = parts.withColumns({"lo": edge(half - 1, "lo"), "hi": edge(half, "hi")}).select("_k", "n", "low", "high", "sketch", "ranks", "lo", "hi", "before")
    lists = _inside(values, leaves).groupBy("_k", "before").agg(F.array_sort(F.collect_list("_x")).alias("v"), F.first("ranks").alias("ranks"))
    lists = lists.withColumn("rank", F.explode("ranks")).select("_k", "rank", F.get("v", (F.col("rank") - F.col("before")).cast("int")).alias("value"))
    out = stored(settled.unionByName(lists), "order-statistics")
    freed(*rounds)
    return out


def _inside(values: DataFrame, intervals: DataFrame) -> DataFrame:
    """Values between lo and hi, without these, of the intervals of their group, which don't overlap."""
    v = values.join(if_small(intervals, MOST_INTERVALS), "_k")
    return v.where((F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi"))))

"""Errors, gates, counts and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.operators.frequency import finite
from shoreline.operators.quantiles import SMALL, percentiles

#: Fixed values: (grade, largest MAE, P95 and maximum in percentage points); fewer than LEAST_N pairs give no grade.
GATES, LEAST_N = (("STRONG PASS", 0.5, 1.0, 5.0), ("PASS", 1.0, 2.0, 5.0)), 20
#: Upper ends of the distance bins in km.
BINS = (0.5, 1.0, 2.0, 4.0)


def errors(pairs: DataFrame, a: str, b: str, *keys: str, most: int = SMALL) -> DataFrame:
    """n, bias, mae, rmse, p50, p90, p95, p99, worst of a - b over pairs where both are finite; without keys one row, of n = 0 where there is none."""
    e = pairs.select(*keys, (finite(F.col(a).cast("double")) - finite(F.col(b).cast("double"))).alias("_e")).where("_e is not null")
    x, probs = F.abs("_e"), (0.5, 0.9, 0.95, 0.99)
    sums = e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_e").alias("bias"), F.avg(x).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), F.max(x).alias("worst"))
    q = percentiles(e, x, list(probs), *keys, most=most).select(*(F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)), "q")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return sums.join(q, same, "left").select(*keys, "n", "bias", "mae", "rmse", *(F.col("q")[k].alias(f"p{int(p * 100)}") for k, p in enumerate(probs)), "worst")


def gate(mae: Column, p95: Column, worst: Column, n: Column) -> Column:
    out = F.when(n < LEAST_N, "INSUFFICIENT")
    for name, m, p, w in GATES:
        out = out.when((mae <= m) & (p95 <= p) & (worst <= w), name)
    return out.otherwise("INVESTIGATE")


def outliers(pairs: DataFrame, a: str, b: str, key: str, n: int = 20) -> DataFrame:
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, F.abs(F.col(a) - F.col(b)).alias("error")).orderBy(F.col("error").desc(), key).limit(n)


def distance_bin(km: Column) -> Column:
    out, low = None, 0.0
    for high in BINS:
        out = F.when(km < high, f"{low:g}-{high:g}") if out is None else out.when(km < high, f"{low:g}-{high:g}")
        low = high
    return out.otherwise(f">{low:g}")


def aligned(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of two rasters over the union of their pixels."""
    return left.select(*keys, F.col(value).alias("a")).join(right.select(*keys, F.col(value).alias("b")), keys, "full_outer")


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """both, only_a, only_b, unequal, worst, identical."""
    j = aligned(left, right, keys, value)
    a, b = F.col("a"), F.col("b")
    out = j.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("both"), F.count_if(a.isNotNull() & b.isNull()).alias("only_a"), F.count_if(a.isNull() & b.isNotNull()).alias("only_b"), F.count_if(~a.eqNullSafe(b)).alias("unequal"), F.max(F.abs(a - b)).alias("worst"))
    return out.withColumn("identical", F.col("unequal") == 0)


#: What a node lacks first.
NO_TIDE, NO_MDT, NO_DELTA_N = "A_FES_INVALID", "B_FES_VALID_MDT_INVALID", "C_FES_VALID_MDT_VALID_DELTAN_INVALID"
COMPLETE, OTHER_FAILURE = "D_FES_VALID_DATUM_VALID", "E_OTHER_DATUM_FAILURE"


def present(c: Column) -> Column:
    """True and numbers but 0, NaN and infinities; a null isn't."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0), F.lit(False))


def support_class(tide: Column, mdt: Column, delta_n: Column, offset: Column) -> Column:
    """The first of tide, topography, geoid difference and offset that a node lacks; a value of 0 counts as lacking."""
    return F.when(~present(tide), NO_TIDE).when(~present(mdt), NO_MDT).when(~present(delta_n), NO_DELTA_N).when(present(offset), COMPLETE).otherwise(OTHER_FAILURE)


def class_counts(nodes: DataFrame, level: str = "level", cls: str = "class") -> DataFrame:
    """Counts by level and class, and by level, and in all, with the share of the level."""
    r = nodes.rollup(level, cls).agg(F.count("*").alias("n"))
    whole = F.max("n").over(Window.partitionBy(level))
    return r.withColumn("percent", 100.0 * F.col("n") / whole)


def incident_levels(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Levels of the cells at each node; -1 where there is none."""
    at = cells.select(F.explode("corners").alias("node_id"), "level").groupBy("node_id").agg(F.min("level").alias("low"), F.max("level").alias("high"))
    return nodes.select("node_id").join(at, "node_id", "left").select("node_id", F.coalesce("low", F.lit(-1)).alias("low"), F.coalesce("high", F.lit(-1)).alias("high"))


def mask_geometry(pixels: DataFrame, height: int, width: int, valid: Column) -> DataFrame:
    """valid_share, box, aspect, edge_share (within two pixels of the border) and kind (fixed values) of a mask."""
    m = pixels.withColumn("_v", valid)
    edge = (F.col("row") < 2) | (F.col("row") >= height - 2) | (F.col("col") < 2) | (F.col("col") >= width - 2)
    v = lambda c: F.when(F.col("_v"), F.col(c))
    a = m.agg(F.count_if("_v").alias("n"), F.min(v("row")).alias("r0"), F.max(v("row")).alias("r1"), F.min(v("col")).alias("c0"), F.max(v("col")).alias("c1"), F.count_if(F.col("_v") & edge).alias("e"))
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    share, aspect, on_edge = F.col("n") / (height * width), F.greatest(h, w) / F.least(h, w), F.col("e") / F.nullif(F.col("n"), F.lit(0))
    kind = F.when(F.col("n") == 0, "EMPTY_TARGET").when(aspect > 4, "NARROW_STRIP").when(on_edge > 0.3, "EDGE_TARGET").when(share > 0.4, "WIDE_TARGET").otherwise("COMPLEX_TARGET")
    return a.select("n", share.alias("valid_share"), "r0", "r1", "c0", "c1", aspect.alias("aspect"), on_edge.alias("edge_share"), kind.alias("kind"))


def elevation_quantiles(pixels: DataFrame, *keys: str) -> DataFrame:
    """Test heights of a cell: the deciles 1, 5 and 9 of ten pixels or more, else all distinct heights."""
    z = pixels.where(F.col("z").isNotNull()).groupBy(*keys).agg(F.count("z").alias("n"), F.percentile("z", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"), F.array_sort(F.collect_set("z")).alias("s"))
    return z.select(*keys, "n", F.when(F.col("n") >= 10, F.col("q")).otherwise(F.col("s")).alias("heights"))


def seeded_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows chosen by a hash, the same on every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def first_of_each(df: DataFrame, kind: str, order: str, n: int = 5) -> DataFrame:
    """The first of every kind, then what comes next, n in all."""
    r = df.withColumn("_k", F.row_number().over(Window.partitionBy(kind).orderBy(order)))
    return r.orderBy(F.when(F.col("_k") == 1, 0).otherwise(1), order).limit(n).drop("_k")


def smoke(series: DataFrame, key: str, level: str = "level") -> DataFrame:
    """key, n, valid, invalid, low, high, mean and status of every series."""
    h = finite(F.col(level))
    out = series.groupBy(key).agg(F.count("*").alias("n"), F.count(h).alias("valid"), F.min(h).alias("low"), F.max(h).alias("high"), F.avg(h).alias("mean"))
    return out.select(key, "n", "valid", (F.col("n") - F.col("valid")).alias("invalid"), "low", "high", "mean", F.when(F.col("valid") > 0, "VALID").otherwise("INVALID_ALL_NAN").alias("status"))


def node_summary(levels: DataFrame, key: str = "node_id", level: str = "level", flag: str = "flag") -> DataFrame:
    """key, any_finite, least_flag, finite_n, finite_share of every node's series."""
    h = finite(F.col(level))
    out = levels.groupBy(key).agg(F.count(h).alias("finite_n"), F.min(flag).alias("least_flag"), F.count("*").alias("n"))
    return out.select(key, (F.col("finite_n") > 0).alias("any_finite"), "least_flag", "finite_n", (F.col("finite_n") / F.col("n")).alias("finite_share"))


def corner_histogram(cells: DataFrame, finite_nodes: DataFrame) -> DataFrame:
    """finite (0 to 4), cells, and induced (corners that have a value in cells that still can't be interpolated). cells: cell_id, corners;
    finite_nodes: node_id of those with a value."""
    c = cells.select("cell_id", F.explode("corners").alias("node_id")).join(finite_nodes.select("node_id").distinct().withColumn("_f", F.lit(1)), "node_id", "left")
    c = c.groupBy("cell_id").agg(F.count("_f").cast("int").alias("finite"))
    return c.groupBy("finite").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("finite") < 4, F.col("finite")).otherwise(0)).alias("induced"))


def solved_counts(pixels: DataFrame, z: str, value: str) -> DataFrame:
    """total, input_valid, solved, unsolved of a product over its terrain."""
    ok = F.col(z).isNotNull()
    a = pixels.agg(F.count("*").alias("total"), F.count_if(ok).alias("input_valid"), F.count_if(ok & finite(F.col(value)).isNotNull()).alias("solved"))
    return a.withColumn("unsolved", F.col("input_valid") - F.col("solved"))


def distinct_nodes(cells: DataFrame) -> DataFrame:
    return cells.select(F.explode("corners").alias("node_id")).agg(F.count_distinct("node_id").alias("nodes"))


def outside_domain(values: DataFrame, column: str, allowed: list) -> DataFrame:
    """Distinct values of a column that aren't allowed; empty for a sound mask."""
    return values.where(F.col(column).isNotNull()).select(column).distinct().where(~F.col(column).isin(*allowed))


def memory_mb(nodes: Column | int, samples: Column | int, arrays: int = 2) -> Column:
    """MB of the level arrays of control nodes, 4 bytes a sample and array."""
    return F.lit(nodes).cast("double") * F.lit(samples).cast("double") * (4.0 * arrays) / (1024.0 * 1024.0)


def formatted_size(mb: Column) -> Column:
    return F.when(mb < 1, F.format_string("%.1f KB", F.bround(mb * 1024, 1))).when(mb < 1024, F.format_string("%.2f MB", F.bround(mb, 2))).otherwise(F.format_string("%.2f GB", F.bround(mb / 1024, 2)))


def recovered(distances: DataFrame, strategies: list[str], limits: list[float]) -> DataFrame:
    """strategy, limit_km, recovered: nodes whose nearest anchor under a strategy (a column of km, null for none) is within each limit."""
    each = F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(s).alias("km")) for s in strategies))
    long = distances.select(F.explode(each).alias("e")).select("e.*").withColumn("limit_km", F.explode(F.array(*map(F.lit, map(float, limits)))))
    return long.groupBy("strategy", "limit_km").agg(F.count_if(F.col("km") <= F.col("limit_km")).alias("recovered"))


def sampled_agreement(direct: DataFrame, fitted: DataFrame, key: str, value: str) -> DataFrame:
    """common, only_direct, only_fitted and the errors of a product at sampled pixels against direct evaluation."""
    j = aligned(direct, fitted, [key], value)
    a, b = finite(F.col("a")), finite(F.col("b"))
    n = j.agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("common"), F.count_if(a.isNotNull() & b.isNull()).alias("only_direct"), F.count_if(a.isNull() & b.isNotNull()).alias("only_fitted"))
    return n.crossJoin(F.broadcast(errors(j.select(a.alias("a"), b.alias("b")), "b", "a").drop("n")))

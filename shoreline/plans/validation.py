"""Experiments that hold products against each other and against the tide model."""

from __future__ import annotations

import time
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.functions import geo, tide, timegrid
from shoreline.operators import cells, frequency, gridcells, metrics, sampling
from shoreline.operators import exposure as stations
from shoreline.operators.exposure import metrics as exposure_metrics
from shoreline.operators.quantiles import percentiles
from shoreline.plans import control, products
from shoreline.plans.control import Settings
from shoreline.plans.rasters import attribute
from shoreline.sources import products as stored
from shoreline.sources import rasters
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import stored as stored_table


def against_direct(pixels: DataFrame, frame: Frame, model, window: products.Window, product: DataFrame, n: int = 1000, seed: int = 42, least_finite: float = 0.8) -> DataFrame:
    """common, only_direct, only_fitted, errors and grade of a frequency product at n sampled pixels. Too few with a direct value is an error."""
    direct = products.direct_sample(pixels, frame, model, window, n, seed)
    total, known = direct.agg(F.count("*"), F.count("frequency")).first()
    if known < least_finite * total or not known:
        raise ValueError(f"only {known} of {total} sampled pixels have a direct value")
    fitted = product.select((F.col("row").cast("long") * frame.width + F.col("col")).alias("pixel"), "frequency").join(direct.select("pixel"), "pixel", "left_semi")
    e = metrics.sampled_agreement(direct, fitted, "pixel", "frequency")
    return e.withColumn("grade", metrics.gate(F.col("mae"), F.col("p95"), F.col("worst"), F.col("common")))


def holdout(anchors: DataFrame, sid: str, value: str, held, cell_deg: float = 1.0) -> DataFrame:
    """method, n, bias, mae, ... of the nearest value and of inverse-distance means of 4 and 8, at the anchors that `held` (a condition) takes out of the
    support. No anchor is on both sides."""
    a = anchors.where(F.col(value).isNotNull())
    out, support = a.where(held), a.where(~held)
    truth = out.select(F.col(sid).alias("id"), F.col(value).alias("b"))
    parts = []
    for name, k in (("nearest", 1), ("idw4", 4), ("idw8", 8)):
        found = sampling.idw(out.select(F.col(sid).alias("id"), "lon", "lat"), support, "id", sid, value, k=k, cutoff_m=500_000.0, cell_deg=cell_deg)
        parts.append(found.select("id", F.col("value").alias("a"), F.lit(name).alias("method")))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).join(truth, "id")
    return metrics.errors(rows, "a", "b", "method")


def block_of(lon, lat, degrees: float):
    """The square of a spatial cross-validation that a place is in."""
    return F.concat_ws(":", F.floor(lon / degrees).cast("string"), F.floor(lat / degrees).cast("string"))


def blockwise(anchors: DataFrame, sid: str, value: str, degrees: float, cell_deg: float = 1.0) -> DataFrame:
    """method, n, errors of predicting every anchor from those outside its square: neighbours are searched among those of other
    squares alone, for all squares in one job."""
    a = anchors.where(F.col(value).isNotNull()).withColumn("_b", block_of(F.col("lon"), F.col("lat"), degrees))
    near = sampling.knn(a.select(F.col(sid).alias("id"), "lon", "lat", "_b"), a, "id", sid, 8, cell_deg, apart="_b")
    other = near.join(a.select(sid, F.col(value).alias("v")), sid)
    order = F.array_sort(F.collect_list(F.struct("d", sid, "v")))
    lists = other.groupBy("id").agg(order.alias("l"))
    mean = lambda k: F.aggregate(F.slice("l", 1, k), F.lit(0.0), lambda s, x: s + x.v / F.greatest(x.d, F.lit(1e-4)) ** 2) / F.aggregate(F.slice("l", 1, k), F.lit(0.0), lambda s, x: s + 1 / F.greatest(x.d, F.lit(1e-4)) ** 2)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), mean(k).alias("a")) for n, k in (("nearest", 1), ("idw4", 4), ("idw8", 8)))))
    rows = lists.select("id", each.alias("m")).select("id", "m.*").join(a.select(F.col(sid).alias("id"), F.col(value).alias("b")), "id")
    return metrics.errors(rows, "a", "b", "method")


def triangle_truth(grid: DataFrame, x: gridcells.Axis, y: gridcells.Axis, points: DataFrame, key: str) -> DataFrame:
    """n and errors of the barycentric value of a cell's first three corners against the bilinear value of all four, at points within the triangle."""
    four = gridcells.geometry(points, grid, x, y, key).where(F.col("kind") == gridcells.TYPE_4).select(key, F.col("value").alias("b"))
    at = gridcells.corners(points, grid, x, y, key).join(four, key)
    u, v = (F.col("lon") - x.at(F.col("i"))) / x.step, (F.col("lat") - y.at(F.col("j"))) / y.step
    a = (1.0 - u - v) * F.col("v")[0] + u * F.col("v")[1] + v * F.col("v")[2]
    return metrics.errors(at.where(u + v <= 1.0).select(a.alias("a"), "b"), "a", "b")


def identical_runs(a: dict, b: dict, tolerance: float = 0.0) -> DataFrame:
    """One row: nodes and pixels that differ between two runs, and whether the runs are identical. a, b: nodes (x, y, valid), tide (x, y, t, level)
    and product (row, col, frequency, qc) of each."""
    def differing(name, keys, value):
        j = a[name].select(*keys, F.col(value).alias("p")).join(b[name].select(*keys, F.col(value).alias("q")), keys, "full_outer")
        far = F.abs(F.col("p").cast("double") - F.col("q").cast("double")) > tolerance
        return j.agg(F.count_if(F.coalesce(far, ~F.col("p").eqNullSafe(F.col("q")))).alias(f"{name}_{value}"), F.coalesce(F.max(F.abs(F.col("p").cast("double") - F.col("q").cast("double"))), F.lit(0.0)).alias(f"{name}_{value}_worst"))

    parts = [differing("nodes", ["x", "y"], "valid"), differing("tide", ["x", "y", "t"], "level"), differing("product", ["row", "col"], "frequency"), differing("product", ["row", "col"], "qc")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out.withColumn("identical", (F.col("nodes_valid") == 0) & (F.col("tide_level") == 0) & (F.col("product_frequency") == 0) & (F.col("product_qc") == 0))


def exposure_oracle(pixels: DataFrame, frame: Frame, model, window: products.Window, product: DataFrame, n: int = 30, seed: int = 42) -> DataFrame:
    """pixel, direct and fitted exposed hours and events at n sampled pixels: the state machine over the model's own series against the product."""
    spark = pixels.sparkSession
    p = metrics.seeded_sample(frame.centers(pixels.where(F.col("z").isNotNull())), n, seed, "row", "col")
    lon, lat = frame.lonlat(F.col("x"), F.col("y"))
    p = p.select((F.col("row").cast("long") * frame.width + F.col("col")).alias("node_id"), "z", lon.alias("lon"), lat.alias("lat"))
    end = spark.createDataFrame([(window.seconds()[1],)], "s double").select(F.timestamp_seconds("s").alias("t"))
    series = model.levels(p.select("node_id", "lon", "lat"), window.times(spark).unionByName(end)).join(p.select("node_id", "z"), "node_id")
    m = stations.metrics(series.select("node_id", (F.unix_micros("t") / F.lit(1e6)).alias("t"), F.col("level").alias("h"), "z"), "node_id")
    fitted = product.select((F.col("row").cast("long") * frame.width + F.col("col")).alias("node_id"), F.col("exposed_h").alias("fitted_h"), F.col("events").alias("fitted_events"))
    return m.select("node_id", "exposed_h", "events").join(fitted, "node_id", "left").withColumnRenamed("node_id", "pixel")


#: The profile runs: name -> (terrain, tide model, barrier columns as shares).
PROFILES = {"smooth": ("ramp", tide.Synthetic(), None), "steep": ("beach", tide.Synthetic({"ax": 4.0, "by": 4.0}), None), "basins": ("flat", tide.TwoBasin(), (0.45, 0.55))}


def profile(spark, name: str, size: int = 60, res: float = 0.01, settings: Settings = Settings(8000.0, 1000.0, 1.0, max_nodes=None), frame: Frame | None = None, pixels: DataFrame | None = None) -> DataFrame:
    """row, col, frequency, qc of one of the profile runs over a day: a smooth tide over a ramp, a steep one over a beach, and two basins. With a frame and
    pixels their heights take the terrain's place; those of the barrier's columns have none."""
    pattern, model, barrier = PROFILES[name]
    frame = frame or Frame(120.2 - size * res / 2, 30.0 + size * res / 2, res, -res, size, size)
    gone = tuple(int(b * frame.width) for b in barrier) if barrier else None
    z = rasters.terrain(spark, pattern, frame.width, frame.height, gone) if pixels is None else pixels.where(~F.col("col").between(gone[0], gone[1] - 1)) if gone else pixels
    return products.inundation(z, frame, model, products.Window(datetime(2024, 1, 1), datetime(2024, 1, 2), "1h"), settings)


def sensitivity(series: DataFrame, other: DataFrame, key: str, level: str, quantiles: list[float]) -> DataFrame:
    """errors (percentage points, samples at or above) of another series' frequencies at the quantiles of each key's own levels."""
    q = series.groupBy(key).agg(F.percentile(frequency.finite(F.col(level)), F.array(*map(F.lit, quantiles))).alias("q")).select(key, F.explode("q").alias("z"))
    a = frequency.frequency(other, q, key, level, at_least=True).select(key, "z", F.col("frequency").alias("a"))
    b = frequency.frequency(series, q, key, level, at_least=True).select(key, "z", F.col("frequency").alias("b"))
    return metrics.errors(a.join(b, [key, "z"]), "a", "b")


#: The quantiles of a sensitivity study, and how many stations its exposures are of.
STUDY_QUANTILES, STUDY_STATIONS = [0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99], 20


def sensitivity_study(stations: DataFrame, model_of, window: products.Window, least: list[str], quantiles: list[float] = STUDY_QUANTILES) -> tuple[DataFrame, DataFrame]:
    """What longer steps and fewer constituents do at stations (node_id, lon, lat). model_of(constituents) gives a tide model; `least` are the constituents that
    are left; the steps are the window's, twice and four times as long.

    First table: comparison (step2, step4, least, least_step2: the last against all constituents at twice the step) and the errors, in percentage points,
    of frequencies at or above the quantiles of each station's own levels. Second: comparison (step2, step4) and the mean absolute differences of exposure, longest
    exposure and events at the middle quantile of the first STUDY_STATIONS stations. Each model is evaluated once."""
    spark, step = stations.sparkSession, timegrid.step_seconds(window.freq)
    times = window.times(spark)
    levels = {name: stored_table(model_of(which).levels(stations, times).select("node_id", (F.unix_micros("t") / F.lit(1e6)).alias("t"), F.col("level").alias("h")), f"study-{name}") for name, which in (("all", "all"), ("least", least))}
    on = lambda n: (F.col("t") - window.seconds()[0]) % (n * step) == 0
    every = lambda name, n: levels[name].where(on(n))
    z = stored_table(percentiles(levels["all"], "h", quantiles, "node_id").select("node_id", "q", F.array_sort("q").alias("z")), "study-quantiles")
    # a sample is counted once, by how many of its station's quantiles it reaches, and not once for each quantile
    both = levels["all"].withColumn("least", F.lit(False)).unionByName(levels["least"].withColumn("least", F.lit(True)))
    both = both.withColumn("h", frequency.finite(F.col("h").cast("float"))).where("h is not null").join(z.select("node_id", "z"), "node_id")
    reached = reduce(Column.__add__, [(F.col("h") >= F.get("z", F.lit(i))).cast("int") for i in range(len(quantiles))])
    kinds = {"h1": ~F.col("least"), "h2": ~F.col("least") & on(2), "h4": ~F.col("least") & on(4), "m1": F.col("least"), "m2": F.col("least") & on(2)}
    counts = both.groupBy("node_id", reached.alias("reached")).agg(*(F.count_if(c).alias(n) for n, c in kinds.items()))
    up = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("reached")))).groupBy("node_id", "i").agg(*(F.sum(n).alias(n) for n in kinds))
    of_all = Window.partitionBy("node_id")  # i is 0 for all samples
    share = up.select("i", *((100.0 * F.col(n) / F.nullif(F.max(n).over(of_all), F.lit(0))).alias(n) for n in kinds)).where("i > 0")
    pairs = {"step2": ("h2", "h1"), "step4": ("h4", "h1"), "least": ("m1", "h1"), "least_step2": ("m2", "h2")}
    rows = stored_table(share.select(F.inline(F.array(*(F.struct(F.lit(name).alias("comparison"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in pairs.items())))), "study-shares")
    first = metrics.errors(rows, "a", "b", "comparison")
    some = stations.select("node_id").orderBy("node_id").limit(STUDY_STATIONS)
    middle = z.select("node_id", F.get("q", F.lit(len(quantiles) // 2)).alias("z")).join(F.broadcast(some), "node_id")
    exposed = lambda n, s: exposure_metrics(every("all", n).join(middle, "node_id"), "node_id").select("node_id", *(F.col(c).alias(f"{c}{s}") for c in ("exposed_h", "max_h", "events")))
    far = lambda c: F.avg(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")))
    second = [exposed(n, "_a").join(exposed(1, "_b"), "node_id").agg(far("exposed_h").alias("exposed_mae_h"), far("max_h").alias("max_mae_h"), far("events").alias("events_mae")).select(F.lit(name).alias("comparison"), "*") for name, n in (("step2", 2), ("step4", 4))]
    return first, reduce(DataFrame.unionByName, second)


def nearest_km(points: DataFrame, anchors: DataFrame, key: str, sid: str) -> DataFrame:
    """key, sid, km (planar, at the middle latitude) of the anchor that is nearest by chord."""
    near = sampling.knn(points, anchors, key, sid, 1).select(key, sid)
    at = lambda df, i, s: df.select(i, F.col("lon").alias(f"lon{s}"), F.col("lat").alias(f"lat{s}"))
    j = near.join(at(points, key, 1), key).join(at(anchors, sid, 2), sid)
    return j.select(key, sid, geo.planar_km(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("km"))


def evidence(results: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes the tables of a verification as JSON, and gives relative, bytes and sha256 of every file, the register of the run, which is written too."""
    spark = next(iter(results.values())).sparkSession
    for name, df in results.items():
        df.coalesce(1).write.json(f"{folder}/{name}")
    register = stored.hashed_files(spark, folder).where("relative not like '%/.%' and relative not like '%_SUCCESS'")
    register.coalesce(1).write.json(f"{folder}/register")
    return spark.read.json(f"{folder}/register").select("relative", "bytes", "sha256")


def timed(steps: dict) -> list[tuple[str, float, int]]:
    """Name, seconds and rows of each step (a function that gives a table), run one after the other."""
    out = []
    for name, step in steps.items():
        began = time.monotonic()
        rows = step().count()
        out.append((name, time.monotonic() - began, rows))
    return out


def master(folder: str, pixels: DataFrame, frame: Frame, model, window: products.Window, settings: Settings, mdt: DataFrame, x: gridcells.Axis, y: gridcells.Axis, delta_n, quantiles: list[float]) -> dict[str, DataFrame]:
    """The whole verification of a raster: classes of its control nodes (with the levels of their cells), geometry of those that lack topography, the triangle
    test there, the hold-out of every fifth node with topography, why pixels have no solution, sensitivity to a step twice as long, and the
    register of files. Gives the tables, which are written under `folder`. mdt: the topography grid; delta_n(lon, lat): an expression."""
    grid = control.control_grid(pixels, frame, model, window.times(pixels.sparkSession), settings)
    nodes = grid["nodes"]
    at = gridcells.geometry(nodes, mdt, x, y, "node_id").select("node_id", "kind", F.when(F.col("kind") == gridcells.TYPE_4, F.col("value")).alias("mdt"))
    known = nodes.drop("offset").join(at, "node_id").withColumn("dn", delta_n(F.col("lon"), F.col("lat"))).withColumn("total", F.col("mdt") + F.col("dn"))
    diagnosis = stored_table(products.node_diagnosis(grid | {"nodes": known}, F.col("mdt"), F.col("dn"), F.col("total")).join(known.select("node_id", "lon", "lat", "kind", "mdt"), "node_id"), "diagnosis")
    bare = diagnosis.where(F.col("class") == metrics.NO_MDT)
    product = products.inundation_of(grid, pixels, frame, settings)
    placed = cells.membership(frame.centers(pixels.where(F.col("z").isNotNull())).withColumn("pixel", F.col("row").cast("long") * frame.width + F.col("col")), grid["cells"], "pixel", *frame.bounds[2:], max(frame.steps(settings.least_m)), carry=("row", "col"))
    qc = product.where("qc <> 65535").join(placed.select("row", "col", "cell_id"), ["row", "col"], "left").select("cell_id", "qc")
    step = timegrid.step_seconds(window.freq)
    every = grid["tide"].select("node_id", "t", "level")
    second = every.where((timegrid.seconds(F.col("t")) - window.seconds()[0]) % (2 * step) == 0)
    results = {
        "classes": metrics.class_counts(diagnosis.select(F.col("low").alias("level"), "class")), "geometry": bare.groupBy("kind").agg(F.count("*").alias("n")), "triangle": triangle_truth(mdt, x, y, diagnosis, "node_id"),
        "holdout": holdout(diagnosis, "node_id", "mdt", F.pmod(F.xxhash64("node_id"), F.lit(5)) == 0), "causes": attribute(qc, grid["cells"], diagnosis), "sensitivity": sensitivity(every, second, "node_id", "level", quantiles),
    }
    return results | {"register": evidence(results, folder)}

"""Cache bundles: nodes, cells, tide and terminal tables with one row of tags, complete only when its marker is there.

    <path>/nodes, cells, tide (partitioned by node_bucket), terminal, meta, _COMPLETE
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA_VERSION, OLDER = "1.2", ("1.1",)
BUCKETS = 64
PARTS = ("nodes", "cells", "tide", "meta")
#: Tolerances of the comparison; tags that aren't here must be equal.
TOLERANCE = {"transform_a": 1e-4, "transform_b": 1e-4, "transform_c": 1e-4, "transform_d": 1e-4, "transform_e": 1e-4, "transform_f": 1e-4, "initial_spacing_m": 1.0, "min_spacing_m": 1.0, "tolerance_pct": 1e-3, "topology_resolution_m": 1e-3, "topology_fraction": 1e-4}
#: Tags that are compared only where the stored one is over 0.
OPTIONAL = ("dem_bytes", "dem_mtime")


class IncompleteBundle(ValueError):
    pass


class ExistingOutput(ValueError):
    pass


def signature(tags: dict, separators=(",", ":")) -> str:
    """SHA-256 of the sorted tags as canonical JSON."""
    return hashlib.sha256(json.dumps(tags, sort_keys=True, separators=separators, ensure_ascii=False).encode()).hexdigest()


def signature_column(tags: Column) -> Column:
    """signature() of a column of map<string, string>, for many bundles at once."""
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    pairs = F.transform(F.array_sort(F.map_keys(tags)), lambda k: F.concat(text(k), F.lit(":"), text(F.element_at(tags, k))))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")), 256)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_bundle(path: str, nodes: DataFrame, cells: DataFrame, tide: DataFrame, tags: dict, terminal: DataFrame | None = None, overwrite: bool = False) -> None:
    """Writes all parts, then the tags with their signature, then the marker; beside a bundle that is to be replaced, which stays as it is
    until its successor is complete."""
    spark, target = nodes.sparkSession, path
    replace = exists(spark, path)
    if replace:
        if not overwrite:
            raise ExistingOutput(path)
        path = f"{path}.new-{uuid.uuid4().hex}"
    bucket = F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int")
    nodes.write.parquet(f"{path}/nodes")
    cells.write.parquet(f"{path}/cells")
    tide.withColumn("node_bucket", bucket).repartition("node_bucket").sortWithinPartitions("node_id", "t").write.partitionBy("node_bucket").parquet(f"{path}/tide")
    tags = {k: str(v) for k, v in tags.items()} | {"schema_version": SCHEMA_VERSION, "terminal": str(terminal is not None).lower()}
    if terminal is not None:
        terminal.write.parquet(f"{path}/terminal")
    spark.createDataFrame([(tags | {"signature": signature(tags)},)], "tags map<string,string>").coalesce(1).write.parquet(f"{path}/meta")
    fs, p = _fs(spark, f"{path}/_COMPLETE")
    fs.create(p, False).close()
    if replace:
        swap(spark, path, target)


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Puts a folder in the place of another, which is deleted last."""
    fs, a = _fs(spark, new)
    b, old = _fs(spark, target)[1], _fs(spark, f"{target}.old-{uuid.uuid4().hex}")[1]
    if fs.exists(b) and not fs.rename(b, old):
        raise OSError(f"can't move {target}")
    if not fs.rename(a, b):
        fs.rename(old, b)
        raise OSError(f"can't move {new}")
    fs.delete(old, True)


def tags_of(spark: SparkSession, path: str) -> dict:
    if not exists(spark, f"{path}/_COMPLETE"):
        raise IncompleteBundle(path)
    return dict(spark.read.parquet(f"{path}/meta").first()["tags"])


def read_bundle(spark: SparkSession, path: str, tide: bool = True) -> dict[str, DataFrame]:
    """The parts as tables; without tide only the structure is read."""
    tags = tags_of(spark, path)
    out = {p: spark.read.parquet(f"{path}/{p}") for p in ("nodes", "cells")}
    if tide:
        out["tide"] = spark.read.parquet(f"{path}/tide")
        if tags.get("terminal") == "true":
            out["terminal"] = spark.read.parquet(f"{path}/terminal")
    return out


def read_levels(spark: SparkSession, path: str, node_ids: list[int], start=None, end=None) -> DataFrame:
    """Levels of some nodes within a time slice; only their buckets are read."""
    known = spark.read.parquet(f"{path}/nodes").where(F.col("node_id").isin(node_ids)).count()
    if known != len(set(node_ids)):
        raise IndexError(f"{len(set(node_ids)) - known} of the nodes aren't in {path}")
    if start is not None and end is not None and not start < end:
        raise IndexError("the time slice is empty")
    ids = spark.createDataFrame([(i,) for i in node_ids], "node_id long").withColumn("b", F.pmod(F.xxhash64("node_id"), F.lit(BUCKETS)).cast("int"))
    buckets = [r.b for r in ids.select("b").distinct().collect()]
    df = spark.read.parquet(f"{path}/tide").where(F.col("node_bucket").isin(buckets)).where(F.col("node_id").isin(node_ids))
    df = df if start is None else df.where(F.col("t") >= F.lit(start))
    return (df if end is None else df.where(F.col("t") < F.lit(end))).drop("node_bucket")


def sorted_levels(parts: dict[str, DataFrame]) -> DataFrame:
    """node_id, levels: each valid node's finite water levels (with its offset), sorted, for frequencies."""
    from shoreline.operators.frequency import packed

    off = parts["nodes"].where("valid").select("node_id", F.col("offset").cast("float").alias("offset"))
    return packed(parts["tide"].join(off, "node_id").withColumn("level", F.col("level") + F.col("offset")), "node_id", "level")


def inspect(spark: SparkSession, path: str) -> dict:
    """The tags of a complete bundle, its numbers of nodes and cells, and whether its signature is that of its tags."""
    tags = tags_of(spark, path)
    own = {k: v for k, v in tags.items() if k != "signature"}
    return tags | {"num_nodes": spark.read.parquet(f"{path}/nodes").count(), "num_cells": spark.read.parquet(f"{path}/cells").count(), "signed": signature(own) == tags.get("signature")}


def validate(spark: SparkSession, path: str) -> list[str]:
    """Every defect found; none for a sound bundle."""
    try:
        tags = tags_of(spark, path)
    except IncompleteBundle:
        return ["incomplete"]
    bad = [f"missing {p}" for p in PARTS if not exists(spark, f"{path}/{p}")]
    if bad:
        return bad
    parts = read_bundle(spark, path)
    need = {"nodes": {"node_id", "x", "y", "valid", "component_id", "qc"}, "cells": {"cell_id", "x_min", "y_min", "x_max", "y_max", "corners"}, "tide": {"node_id", "t", "level"}}
    bad += [f"{p} lacks {c}" for p, cols in need.items() for c in sorted(cols - set(parts[p].columns))]
    if bad:
        return bad
    own = {k: v for k, v in tags.items() if k != "signature"}
    if signature(own) != tags.get("signature"):
        bad.append("signature")
    if tags["schema_version"] not in (SCHEMA_VERSION, *OLDER):
        bad.append("schema version")
    if (tags.get("terminal") == "true") != exists(spark, f"{path}/terminal"):
        bad.append("terminal flag")
    if parts["cells"].where(F.size("corners") != 4).limit(1).count():
        bad.append("corners")
    if parts["cells"].select(F.explode("corners").alias("node_id")).join(parts["nodes"], "node_id", "left_anti").limit(1).count():
        bad.append("corner names no node")
    if parts["tide"].join(parts["nodes"], "node_id", "left_anti").limit(1).count():
        bad.append("level of no node")
    times = parts["tide"].groupBy("node_id").agg(F.count("*").alias("n"), F.countDistinct("t").alias("d"), F.min("t").alias("a"), F.max("t").alias("z"))
    shape = times.agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.bool_and(F.col("n") == F.col("d")).alias("u"), F.countDistinct("a", "z").alias("s")).first()
    if shape.n0 is not None and (shape.n0 != shape.n1 or not shape.u or shape.s != 1):
        bad.append("time axis")
    if "time_samples" in tags and shape.n1 is not None and int(tags["time_samples"]) != shape.n1:
        bad.append("time_samples")
    if "step_s" in tags:
        w = Window.partitionBy("node_id").orderBy("t")
        dt = (F.unix_micros("t") - F.lag(F.unix_micros("t")).over(w)) / F.lit(1e6)
        if parts["tide"].withColumn("dt", dt).where(F.abs(F.col("dt") - float(tags["step_s"])) > 1e-3).limit(1).count():
            bad.append("cadence")
    return bad


def incompatible(expected: dict, stored: dict) -> list[str]:
    """All tags by which a stored bundle doesn't fit, in order."""
    out = []
    for k, want in sorted(expected.items()):
        have = stored.get(k)
        if have is None:
            if k not in OPTIONAL:
                out.append(f"{k}: missing")
            continue
        if k in OPTIONAL and float(have) <= 0:
            continue
        if k == "crs":
            same = str(want) == have or str(want).rsplit(":", 1)[-1] == have.rsplit(":", 1)[-1]
        else:
            same = abs(float(want) - float(have)) <= TOLERANCE[k] if k in TOLERANCE else str(want) == have
        if not same:
            out.append(f"{k}: {have} instead of {want}")
    return out


def incompatible_table(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """The same over many bundles: (id, key, value) tables; id and its sorted reasons. A stored `signature` must be that of the other stored tags."""
    tol = F.create_map(*(F.lit(x) for kv in TOLERANCE.items() for x in kv))
    own = stored.where("key <> 'signature'").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tags"))
    forged = stored.where("key = 'signature'").join(own, "id").where(signature_column(F.col("tags")) != F.col("value")).select("id", F.lit("signature").alias("key"))
    j = expected.where("key <> 'signature'").select("id", "key", F.col("value").alias("want")).join(stored.select("id", "key", F.col("value").alias("have")), ["id", "key"], "left")
    t, want, have, optional = F.try_element_at(tol, F.col("key")), F.col("want"), F.col("have"), F.col("key").isin(*OPTIONAL)
    tail = lambda c: F.substring_index(c, ":", -1)
    same = F.when(t.isNotNull(), F.abs(want.try_cast("double") - have.try_cast("double")) <= t).when(F.col("key") == "crs", (want == have) | (tail(want) == tail(have))).otherwise(want == have)
    passed = optional & (have.isNull() | (F.coalesce(have.try_cast("double"), F.lit(1.0)) <= 0))
    bad = j.where(~passed & ~F.coalesce(same, F.lit(False))).select("id", "key").unionByName(forged)
    return bad.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("reasons"))

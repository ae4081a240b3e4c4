"""Products: a table of pixels with one row of tags, put in place only when it is whole; manifests; points and settings as files."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.sources.bundle import ExistingOutput, _fs, exists, swap
from shoreline.sources.tables import freed, stored

#: The products of an exposure run: measure -> (name, type, value where there is none).
EXPOSURE = {
    "fraction": ("exposure_fraction", "float", float("nan")), "exposed_h": ("exposure_duration_h", "float", float("nan")), "max_h": ("exposure_max_continuous_h", "float", float("nan")),
    "mean_h": ("exposure_mean_event_h", "float", float("nan")), "events": ("exposure_event_count", "long", 4294967295), "valid_time": ("exposure_valid_time_fraction", "float", float("nan")),
    "qc": ("exposure_qc", "int", 65535),
}


def write_product(df: DataFrame, path: str, tags: dict, overwrite: bool = False) -> None:
    """<path>/data and <path>/tags. An existing product is an error, or is replaced by a whole one."""
    spark = df.sparkSession
    there = exists(spark, path)
    if there and not overwrite:
        raise ExistingOutput(path)
    new = f"{path}.new-{uuid.uuid4().hex}"
    try:
        df.write.parquet(f"{new}/data")
        spark.createDataFrame([({k: str(v) for k, v in tags.items()},)], "tags map<string,string>").coalesce(1).write.parquet(f"{new}/tags")
        swap(spark, new, path)
    finally:
        fs, p = _fs(spark, new)
        fs.delete(p, True)


def read_product(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data"), dict(spark.read.parquet(f"{path}/tags").first()["tags"])


def write_exposure(measures: DataFrame, folder: str, name: str, tags: dict, overwrite: bool = False) -> dict[str, str]:
    """The seven products of plans.blocks.exposures() with row and col: paths by measure. None is written if one of them exists already."""
    spark = measures.sparkSession
    paths = {m: f"{folder}/{name}_{n}" for m, (n, _, _) in EXPOSURE.items()}
    if not overwrite and (found := [p for p in paths.values() if exists(spark, p)]):
        raise ExistingOutput(", ".join(found))
    measures = stored(measures, "measures")  # computed once for all seven
    for m, (_, kind, none) in EXPOSURE.items():
        write_product(measures.select("row", "col", F.coalesce(F.col(m).cast(kind), F.lit(none).cast(kind)).alias("value")), paths[m], tags | {"nodata": none, "dtype": kind}, overwrite)
    freed(measures)
    return paths


def export_product(spark: SparkSession, path: str, output: str, overwrite: bool = False, block: int = 2048, tile: int = 256) -> DataFrame:
    """Writes a product as GeoTIFF files (see sources.geotiff) on the raster that its tags name, with all of them; gives the index of the files."""
    from shoreline.sources.geotiff import write_raster
    from shoreline.sources.rasters import Frame

    data, tags = read_product(spark, path)
    a, b, c, d, e, f = (float(tags[f"transform_{k}"]) for k in "abcdef")
    if b or d:
        raise ValueError(f"{path}: the raster is turned")
    code = int(tags["crs"].rsplit(":", 1)[-1]) if ":" in tags["crs"] else 0
    frame = Frame(c, f, a, e, int(tags["width"]), int(tags["height"]), tags["crs"], tags.get("unit", "degree" if 4000 <= code < 5000 else "metre"))
    kind = {"long": "uint32", "int": "uint16", "double": "float64"}.get(tags.get("dtype"), tags.get("dtype", "float32"))
    return write_raster(data, frame, output, "value", "float32" if kind == "float" else kind, float(tags.get("nodata", "nan")), tags, block, tile, overwrite)


def verified(spark: SparkSession, path: str, expected: dict, signature: str | None = None) -> list[str]:
    """What is wrong with a product: missing, or other tags than expected (numbers to 1e-5), or of another cache."""
    if not exists(spark, f"{path}/tags") or not exists(spark, f"{path}/data"):
        return ["missing"]
    _, tags = read_product(spark, path)
    out = []
    for k, want in sorted(expected.items()):
        have = tags.get(k)
        try:
            same = have is not None and abs(float(want) - float(have)) <= 1e-5
        except ValueError:
            same = str(want) == have
        if not same:
            out.append(k)
    if signature is not None and tags.get("cache_signature") != signature:
        out.append("cache_signature")
    return out


# ---------------------------------------------------------------- manifests


def save_manifest(manifest: DataFrame, folder: str) -> None:
    """manifest.json and manifest.csv, each put in place when it is whole."""
    spark = manifest.sparkSession
    for kind, write in (("json", lambda p: manifest.coalesce(1).write.json(p)), ("csv", lambda p: manifest.coalesce(1).write.option("header", True).csv(p))):
        new = f"{folder}/manifest.{kind}.new-{uuid.uuid4().hex}"
        write(new)
        swap(spark, new, f"{folder}/manifest.{kind}")


def load_manifest(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """The records of a folder, from its JSON or, where that is missing or unreadable, its CSV; none at all is an empty table. Fields that
    no record has are empty text, and further ones stay."""
    found = None
    for kind in ("json", "csv"):
        if not exists(spark, f"{folder}/manifest.{kind}"):
            continue
        reader = spark.read.option("mode", "FAILFAST")
        try:
            found = reader.json(f"{folder}/manifest.json", primitivesAsString=True) if kind == "json" else reader.option("header", True).csv(f"{folder}/manifest.csv")
            found.foreach(lambda _: None)
        except Exception:  # a damaged file: the other one may be whole
            found = None
            continue
        break
    if found is None or not found.columns:
        return spark.createDataFrame([], ", ".join(f"`{f}` string" for f in fields))
    found = found.select(*found.columns, *(F.lit("").alias(f) for f in fields if f not in found.columns))
    return found.na.fill("")


# ---------------------------------------------------------------- settings and points


def load_settings(path: str, root: str | None = None) -> dict:
    """A JSON or YAML file; its values under `paths` are absolute, relative ones from `root` (the file's folder)."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    root = root or os.path.dirname(os.path.abspath(path))
    return found | {"paths": {k: resolved(v, root) for k, v in found.get("paths", {}).items()}}


def resolved(path: str, *roots: str) -> str:
    """An absolute path, or the first of the roots under which a relative one exists, else under the first root."""
    if not path or os.path.isabs(path) or "://" in path:
        return path
    found = [os.path.join(r, path) for r in roots]
    return os.path.normpath(next((p for p in found if os.path.exists(p)), found[0]))


def save_settings(settings: dict, path: str, root: str | None = None) -> None:
    """Writes JSON with paths below `root` as relative ones; in place when whole."""
    root = root or os.path.dirname(os.path.abspath(path))
    short = lambda v: os.path.relpath(v, root) if os.path.isabs(v) and os.path.commonpath([root, v]) == root else v
    new = f"{path}.new-{uuid.uuid4().hex}"
    with open(new, "w", encoding="utf-8") as f:
        json.dump(settings | {"paths": {k: short(v) for k, v in settings.get("paths", {}).items()}}, f, indent=1, sort_keys=True)
    os.replace(new, path)


def availability(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, path, exists, bytes of configured sources."""
    rows = []
    for name, path in paths.items():
        there = bool(path) and exists(spark, path)
        fs, p = _fs(spark, path) if there else (None, None)
        rows.append((name, path, there, fs.getContentSummary(p).getLength() if there else 0))
    return spark.createDataFrame(rows, "name string, path string, exists boolean, bytes long")


def environment(spark: SparkSession) -> DataFrame:
    """One row of versions: what a run's provenance names."""
    import platform

    import numpy
    import pyarrow

    return spark.createDataFrame([(platform.platform(), platform.python_version(), spark.version, pyarrow.__version__, numpy.__version__)], "platform string, python string, spark string, arrow string, numpy string")


def hashed_files(spark: SparkSession, folder: str) -> DataFrame:
    """relative, bytes, sha256 of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}/", "")
    return files.select(relative.alias("relative"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

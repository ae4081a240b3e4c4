"""Tables in the shared folder, raster windows and files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; on a cluster that is an error, since
    every executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shoreline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is there when the session stops is deleted."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_scratch"):
        spark._scratch, stop = set(), spark.stop

        def stop_and_clean():
            try:
                for left in sorted(spark._scratch):
                    release(spark, left)
            finally:
                stop()

        spark.stop = stop_and_clean
    spark._scratch.add(path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Deletes a path that scratch() gave."""
    p, fs = _path(spark, path)
    fs.delete(p, True)
    spark._scratch.discard(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a table in the shared folder, which any executor can read after another is lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)  # for a driver that ends without stop()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and that nothing reads any more."""
    for t in tables:
        release(t.sparkSession, t.scratch_path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, to be broadcast if it has at most so many rows, and joined by a shuffle if it has more."""
    return F.broadcast(df) if df.count() <= rows else df


def windows(spark: SparkSession, width: int, height: int, block: int) -> DataFrame:
    """row, col, h, w of the blocks of a raster; blocks are at least 64 pixels."""
    block = max(64, block)
    rows = spark.range(0, height, block).select(F.col("id").alias("row"))
    cols = spark.range(0, width, block).select(F.col("id").alias("col"))
    return rows.crossJoin(F.broadcast(cols)).select("row", "col", F.least(F.lit(block), height - F.col("row")).alias("h"), F.least(F.lit(block), width - F.col("col")).alias("w"))


def windows_of(headers: DataFrame, block: int) -> DataFrame:
    """raster_id, row, col, h, w of the blocks of each raster of a table with raster_id, width and height; one without pixels has none."""
    block = max(64, block)
    w, h = F.col("width").cast("long"), F.col("height").cast("long")
    starts = lambda n: F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1, F.lit(block).cast("long"))))
    rows = headers.select("raster_id", w.alias("width"), h.alias("height"), starts(h).alias("row"))
    rows = rows.select("*", starts(F.col("width")).alias("col"))
    return rows.select("raster_id", "row", "col", F.least(F.lit(block).cast("long"), F.col("height") - F.col("row")).alias("h"), F.least(F.lit(block).cast("long"), F.col("width") - F.col("col")).alias("w"))


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    """Tiles (raster_id, r_off, c_off, w, data array) as pixels (raster_id, row, col, z)."""
    p = tiles.select("raster_id", "r_off", "c_off", "w", F.posexplode("data").alias("k", "z"))
    return p.select("raster_id", (F.col("r_off") + F.expr("k div w")).cast("int").alias("row"), (F.col("c_off") + F.col("k") % F.col("w")).cast("int").alias("col"), "z")


#: Names that are products or temporary.
SKIP_RASTER, SKIP_CONVERSION = r"(?i)(_qc|_inundation|_exposure|\.tmp)\.[a-z]+$|_exposure_[^/]*$|_snapshot[^/]*$", r"(?i)(_msl|_qc|\.tmp)\.[a-z]+$"


def discover(spark: SparkSession, folder: str, recursive: bool = True, conversion: bool = False, output: str | None = None) -> DataFrame:
    """path, relative, bytes, modified of the rasters under a folder but not under `output`, in order of the lower-cased relative path
    (conversion: of the path)."""
    ends = r"(?i)\.(tif|tiff|geotiff)$" if conversion else r"(?i)\.(tif|tiff)$"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), f"^{base}/", "")
    out = files.select("path", rel.alias("relative"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    out = out.where(F.col("relative").rlike(ends) & ~F.col("relative").rlike(SKIP_CONVERSION if conversion else SKIP_RASTER))
    if output is not None:
        own = output.rstrip("/").split("://")[-1].removeprefix("file:") + "/"
        out = out.where(~F.regexp_replace("path", "^[a-z0-9]+:/*", "/").startswith(own))
    return out.orderBy("path") if conversion else out.orderBy(F.lower("relative"), "relative")


def discovered_headers(files: DataFrame, headers: DataFrame) -> DataFrame:
    """The files of discover() with their headers, valid and error; a file without a header can't be read."""
    from shoreline.sources.rasters import checked

    h = checked(headers).drop("bytes", "modified", "relative")
    j = files.join(h, "path", "left")
    return j.withColumns({"valid": F.coalesce("valid", F.lit(False)), "error": F.coalesce("error", F.lit("no header"))})


def read_points(spark: SparkSession, path: str, typed: bool = False) -> DataFrame:
    """A CSV of points with all its columns, as text, or typed by a look at all rows."""
    return spark.read.option("header", True).option("inferSchema", typed).option("encoding", "UTF-8").csv(path)


def head(spark: SparkSession, path: str, rows: int = 5) -> list:
    """The first rows of a CSV, for choosing its columns."""
    return read_points(spark, path).limit(rows).collect()


def export_table(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One local CSV with a byte order mark, or an .xlsx sheet, for spreadsheets; at most `most` rows, which come to the driver."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: use write_csv")
    if path.endswith(".xlsx"):
        rows.to_excel(path, index=False)
    else:
        rows.to_csv(path, index=False, encoding="utf-8-sig")


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)

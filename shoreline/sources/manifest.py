"""Manifests: one record a file, the last write wins; what a resumed run may skip; whether a scan is still true."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States of a file.
STATES = ("PENDING", "RUNNING", "SUCCESS", "FAILED", "SKIPPED", "SKIPPED_MSL", "CANCELLED")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each key, that of the highest order; unknown fields stay, missing ones are empty."""
    both = old.unionByName(new, allowMissingColumns=True)
    last = both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")
    return last.na.fill("")


def lookup(manifest: DataFrame, key: str, value: str) -> DataFrame:
    return manifest.where(F.col(key) == value)


def entry(manifest: DataFrame, key: str, value: str) -> dict | None:
    """The record of one file, or None."""
    row = lookup(manifest, key, value).first()
    return row.asDict() if row else None


def status_of(manifest: DataFrame, key: str, value: str) -> str:
    found = entry(manifest, key, value)
    return found["status"] if found else "PENDING"


def is_success(manifest: DataFrame, key: str, value: str) -> bool:
    return status_of(manifest, key, value) == "SUCCESS"


def skippable(inputs: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Keys whose record is a success of the same signature, size and time."""
    done = manifest.where(F.col("status") == "SUCCESS")
    return inputs.join(done.select(key, "signature", "bytes", "modified"), [key, "signature", "bytes", "modified"], "left_semi").select(key)


def stale(snapshot: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """key, why of files that went, came or changed since the scan; must be empty before a run."""
    a = snapshot.select(key, F.struct("bytes", "modified").alias("a"))
    b = files.select(key, F.struct("bytes", "modified").alias("b"))
    why = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full_outer").select(key, why.alias("why")).where("why is not null")


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def already_msl(tags) -> object:
    """Whether any of three tags says that heights are over mean sea level."""
    says = lambda k, v: F.upper(F.trim(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))) == v
    return says("DATUM", "MSL") | says("ANALYSIS_REFERENCE", "MSL") | says("TARGET_VERTICAL_DATUM", "MSL")

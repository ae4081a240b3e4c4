"""What a batch run does with a tile: job modes, policies and the state machine of a tile."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoreline.plans import conversion
from shoreline.plans import products as plans
from shoreline.sources import bundle, manifest, products, rasters

#: Job modes and what they make.
MODES = {
    "build-cache": ("cache",), "inundation": ("cache", "inundation"), "exposure": ("cache", "exposure"), "full": ("cache", "inundation", "exposure"),
    "inundation-from-cache": ("inundation",), "exposure-from-cache": ("exposure",),
}
#: Policies and their other names.
POLICIES = {"error": "ERROR_IF_EXISTS", "error_if_exists": "ERROR_IF_EXISTS", "resume": "RESUME", "skip": "RESUME", "overwrite": "OVERWRITE", "force": "OVERWRITE"}


def mode_of(name: str) -> tuple[str, ...]:
    key = name.lower().replace("_", "-")
    if key not in MODES:
        raise ValueError(f"unknown job mode {name!r}")
    return MODES[key]


def policy_of(name: str | None = None, resume: bool = False, overwrite: bool = False) -> str:
    if resume and overwrite:
        raise ValueError("resume and overwrite exclude each other")
    if resume or overwrite:
        return "RESUME" if resume else "OVERWRITE"
    try:
        return POLICIES[(name or "error").lower()]
    except KeyError:
        raise ValueError(f"unknown policy {name!r}") from None


def action(policy: str, from_cache: bool, cache_exists: Column, cache_fits: Column, products_exist: Column, products_sound: Column) -> Column:
    """What happens to a tile: SKIPPED, FAILED, FROM_CACHE or RUN. A complete cache of other parameters fails a resumed tile, it
    isn't computed anew; a mode that starts from a cache never runs the tide model."""
    bad_cache = F.when(from_cache & ~(cache_exists & cache_fits), "FAILED") if isinstance(from_cache, Column) else (F.when(~(cache_exists & cache_fits), "FAILED") if from_cache else F.when(F.lit(False), "FAILED"))
    go = F.when(cache_exists & cache_fits, "FROM_CACHE").otherwise("RUN")
    if policy == "RESUME":
        return bad_cache.when(cache_exists & ~cache_fits, "FAILED").when(cache_exists & cache_fits & products_exist & products_sound, "SKIPPED").otherwise(go)
    if policy == "OVERWRITE":
        return bad_cache.otherwise("FROM_CACHE" if from_cache else "RUN")
    return bad_cache.when(products_exist | (F.lit(not from_cache) & cache_exists), "FAILED").otherwise(go)


def output_name(path: Column, suffix: str = "_MSL") -> Column:
    """The file name with a suffix before its ending, in the same subfolder."""
    return F.regexp_replace(path, r"\.([A-Za-z]+)$", f"{suffix}.$1")


# ---------------------------------------------------------------- runs over many rasters

#: Fields of a record of a run.
FIELDS = ("path", "status", "action", "error", "mode", "policy", "cache_signature", "nodes", "products")
#: What identifies a conversion.
CONVERSION = {"source_datum": "EGM2008", "target_datum": "MSL", "mdt_model": "CNES-CLS22", "mdt_method": "bilinear_native_plus_spherical_knn_idw", "idw_power": 2.0, "idw_k": 8, "deltan_source": "GOCO06s/EIGEN-6C4", "schema_version": "1.7.1"}


class ScanStale(RuntimeError):
    """Files changed after the scan that a run was planned on."""


def check_snapshot(scan: DataFrame, files: DataFrame) -> None:
    if found := manifest.stale(scan, files).limit(20).collect():
        raise ScanStale("; ".join(f"{r.path}: {r.why}" for r in found))


def paths_of(folder: str, relative: str) -> dict[str, str]:
    """Where a raster's cache and products go: in the same subfolder of the output folder."""
    base = f"{folder}/{re.sub(r'\.[A-Za-z]+$', '', relative)}"
    return {"cache": f"{base}_tide", "inundation": f"{base}_inundation", "exposure": base}


def _sound(spark, paths: dict, needs: tuple, frame, signature: str) -> bool:
    """Whether all products of a mode exist, fit the raster and come from the cache."""
    found = []
    if "inundation" in needs:
        found.append(products.verified(spark, paths["inundation"], frame.tags(), signature))
    if "exposure" in needs:
        found += [products.verified(spark, f"{paths['exposure']}_{name}", frame.tags() | {"dtype": kind}, signature) for name, kind, _ in products.EXPOSURE.values()]
    return not any(found)


def _exist(spark, paths: dict, needs: tuple) -> list[str]:
    out = [paths[n] for n in ("cache", "inundation") if n in needs] + [f"{paths['exposure']}_{name}" for name, _, _ in products.EXPOSURE.values() if "exposure" in needs]
    return [p for p in out if bundle.exists(spark, p)]


def run_rasters(spark, headers: list, pixels_of, folder: str, model, window, settings, mode: str = "full", policy: str | None = None, cancelled=lambda: False, **tags) -> list[dict]:
    """Works on one raster after the other and gives a record for each; a raster that fails doesn't stop the others, and the manifest in `folder` is
    written after each. headers: rows of sources.rasters; pixels_of(header) gives row, col, z.

    A resumed raster is skipped only if its cache fits and its products are sound; a complete cache of other parameters fails it. A mode that starts
    from a cache never runs the tide model and asks only that the cache be of this raster."""
    needs, how = mode_of(mode), policy_of(policy)
    from_cache = mode.lower().replace("_", "-").endswith("from-cache")
    records = []
    for h in headers:
        record = {k: "" for k in FIELDS} | {"path": h["path"], "status": "RUNNING", "mode": mode, "policy": how}
        records.append(record)
        if cancelled():
            record |= {"status": "CANCELLED"}
            break
        try:
            record |= _run_one(spark, h, pixels_of, folder, model, window, settings, needs, how, from_cache, tags)
        except Exception as e:  # one raster's failure is its own
            record |= {"status": "FAILED", "action": "FAILED", "error": str(e).splitlines()[0][:500] if str(e) else type(e).__name__}
        products.save_manifest(spark.createDataFrame([tuple(str(r[k]) for k in FIELDS) for r in records], ", ".join(f"{k} string" for k in FIELDS)), folder)
    return records


def _run_one(spark, h, pixels_of, folder, model, window, settings, needs, how, from_cache, tags) -> dict:
    frame = rasters.frame_of(h)
    paths = paths_of(folder, h["relative"] if "relative" in h else h["path"].rsplit("/", 1)[-1])
    whole = bundle.exists(spark, f"{paths['cache']}/_COMPLETE")
    fits, signature = False, ""
    if whole:
        stored = bundle.tags_of(spark, paths["cache"])
        expected = frame.tags() | {"dem_bytes": h["bytes"], "dem_mtime": h["modified"]}
        if not from_cache:
            expected |= plans.expected_tags(frame, window, settings, size=h["bytes"], modified=h["modified"], **tags)
        why = bundle.incompatible(expected, stored)
        fits, signature = not why, stored["signature"]
        if why and (from_cache or how == "RESUME"):
            raise ValueError(f"the existing cache is of other parameters: {'; '.join(why)}")
    elif from_cache:
        raise ValueError(f"{paths['cache']}: no complete cache to start from")
    if how == "ERROR_IF_EXISTS" and (found := _exist(spark, paths, needs)):
        raise bundle.ExistingOutput(", ".join(found))
    if how == "RESUME" and fits and _sound(spark, paths, needs, frame, signature):
        return {"status": "DONE", "action": "SKIPPED_EXISTING", "cache_signature": signature}
    pixels = rasters.masked_pixels(pixels_of(h), frame.nodata)
    if "cache" in needs and not (how == "RESUME" and fits):
        signature = plans.build_cache(paths["cache"], pixels, frame, model, window, settings, overwrite=whole or bundle.exists(spark, paths["cache"]), size=h["bytes"], modified=h["modified"], **tags)["signature"]
    made = frame.tags() | {"cache_signature": signature}
    if "inundation" in needs:
        products.write_product(plans.inundation_from_cache(pixels, frame, paths["cache"]), paths["inundation"], made | {"dtype": "float", "nodata": rasters.output_nodata(frame.nodata)}, overwrite=how != "ERROR_IF_EXISTS")
    if "exposure" in needs:
        products.write_exposure(plans.exposure_from_cache(pixels, frame, paths["cache"]), paths["exposure"].rsplit("/", 1)[0], paths["exposure"].rsplit("/", 1)[1], made, overwrite=how != "ERROR_IF_EXISTS")
    return {"status": "DONE", "action": "RECOMPUTED" if how == "OVERWRITE" else "COMPUTED", "cache_signature": signature, "nodes": bundle.tags_of(spark, paths["cache"]).get("nodes", ""), "products": ",".join(needs)}


def conversion_signature(cutoff_km: float, **other) -> str:
    """What a conversion depends on, as one name; numbers to four places."""
    tags = CONVERSION | {"max_extrapolation_distance_km": cutoff_km} | other
    tags = {k: round(float(v), 4) if isinstance(v, float) else v for k, v in tags.items()}
    return bundle.signature(tags | {"max_extrapolation_distance_km": round(float(tags["max_extrapolation_distance_km"]), 4)}, (", ", ": "))


def resumable(spark, h, entry: dict | None, path: str, signature: str, cutoff_km: float, qc_path: str | None = None) -> tuple[bool, str]:
    """Whether a converted raster can be kept, and else why not."""
    if not entry or entry.get("status") != "SUCCESS":
        return False, "no success on record"
    if not entry.get("signature") or entry["signature"] != signature:
        return False, "other parameters"
    try:
        if entry.get("cutoff_km", "") != "" and abs(float(entry["cutoff_km"]) - cutoff_km) > 1e-3:
            return False, "another distance"
        if int(entry["bytes"]) != h["bytes"] or int(entry["modified"]) != h["modified"]:
            return False, "the input changed"
    except (KeyError, TypeError, ValueError):
        return False, "the record is incomplete"
    frame = rasters.frame_of(h)
    tags = frame.tags() | {"DATUM": "MSL", "TARGET_VERTICAL_DATUM": "MSL", "SOURCE_VERTICAL_DATUM": "EGM2008", "MAX_EXTRAPOLATION_DISTANCE_KM": cutoff_km}
    if why := products.verified(spark, path, tags):
        return False, f"the product: {', '.join(why)}"
    if qc_path and (why := products.verified(spark, qc_path, frame.tags() | {"dtype": "int"})):
        return False, f"the quality product: {', '.join(why)}"
    return True, ""


def run_conversions(spark, headers: list, tags_of, converted, folder: str, cutoff_km: float = 100.0, resume: bool = False, write_qc: bool = False) -> list[dict]:
    """Converts one raster after the other to mean sea level; one that already is, is skipped, and one that fails doesn't stop the others.
    tags_of(header) gives its tags; converted(header) gives row, col, z_msl, qc (plans.conversion)."""
    fields = ("path", "status", "reason", "signature", "cutoff_km", "bytes", "modified", "total", "native", "extrapolated", "nodata")
    old = {r["path"]: r.asDict() for r in products.load_manifest(spark, folder, list(fields)).collect()} if resume else {}
    signature, records = conversion_signature(cutoff_km), []
    for h in headers:
        name = h["relative"] if "relative" in h else h["path"].rsplit("/", 1)[-1]
        path = f"{folder}/{re.sub(r'\.[A-Za-z]+$', '', name)}_MSL"
        qc_path = f"{path}_qc" if write_qc else None
        record = {k: "" for k in fields} | {"path": h["path"], "signature": signature, "cutoff_km": cutoff_km, "bytes": h["bytes"], "modified": h["modified"]}
        try:
            tags = {k: str(v).strip().upper() for k, v in tags_of(h).items()}
            keep, why = resumable(spark, h, old.get(h["path"]), path, signature, cutoff_km, qc_path) if resume else (False, "")
            if "MSL" in (tags.get("DATUM"), tags.get("ANALYSIS_REFERENCE"), tags.get("TARGET_VERTICAL_DATUM")):
                record |= {"status": "SKIPPED_MSL"}
            elif keep:
                record |= old[h["path"]] | {"status": "SUCCESS", "reason": "kept"}
            else:
                out = converted(h)
                frame = rasters.frame_of(h)
                made = frame.tags() | {"DATUM": "MSL", "TARGET_VERTICAL_DATUM": "MSL", "SOURCE_VERTICAL_DATUM": "EGM2008", "MAX_EXTRAPOLATION_DISTANCE_KM": cutoff_km, "CONVERSION_SIGNATURE": signature}
                products.write_product(out, path, made | {"dtype": "float"}, overwrite=True)
                done, _ = products.read_product(spark, path)
                if qc_path:
                    products.write_product(done.select("row", "col", F.col("qc").cast("int").alias("value")), qc_path, made | {"dtype": "int", "nodata": 255}, overwrite=True)
                record |= {"status": "SUCCESS", "reason": why} | conversion.counts(done).first().asDict()
        except Exception as e:
            record |= {"status": "FAILED", "reason": str(e).splitlines()[0][:500] if str(e) else type(e).__name__}
        records.append(record)
        products.save_manifest(spark.createDataFrame([tuple(str(r[k]) for k in fields) for r in records], ", ".join(f"{k} string" for k in fields)), folder)
    return records

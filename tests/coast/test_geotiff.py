"""GeoTIFF files: what is written is read, and files of other forms, made here from the format's rules, are read too."""

import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoreline.plans import geoid
from shoreline.sources import geotiff
from shoreline.sources.bundle import ExistingOutput
from shoreline.sources.geotiff import NotATiff, Reader, decoded, fractional, headers, lzw, packbits, parse, read_grid, read_header, read_index, read_raster, tiff, write_raster
from shoreline.sources.rasters import Frame, frame_of
from shoreline.sources.tables import discover

FRAME = Frame(121.5, 31.25, 0.001, -0.001, 150, 90, nodata=-9999.0)


def values(height=90, width=150, seed=1):
    z = np.random.default_rng(seed).normal(size=(height, width))
    z[:5, :7] = np.nan
    return z


def pixels(spark, z):
    rows = [(r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "row int, col int, z double").repartition(5)


def grid_of(df, height, width, column="z"):
    out = np.full((height, width), np.nan)
    for x in df.collect():
        out[x.row, x.col] = math.nan if x[column] is None else x[column]
    return out


def image(z, order="<", compression=8, predictor=1, tile=None, rows=None, planar=1, big=False, extra=()):
    """A plain writer of TIFF files: z is bands x height x width."""
    bands, height, width = z.shape
    kind, unit = z.dtype.newbyteorder(order), z.dtype.itemsize
    blobs = []
    for plane in [z[k : k + 1] for k in range(bands)] if planar == 2 else [z]:
        th, tw = (tile, tile) if tile else (rows, width)
        for y in range(0, height, th):
            for x in range(0, width, tw):
                part = plane[:, y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, 0), (0, th - part.shape[1]), (0, tw - part.shape[2])))
                a = np.ascontiguousarray(part.transpose(1, 2, 0))
                if predictor == 2:
                    words = a.view(f"u{unit}")
                    a = np.concatenate((words[:, :1], np.diff(words.astype(np.uint64), axis=1).astype(words.dtype)), 1)
                    data = a.astype(a.dtype.newbyteorder(order)).tobytes()
                elif predictor == 3:
                    n = a.shape[1] * a.shape[2]
                    planes = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">")).reshape(a.shape[0], n)).view(np.uint8).reshape(a.shape[0], n, unit).transpose(0, 2, 1).reshape(a.shape[0], -1, a.shape[2])
                    data = np.concatenate((planes[:, :1], np.diff(planes.astype(np.int16), axis=1).astype(np.uint8)), 1).tobytes()
                else:
                    data = a.astype(kind).tobytes()
                if compression == 8:
                    data = zlib.compress(data)
                elif compression == 50000:
                    import zstandard

                    data = zstandard.compress(data)
                elif compression == 32773:
                    data = b"".join(bytes([len(data[k : k + 100]) - 1]) + data[k : k + 100] for k in range(0, len(data), 100))
                elif compression == 5:
                    data = lzw_of(data)
                blobs.append(data)
    word, code = ("Q", 16) if big else ("I", 4)
    form = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
    entries = {256: (4, "I", [width]), 257: (4, "I", [height]), 258: (3, "H", [8 * unit] * bands), 259: (3, "H", [compression]), 277: (3, "H", [bands]), 284: (3, "H", [planar]), 317: (3, "H", [predictor]), 339: (3, "H", [form] * bands)}
    entries |= {322: (4, "I", [tile]), 323: (4, "I", [tile]), 324: (code, word, [0] * len(blobs)), 325: (code, word, list(map(len, blobs)))} if tile else {278: (4, "I", [rows]), 273: (code, word, [0] * len(blobs)), 279: (code, word, list(map(len, blobs)))}
    entries |= dict(extra)
    step, room, start = (20, 8, 16) if big else (12, 4, 8)
    at = start + (8 if big else 2) + step * len(entries) + room
    size = at + sum(struct.calcsize(f"<{len(v)}{c}") + 8 for _, c, v in entries.values())
    places, where = [], size
    for b in blobs:
        places.append(where)
        where += len(b)
    tag = 324 if tile else 273
    entries[tag] = (*entries[tag][:2], places)
    fixed, more = b"", b""
    for t, (k, c, v) in sorted(entries.items()):
        data = struct.pack(f"{order}{len(v)}{c}", *v)
        fixed += struct.pack(order + "HH" + word, t, k, len(v)) + (data.ljust(room, b"\0") if len(data) <= room else struct.pack(order + word, at + len(more)))
        more += b"" if len(data) <= room else data
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 16) + struct.pack(order + "Q", len(entries)) if big else struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(entries)))
    return (head + fixed + struct.pack(order + word, 0) + more).ljust(size, b"\0") + b"".join(blobs)


def lzw_of(data):
    """An encoder after the format's rules."""
    bits = []
    put = lambda code, n: bits.extend((code >> (n - 1 - k)) & 1 for k in range(n))
    table, n, prefix = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    count = 258
    for k in range(len(data)):
        c = data[k : k + 1]
        if prefix + c in table:
            prefix += c
            continue
        put(table[prefix], n)
        table[prefix + c] = count
        count += 1
        n = 12 if count >= 2048 else 11 if count >= 1024 else 10 if count >= 512 else 9
        if count >= 4094:
            put(256, n)
            table, n, count = {bytes([k]): k for k in range(256)}, 9, 258
        prefix = c
    if prefix:
        put(table[prefix], n)
        count += 1
        n = 12 if count >= 2048 else 11 if count >= 1024 else 10 if count >= 512 else 9
    put(257, n)
    bits += [0] * (-len(bits) % 8)
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def plain(data, h):
    """All bands of a file, by the tiles alone."""
    out = np.zeros((h.bands, h.height, h.width))
    for n, (at, size) in enumerate(zip(h.offsets.tolist(), h.sizes.tolist(), strict=True)):
        band, n = divmod(n, h.across * h.down)
        y, x = divmod(n, h.across)
        rows = min(h.tile_height, h.height - y * h.tile_height) if h.strips else h.tile_height
        t = decoded(data[at : at + size], h, rows)
        part = out[band : band + 1] if h.planar else out
        part = part[:, y * h.tile_height : (y + 1) * h.tile_height, x * h.tile_width : (x + 1) * h.tile_width]
        part[:] = t[: part.shape[1], : part.shape[2]].transpose(2, 0, 1)
    return out


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("dtype", ["float32", "float64", "int16", "uint8", "int32", "uint16"])
def test_forms(order, dtype):
    r = np.random.default_rng(3)
    for bands, planar in ((1, 1), (3, 1), (2, 2)):
        z = (r.normal(size=(bands, 37, 53)) * 100).astype(dtype)
        for shape in ({"tile": 16}, {"rows": 10}, {"rows": 37}):
            for compression in (1, 5, 8, 32773, 50000):
                for predictor in (1, 2, 3) if dtype.startswith("float") else (1, 2):
                    for big in (False, True):
                        data = image(z, order, compression, predictor, planar=planar, big=big, **shape)
                        h = parse(lambda at, n, data=data: data[at : at + n])
                        assert (h.width, h.height, h.bands, np.dtype(h.dtype).name) == (53, 37, bands, dtype)
                        assert (plain(data, h) == z).all(), (bands, planar, shape, compression, predictor, big)
                    if compression == 5:
                        break


def test_codes():
    r = random.Random(2)
    for n in (0, 1, 300, 5000, 40_000):
        for letters in (2, 256):
            data = bytes(r.randrange(letters) for _ in range(n))
            assert lzw(lzw_of(data)) == data
    assert packbits(bytes([2, 65, 66, 67, 254, 68, 128, 0, 69])) == b"ABCDDDE"


def test_no_tiff(tmp_path):
    for data in (b"", b"II", b"II*\0" + b"\xff" * 4, b"PK\3\4" + b"\0" * 50):
        (tmp_path / "x.tif").write_bytes(data)
        with pytest.raises((NotATiff, struct.error)):
            read_header(str(tmp_path / "x.tif"))


def test_round_trip_and_window(spark, tmp_path):
    z, path = values(), f"file://{tmp_path}/terrain"
    index = write_raster(pixels(spark, z), FRAME, path, dtype="float64", nodata=-9999.0, tags={"MODEL": "a & b", "N": 3}, block=64, tile=32)
    assert index.count() == 6 and index.agg(F.sum("valid")).first()[0] == np.isfinite(z).sum()
    got = read_raster(spark, path)
    assert got.columns == ["raster_id", "band", "row", "col", "z"] and got.count() == z.size and {x.raster_id for x in got.select("raster_id").distinct().collect()} == {"terrain"}
    np.testing.assert_array_equal(grid_of(got, 90, 150), z)
    inner = read_raster(spark, path, bbox="121.54,31.18,121.5799,31.2101").where("row < 60 and col >= 45 and band = 1").collect()
    x, y = 121.5 + 0.001 * (np.arange(150) + 0.5), 31.25 - 0.001 * (np.arange(90) + 0.5)
    want = {(r, c) for r in range(60) for c in range(45, 150) if 121.54 <= x[c] <= 121.5799 and 31.18 <= y[r] <= 31.2101}
    assert {(p.row, p.col) for p in inner} == want and len(inner) == len(want) and all(p.z == z[p.row, p.col] for p in inner)
    h = read_header(f"{path}/block_00000_00001.tif")
    assert (h.crs, h.unit, h.nodata, h.tags, h.tile_width, h.compression, h.predictor) == ("EPSG:4326", "degree", -9999.0, {"MODEL": "a & b", "N": "3"}, 32, 8, 2)
    assert abs(h.c - (121.5 + 0.064)) < 1e-12 and "block_00001_00002.tif" in open(f"{tmp_path}/terrain/mosaic.vrt").read()


def test_only_tiles_of_the_window_are_opened(spark, tmp_path):
    """Planned tiles are counted, and all others may be spoilt."""
    z = values()
    data = bytearray(tiff(z.astype("float32"), 16, 0.001, -0.001, 121.5, 31.25, "EPSG:4326", "degree", math.nan, {}))
    h = parse(lambda at, n: bytes(data[at : at + n]))
    assert len(h.offsets) == 60 and h.across == 10
    reader = Reader({"path": str(tmp_path / "t.tif"), "window": "20,50,33,64"})
    wanted = {y * 10 + x for y in (1, 2, 3) for x in (2, 3)}
    for n, (at, size) in enumerate(zip(h.offsets.tolist(), h.sizes.tolist(), strict=True)):
        if n not in wanted:
            data[at : at + size] = b"\xff" * size
    (tmp_path / "t.tif").write_bytes(data)
    assert {t[0] for p in reader.partitions() for t in p.tiles} == wanted
    for got in (read_raster(spark, str(tmp_path / "t.tif"), window="20,50,33,64"), read_raster(spark, str(tmp_path / "t.tif")).where((F.col("row") >= 20) & (F.col("row") <= 49) & (F.col("col") > 32) & (F.col("col") < 64))):
        rows = got.collect()
        assert len(rows) == 30 * 31 and all(abs(x.z - z[x.row, x.col]) < 1e-6 for x in rows)
    with pytest.raises(Exception, match="zlib|decompress"):
        read_raster(spark, str(tmp_path / "t.tif")).count()


def test_bands(spark, tmp_path):
    z = np.random.default_rng(5).integers(0, 1000, (3, 40, 30)).astype("int16")
    for planar in (1, 2):
        path = tmp_path / f"bands{planar}.tif"
        path.write_bytes(image(z, tile=16, planar=planar, predictor=2))
        reader = Reader({"path": str(path), "bands": "2", "partition_bytes": 2048})
        assert sum(len(p.tiles) for p in reader.partitions()) == 6 and len(reader.partitions()) > 1
        for got in (read_raster(spark, str(path), bands="2"), read_raster(spark, str(path)).where("band = 2"), read_raster(spark, str(path)).where(F.col("band").isin(2))):
            assert {(x.row, x.col, x.z) for x in got.collect()} == {(r, c, float(z[1, r, c])) for r in range(40) for c in range(30)}


def test_a_folder_of_rasters(spark, tmp_path):
    os.makedirs(tmp_path / "in/sub")
    for name, seed, shape in (("a.tif", 1, (20, 30)), ("sub/b.TIFF", 2, (33, 17))):
        (tmp_path / "in" / name).write_bytes(tiff(values(*shape, seed).astype("float32"), 16, 2.0, -2.0, 5e5, 4e6, "EPSG:32651", "metre", math.nan, {"k": name}))
    (tmp_path / "in/broken.tif").write_bytes(b"II*\0\xff\xff\xff\xff")
    (tmp_path / "in/no.txt").write_text("no raster")
    found = {h.raster_id: h for h in headers(discover(spark, f"file://{tmp_path}/in")).collect()}
    assert set(found) == {"a.tif", "sub/b.TIFF", "broken.tif"} and found["broken.tif"].error and found["broken.tif"].width == 0
    assert frame_of(found["a.tif"]) == Frame(5e5, 4e6, 2.0, -2.0, 30, 20, "EPSG:32651", "metre", None)
    assert found["a.tif"].tags == {"k": "a.tif"} and found["a.tif"].bytes == os.path.getsize(tmp_path / "in/a.tif")
    os.remove(tmp_path / "in/broken.tif")
    got = read_raster(spark, f"file://{tmp_path}/in")
    for name, seed, shape in (("a.tif", 1, (20, 30)), ("sub/b.TIFF", 2, (33, 17))):
        np.testing.assert_array_equal(grid_of(got.where(F.col("raster_id") == name), *shape), values(*shape, seed).astype("float32"))


def test_writing_is_all_or_nothing(spark, tmp_path):
    path, p = f"file://{tmp_path}/out", pixels(spark, values())
    for bad in (p.unionByName(p.limit(1)), p.withColumn("row", F.col("row") + 30), p.withColumn("col", F.col("col") - 1)):
        with pytest.raises(Exception, match="twice|outside"):
            write_raster(bad, FRAME, path, block=64, tile=32)
        assert os.listdir(tmp_path) == []
    write_raster(p, FRAME, path, block=64, tile=32)
    with pytest.raises(ExistingOutput):
        write_raster(p, FRAME, path)
    write_raster(p.where("row < 20 and col < 20"), FRAME, path, block=64, tile=32, overwrite=True)
    assert read_index(path).num_rows == 1 and os.listdir(tmp_path) == ["out"]
    assert read_raster(spark, path).where("z is not null").count() == 400 - 35


def test_integers_nulls_and_empty(spark, tmp_path):
    p = spark.createDataFrame([(0, 0, 7), (1, 1, None), (89, 149, 65534)], "row int, col int, z int")
    write_raster(p, FRAME, f"file://{tmp_path}/qc", dtype="uint16", nodata=65535, block=64, tile=16)
    assert {(x.row, x.col, x.z) for x in read_raster(spark, f"file://{tmp_path}/qc").where("z is not null").collect()} == {(0, 0, 7.0), (89, 149, 65534.0)}
    assert read_raster(spark, f"file://{tmp_path}/qc", masked="false").where("z = 65535").count() == 64 * 64 + 26 * 22 - 2
    write_raster(p.limit(0), FRAME, f"file://{tmp_path}/none")
    assert read_raster(spark, f"file://{tmp_path}/none").count() == 0


def test_grid(spark, tmp_path):
    z = np.arange(36 * 18, dtype="float64").reshape(18, 36)
    frame = Frame(-180.0, 90.0, 10.0, -10.0, 36, 18)
    write_raster(pixels(spark, z), frame, f"file://{tmp_path}/geoid", dtype="float64", block=16, tile=16)
    grid, h = read_grid(spark, f"file://{tmp_path}/geoid")
    assert {(x.i, x.j): x.val for x in grid.collect()} == {(c, r): z[r, c] for r in range(18) for c in range(36)}
    x = spark.createDataFrame([(-175.0, 85.0), (185.0, 75.0), (0.0, 0.0)], "lon double, lat double").select(*(c.alias(n) for c, n in zip(fractional(F.col("lon"), F.col("lat"), h), ("x", "y"), strict=True))).collect()
    assert [tuple(v) for v in x] == [(0.0, 0.0), (0.0, 1.0), (17.5, 8.5)]
    assert read_grid(spark, f"file://{tmp_path}/geoid", bbox=(-180.0, 60.0, -150.0, 90.0))[0].count() == 9
    write_raster(pixels(spark, z), Frame(0.0, 0.0, 1.0, -1.0, 36, 18, "EPSG:32651", "metre"), f"file://{tmp_path}/utm")
    with pytest.raises(ValueError, match="geographic"):
        read_grid(spark, f"file://{tmp_path}/utm")


def test_difference_of_grids_of_many_blocks(spark, tmp_path):
    a, b, frame = values(seed=2), values(seed=3), Frame(0.0, 90.0, 1.0, -1.0, 150, 90)
    paths = [f"file://{tmp_path}/{n}" for n in ("a", "b", "difference")]
    for z, path in zip((a, b), paths, strict=False):
        write_raster(pixels(spark, z), frame, path, dtype="float64", block=32, tile=16)
    h = read_grid(spark, paths[0])[1]
    assert (h.width, h.height, h.c, h.f) == (150, 90, 0.0, 90.0)
    geoid.write_geoid_difference(spark, *paths, "a", "b", block=32, tile=16)
    got = grid_of(read_raster(spark, paths[2]), 90, 150)
    assert np.allclose(got, a.astype(np.float32) - b.astype(np.float32), equal_nan=True)


def test_pushed_filters_are_seen_in_the_plan(spark, tmp_path):
    write_raster(pixels(spark, values()), FRAME, f"file://{tmp_path}/t", block=64, tile=32)
    geotiff.register(spark)
    df = spark.read.format("geotiff").load(f"file://{tmp_path}/t").where("row < 32 and col < 32")
    assert df.rdd.getNumPartitions() == 1 and df.count() == 1024

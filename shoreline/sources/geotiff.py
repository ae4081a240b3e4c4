"""Rasters as GeoTIFF files: a data source that reads tiles, and a writer of blocks.

    register(spark)
    spark.read.format("geotiff").option("bbox", "121.9,31.0,122.1,31.2").load("file:///data/terrain.tif").where("row < 4096")

gives raster_id, band, row, col, z. Headers are parsed when the read is planned; a partition is a run of tiles (or strips), and only the tiles that
the box, the window and the bands meet are opened. Comparisons of row, col and band with constants reach the reader too.
Options: bbox (west,south,east,north: pixels whose centres are in it, in the raster's unit), window (first row, end row, first column, end
column), bands ("1,3"), masked (true: nodata, NaN and infinite values are null), partition_bytes (of decoded tiles).

A path is one file, or a folder: of rasters, each with its name below the folder as raster_id, or, where it has an `_index`, one raster
in blocks, as write_raster() leaves it. Files are read by ranges on any file system that pyarrow knows, so executors need no local copies.
Tiles without compression and with deflate, LZW, PackBits or Zstandard are read, with the predictors 1 to 3, in both byte orders, also BigTIFF.
"""

from __future__ import annotations

import itertools
import math
import struct
import uuid
import zlib
from dataclasses import dataclass, field
from urllib.parse import unquote, urlsplit
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from shoreline.sources.rasters import Frame

SCHEMA = "raster_id string, band int, row int, col int, z double"
PARTITION_BYTES, FOUND_AT_ONCE = 32 << 20, 1 << 20
#: Blocks that a VRT file may list; a raster of more has its `_index` only.
MOST_LISTED = 100_000

#: The tags of the format, the bytes and kinds of its field types, its sample formats, and the units of its projected systems.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIEPOINT, MATRIX, KEYS, METADATA, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42112, 42113
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
FORMATS = {1: "u", 2: "i", 3: "f"}
MODEL_KEY, POINT_KEY, GEOGRAPHIC_KEY, PROJECTED_KEY, LINEAR_KEY = 1024, 1025, 2048, 3072, 3076
LINEAR = {9001: "metre", 9002: "foot", 9003: "US survey foot"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000


class NotATiff(ValueError):
    pass


@dataclass
class Header:
    """What a file says of its first image."""

    width: int
    height: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planar: bool  # each band has tiles of its own
    tile_width: int
    tile_height: int
    strips: bool  # the last one may be short; tiles are padded
    offsets: np.ndarray
    sizes: np.ndarray
    a: float
    b: float
    c: float
    d: float
    e: float
    f: float
    crs: str
    unit: str
    nodata: float | None
    tags: dict = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


# ---------------------------------------------------------------- files


def opened(path: str):
    """A file system of pyarrow and the path on it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlsplit(path).path)
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, str]]:
    """(name, path) of a file, or of the TIFF files under a folder, by name."""
    from pyarrow import fs

    on, p = opened(path)
    if on.get_file_info(p).type == fs.FileType.File:
        return [(p.rsplit("/", 1)[-1], path)]
    base = p.rstrip("/") + "/"
    found = on.get_file_info(fs.FileSelector(p, recursive=True, allow_not_found=False))
    names = sorted(i.path.removeprefix(base) for i in found if i.type == fs.FileType.File and i.path.lower().endswith((".tif", ".tiff", ".geotiff")))
    return [(n, f"{path.rstrip('/')}/{n}") for n in names]


def read_header(path: str) -> Header:
    """Reads the first image's directory and what it points to, none of the pixels."""
    on, p = opened(path)
    with on.open_input_file(p) as f:
        return parse(lambda at, n: _exactly(f, at, n))


def _exactly(f, at: int, n: int) -> bytes:
    got = f.read_at(n, at)
    if len(got) < n:
        raise NotATiff("the file ends too early")
    return got


def parse(read) -> Header:
    """A header from a function (offset, bytes) -> bytes."""
    start = read(0, 8)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    kind = struct.unpack((order or "<") + "H", start[2:4])[0]
    if order is None or kind not in (42, 43):
        raise NotATiff("no TIFF file")
    big = kind == 43
    at = struct.unpack(order + "Q", read(8, 8))[0] if big else struct.unpack(order + "I", start[4:])[0]
    count, step, room, word = (struct.unpack(order + "Q", read(at, 8))[0], 20, 8, "Q") if big else (struct.unpack(order + "H", read(at, 2))[0], 12, 4, "I")
    entries, tags = read(at + (8 if big else 2), count * step), {}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", entries, k * step)
        n = struct.unpack_from(order + word, entries, k * step + 4)[0]
        if kind not in FIELDS:
            continue
        code = FIELDS[kind]
        size = struct.calcsize("=" + code) * n
        where = k * step + 4 + room
        data = entries[where : where + size] if size <= room else read(struct.unpack_from(order + word, entries, where)[0], size)
        tags[tag] = data.split(b"\0")[0].decode("utf-8", "replace") if code == "s" else np.frombuffer(data, order + code[0])
    return _header(tags, order)


def _header(tags: dict, order: str) -> Header:
    one = lambda tag, default=None: int(tags[tag][0]) if tag in tags else default
    if WIDTH not in tags or HEIGHT not in tags or (STRIPS not in tags and TILES not in tags):
        raise NotATiff("an image without size or data")
    width, height, bands = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, form = {int(x) for x in tags.get(BITS, [1])}, {int(x) for x in tags.get(FORMAT, [1])}
    if len(bits) > 1 or len(form) > 1 or not form <= FORMATS.keys() or not bits <= {8, 16, 32, 64} or (form == {3} and bits == {8}):
        raise NotATiff(f"samples of {sorted(bits)} bits in formats {sorted(form)}")
    tiled = TILES in tags
    a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    if MATRIX in tags:
        m = tags[MATRIX]
        a, b, c, d, e, f = (float(m[k]) for k in (0, 1, 3, 4, 5, 7))
    elif SCALE in tags and TIEPOINT in tags:
        s, t = tags[SCALE], tags[TIEPOINT]
        a, e = float(s[0]), -float(s[1])
        c, f = float(t[3]) - float(t[0]) * a, float(t[4]) - float(t[1]) * e
    keys = {int(k): int(v) for k, where, _, v in np.reshape(tags.get(KEYS, np.zeros(4, int))[4:], (-1, 4)) if where == 0}
    if keys.get(POINT_KEY) == 2:  # the position is that of a pixel's centre
        c, f = c - (a + b) / 2, f - (d + e) / 2
    code = keys.get(PROJECTED_KEY) if keys.get(MODEL_KEY) == 1 else keys.get(GEOGRAPHIC_KEY)
    unit = LINEAR.get(keys.get(LINEAR_KEY, 9001), "metre") if keys.get(MODEL_KEY) == 1 else "degree"
    try:
        nodata = float(tags[NODATA]) if NODATA in tags else None
    except ValueError:
        nodata = None
    items = {}
    if METADATA in tags:
        try:
            items = {i.get("name"): i.text or "" for i in ElementTree.fromstring(tags[METADATA]).iter("Item") if i.get("sample") is None}
        except ElementTree.ParseError:
            items = {}
    return Header(
        width, height, bands, f"{order}{FORMATS[form.pop()]}{bits.pop() // 8}", one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1,
        one(TILE_WIDTH) if tiled else width, one(TILE_HEIGHT) if tiled else min(height, one(STRIP_ROWS, height)), not tiled,
        tags[TILES if tiled else STRIPS].astype(np.int64), tags[TILE_SIZES if tiled else STRIP_SIZES].astype(np.int64),
        a, b, c, d, e, f, f"EPSG:{code}" if code and code != 32767 else "", unit, nodata, items,
    )


# ---------------------------------------------------------------- tiles


def lzw(data: bytes) -> bytes:
    """The format's LZW: codes of 9 to 12 bits from the highest bit on, one code early."""
    out, table, bits, width, held, last = [], [], 0, 9, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        else:
            entry = last + last[:1]
        out.append(entry)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return b"".join(out)


def packbits(data: bytes) -> bytes:
    out, k = [], 0
    while k < len(data):
        n = data[k]
        if n < 128:
            out.append(data[k + 1 : k + 2 + n])
            k += 2 + n
        else:
            out.append(data[k + 1 : k + 2] * (257 - n) if n > 128 else b"")
            k += 2 if n > 128 else 1
    return b"".join(out)


def unpacked(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == LZW:
        return lzw(data)
    if compression == PACKBITS:
        return packbits(data)
    if compression == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise NotATiff(f"compression {compression}")


def decoded(data: bytes, h: Header, rows: int) -> np.ndarray:
    """rows x tile_width x samples of a tile in native byte order; samples: bands, or 1 where each band has tiles of its own."""
    samples, kind = (1 if h.planar else h.bands), np.dtype(h.dtype)
    raw, n = np.frombuffer(unpacked(data, h.compression), np.uint8), h.tile_width * samples
    raw = raw[: rows * n * kind.itemsize]
    if h.predictor == 3:
        planes = np.cumsum(raw.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, n)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{kind.itemsize}").reshape(rows, h.tile_width, samples).astype(f"f{kind.itemsize}")
    out = raw.view(kind).reshape(rows, h.tile_width, samples)
    if h.predictor == 2:  # differences of the words, whatever they stand for
        words = out.view(f"{h.dtype[0]}u{kind.itemsize}").astype(f"u{kind.itemsize}")
        out = np.cumsum(words, axis=1, dtype=words.dtype).view(kind.newbyteorder("="))
    return out.astype(kind.newbyteorder("="), copy=False)


def encoded(tile: np.ndarray) -> bytes:
    """Deflated differences of a tile's words, as predictor 2 has them."""
    words = np.ascontiguousarray(tile).view(f"<u{tile.dtype.itemsize}")
    return zlib.compress(np.diff(words, axis=1, prepend=words.dtype.type(0)).astype(words.dtype).tobytes(), 6)


def tiff(values: np.ndarray, tile: int, a: float, e: float, c: float, f: float, crs: str, unit: str, nodata: float | None, tags: dict) -> bytes:
    """A tiled GeoTIFF of one band."""
    height, width = values.shape
    kind = values.dtype.newbyteorder("<")
    fill = kind.type(0) if nodata is None else kind.type(nodata)
    down, across = -(-height // tile), -(-width // tile)
    whole = np.full((down * tile, across * tile), fill, kind)
    whole[:height, :width] = values
    blobs = [encoded(whole[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile]) for y in range(down) for x in range(across)]
    code, projected = int(crs.rsplit(":", 1)[-1]) if crs.startswith("EPSG:") else 32767, unit != "degree"
    keys = [(MODEL_KEY, 0, 1, 1 if projected else 2), (POINT_KEY, 0, 1, 1), (PROJECTED_KEY if projected else GEOGRAPHIC_KEY, 0, 1, code)]
    keys += [(LINEAR_KEY, 0, 1, next((k for k, v in LINEAR.items() if v == unit), 9001))] if projected else []
    meta = ElementTree.Element("GDALMetadata")
    for k, v in tags.items():
        ElementTree.SubElement(meta, "Item", name=str(k)).text = str(v)
    short, long, double = (lambda *v: (3, "H", v)), (lambda *v: (4, "I", v)), (lambda *v: (12, "d", v))
    text = lambda s: (2, "s", s.encode() + b"\0")
    entries = {
        WIDTH: long(width), HEIGHT: long(height), BITS: short(8 * kind.itemsize), COMPRESSION: short(DEFLATE), PHOTOMETRIC: short(1), SAMPLES: short(1), PLANAR: short(1), PREDICTOR: short(2),
        TILE_WIDTH: long(tile), TILE_HEIGHT: long(tile), TILES: long(*range(len(blobs))), TILE_SIZES: long(*map(len, blobs)), FORMAT: short({"u": 1, "i": 2, "f": 3}[kind.kind]),
        KEYS: short(1, 1, 0, len(keys), *itertools.chain.from_iterable(keys)),
    }
    entries |= {SCALE: double(a, -e, 0.0), TIEPOINT: double(0.0, 0.0, 0.0, c, f, 0.0)} if a > 0 and e < 0 else {MATRIX: double(a, 0, 0, c, 0, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1)}
    entries |= {METADATA: text(ElementTree.tostring(meta, "unicode"))} if tags else {}
    entries |= {NODATA: text("nan" if math.isnan(nodata) else repr(float(nodata)))} if nodata is not None else {}
    at = 8 + 2 + 12 * len(entries) + 4
    size = at + sum(len(v) if code == "s" else struct.calcsize(f"<{len(v)}{code}") for _, code, v in entries.values()) + 8 * len(entries)
    first, offsets = size + (-size) % 16, []
    for b in blobs:
        offsets.append(first)
        first += len(b)
    entries[TILES] = long(*offsets)
    fixed, extra = b"", b""
    for tag, (kind_code, code, v) in sorted(entries.items()):
        data = v if code == "s" else struct.pack(f"<{len(v)}{code}", *v)
        here = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(extra))
        extra += b"" if len(data) <= 4 else data + b"\0" * (len(data) % 2)
        fixed += struct.pack("<HHI", tag, kind_code, len(v)) + here
    head = b"II" + struct.pack("<HIH", 42, 8, len(entries)) + fixed + struct.pack("<I", 0) + extra
    return head.ljust(offsets[0], b"\0") + b"".join(blobs)


# ---------------------------------------------------------------- the data source


@dataclass
class Tiles(InputPartition):
    """Tiles of one file: (number, band or None, tile row, tile column) each; row and col: where the file begins in its raster."""

    raster_id: str
    path: str
    header: Header
    row: int
    col: int
    tiles: list

    def __post_init__(self):
        super().__init__(None)


@dataclass
class Window:
    """Rows and columns from and to (not included), and bands (None: all)."""

    row0: int = 0
    row1: int = 1 << 40
    col0: int = 0
    col1: int = 1 << 40
    bands: frozenset | None = None

    def narrowed(self, f) -> None:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if isinstance(f, In) and name == "band":
            self._bands({int(v) for v in f.value if v is not None})
        elif name == "band" and isinstance(f, EqualTo):
            self._bands({int(f.value)})
        elif name in ("row", "col") and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            v = int(f.value)
            low = v if isinstance(f, EqualTo | GreaterThanOrEqual) else v + 1 if isinstance(f, GreaterThan) else 0
            high = v + 1 if isinstance(f, EqualTo | LessThanOrEqual) else v if isinstance(f, LessThan) else 1 << 40
            setattr(self, f"{name}0", max(getattr(self, f"{name}0"), low))
            setattr(self, f"{name}1", min(getattr(self, f"{name}1"), high))

    def _bands(self, some: set) -> None:
        self.bands = frozenset(some) if self.bands is None else self.bands & some

    def of(self, h: Header, row: int, col: int, bbox: tuple | None) -> tuple[int, int, int, int]:
        """The same in rows and columns of a file that begins at (row, col) of its raster."""
        r0, r1, c0, c1 = max(0, self.row0 - row), min(h.height, self.row1 - row), max(0, self.col0 - col), min(h.width, self.col1 - col)
        if bbox is None:
            return r0, r1, c0, c1
        if h.b or h.d:
            raise ValueError("a box in a turned raster")
        x, y = h.c + h.a * (np.arange(h.width) + 0.5), h.f + h.e * (np.arange(h.height) + 0.5)
        inside = [np.flatnonzero((v >= low) & (v <= high)) for v, low, high in ((y, bbox[1], bbox[3]), (x, bbox[0], bbox[2]))]
        (b0, b1), (d0, d1) = ((int(v[0]), int(v[-1]) + 1) if len(v) else (0, 0) for v in inside)
        return max(r0, b0), min(r1, b1), max(c0, d0), min(c1, d1)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.masked = str(options.get("masked", "true")).lower() == "true"
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.bbox = tuple(float(v) for v in options["bbox"].split(",")) if options.get("bbox") else None
        self.window = Window(*(int(v) for v in options["window"].split(","))) if options.get("window") else Window()
        if options.get("bands"):
            self.window.bands = frozenset(int(v) for v in options["bands"].split(","))

    def pushFilters(self, filters):
        for f in filters:
            self.window.narrowed(f)
            yield f  # a tile has other pixels too

    def files(self) -> list[tuple[str, str, int, int]]:
        """raster_id, path, first row and column of each file that the window may meet."""
        index = read_index(self.path)
        if index is None:
            return [(name, path, 0, 0) for name, path in listed(self.path)]
        w, name = self.window, self.path.rstrip("/").rsplit("/", 1)[-1]
        blocks = index.to_pylist()
        return [(name, f"{self.path.rstrip('/')}/{b['file']}", b["row"], b["col"]) for b in blocks if b["row"] < w.row1 and b["row"] + b["height"] > w.row0 and b["col"] < w.col1 and b["col"] + b["width"] > w.col0]

    def partitions(self) -> list[Tiles]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(16) as pool:  # headers are small and far away
            found = self.files()
            return [t for f, h in zip(found, pool.map(lambda f: read_header(f[1]), found), strict=True) for t in self._runs(*f, h)]

    def _runs(self, raster_id: str, path: str, row: int, col: int, h: Header) -> list[Tiles]:
        r0, r1, c0, c1 = self.window.of(h, row, col, self.bbox)
        bands = [b for b in range(1, h.bands + 1) if self.window.bands is None or b in self.window.bands]
        if r0 >= r1 or c0 >= c1 or not bands:
            return []
        places = itertools.product(bands if h.planar else [None], range(r0 // h.tile_height, -(-r1 // h.tile_height)), range(c0 // h.tile_width, -(-c1 // h.tile_width)))
        tiles = [(((b or 1) - 1) * h.across * h.down + y * h.across + x, b, y, x) for b, y, x in places]
        each = max(1, self.size // (h.tile_width * h.tile_height * np.dtype(h.dtype).itemsize * (1 if h.planar else h.bands)))
        out = []
        for i in range(0, len(tiles), each):
            some = tiles[i : i + each]
            numbers = [t[0] for t in some]
            # a partition takes along the places of its own tiles only
            own = Header(**{**vars(h), "offsets": h.offsets[numbers], "sizes": h.sizes[numbers]})
            out.append(Tiles(raster_id, path, own, row, col, some))
        return out

    def read(self, partition: Tiles | None):
        if partition is None:  # nothing to read
            return
        h = partition.header
        r0, r1, c0, c1 = self.window.of(h, partition.row, partition.col, self.bbox)
        on, path = opened(partition.path)
        with on.open_input_file(path) as f:
            for (_, band, y, x), at, size in zip(partition.tiles, h.offsets.tolist(), h.sizes.tolist(), strict=True):
                top, left = y * h.tile_height, x * h.tile_width
                rows = min(h.tile_height, h.height - top) if h.strips else h.tile_height
                box = slice(max(r0 - top, 0), min(r1 - top, h.height - top, h.tile_height)), slice(max(c0 - left, 0), min(c1 - left, h.width - left, h.tile_width))
                if size:
                    tile = decoded(_exactly(f, at, size), h, rows)[box]
                else:  # a sparse file has no bytes for a tile of nodata
                    tile = np.full((box[0].stop - box[0].start, box[1].stop - box[1].start, 1 if h.planar else h.bands), h.nodata or 0.0)
                r, c = np.mgrid[box]
                for k in range(tile.shape[2]):
                    n = band if band is not None else k + 1
                    if self.window.bands is None or n in self.window.bands:
                        yield from self._batches(partition, n, r.ravel() + top + partition.row, c.ravel() + left + partition.col, tile[:, :, k].ravel().astype(np.float64))

    def _batches(self, p: Tiles, band: int, row: np.ndarray, col: np.ndarray, z: np.ndarray):
        gone = ~np.isfinite(z)
        if p.header.nodata is not None and math.isfinite(p.header.nodata):
            gone |= np.abs(z - p.header.nodata) <= 1e-8 + 1e-5 * abs(p.header.nodata)
        for i in range(0, len(z), FOUND_AT_ONCE):
            s = slice(i, i + FOUND_AT_ONCE)
            n = len(z[s])
            values = pa.array(z[s], mask=gone[s] if self.masked else None)
            yield pa.RecordBatch.from_arrays([pa.array([p.raster_id] * n), pa.array(np.full(n, band, np.int32)), pa.array(row[s].astype(np.int32)), pa.array(col[s].astype(np.int32)), values], names=["raster_id", "band", "row", "col", "z"])


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoTiff)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_raster(spark: SparkSession, path: str, **options) -> DataFrame:
    """raster_id, band, row, col, z of the file or folder; options as above."""
    register(spark)
    return spark.read.format("geotiff").options(**options).load(path)


def read_index(path: str) -> pa.Table | None:
    """file, row, col, height, width, valid, bytes of the blocks of a raster that write_raster() wrote; None for other paths."""
    from pyarrow import dataset, fs

    on, p = opened(path)
    if on.get_file_info(f"{p.rstrip('/')}/_index").type != fs.FileType.Directory:
        return None
    return dataset.dataset(f"{p.rstrip('/')}/_index", filesystem=on, format="parquet", exclude_invalid_files=True).to_table().sort_by([("row", "ascending"), ("col", "ascending")])


# ---------------------------------------------------------------- headers of many files

FIELDS_OF_A_HEADER = "raster_id string, path string, width int, height int, bands int, crs string, unit string, a double, b double, c double, d double, e double, f double, nodata double, dtype string, bytes long, modified timestamp, tags map<string,string>, error string"


def headers(files: DataFrame) -> DataFrame:
    """Headers, as in sources.rasters, of the files that sources.tables.discover() finds (path, relative, bytes, modified), with tags and error. Each
    task reads the headers of its files; a file that is no raster has an error and no size. A nodata of NaN is null."""

    def run(frames):
        import pandas as pd

        for t in frames:
            out = []
            for x in t.itertuples():
                row = {"raster_id": x.relative, "path": x.path, "bytes": x.bytes, "modified": x.modified, "error": "", "width": 0, "height": 0, "bands": 0, "crs": "", "unit": "", "dtype": "", "tags": {}}
                try:
                    h = read_header(x.path)
                    row |= {k: getattr(h, k) for k in ("width", "height", "bands", "crs", "unit", *"abcdef", "nodata", "tags")} | {"dtype": np.dtype(h.dtype).name}
                except (NotATiff, OSError, struct.error) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                out.append(row)
            names = [c.split()[0] for c in FIELDS_OF_A_HEADER.split(", ")]
            yield pd.DataFrame(out).reindex(columns=names)

    return files.select("path", "relative", "bytes", "modified").mapInPandas(run, FIELDS_OF_A_HEADER)


# ---------------------------------------------------------------- writing

BLOCK = "file string, row int, col int, height int, width int, valid long, bytes long"


def write_raster(pixels: DataFrame, frame: Frame, path: str, value: str = "z", dtype: str = "float32", nodata: float | None = math.nan, tags: dict | None = None, block: int = 2048, tile: int = 256, overwrite: bool = False) -> DataFrame:
    """Writes pixels (row, col and a value) as a folder of tiled GeoTIFF files of `block` x `block` pixels, their `_index` and, for up to MOST_LISTED
    of them, a mosaic.vrt that shows them as one raster. Returns the index.

    One task writes a block, first under another name, so that a task that runs twice leaves one file; the folder is put in place when it is
    whole. Absent and null values become nodata; a pixel that is given twice or lies outside is an error."""
    from shoreline.sources.bundle import ExistingOutput, _fs, exists, swap

    if tile % 16 or block % tile:
        raise ValueError("tiles are multiples of 16 pixels, blocks of tiles")
    spark = pixels.sparkSession
    if exists(spark, path) and not overwrite:
        raise ExistingOutput(path)
    new, kind, tags = f"{path}.new-{uuid.uuid4().hex}", np.dtype(dtype), dict(tags or {})
    if nodata is None and kind.kind == "f":
        nodata = math.nan
    fill = kind.type(0 if nodata is None else nodata)
    fs, p = _fs(spark, new)
    fs.mkdirs(p)

    def write(key, table):
        y, x = (k.as_py() for k in key)
        row, col = (table[c].combine_chunks().to_numpy() for c in ("row", "col"))
        height, width = min(block, frame.height - y * block), min(block, frame.width - x * block)
        if y < 0 or x < 0 or height <= 0 or width <= 0 or row.max() >= y * block + height or col.max() >= x * block + width:
            raise ValueError("pixels outside the raster")
        at = (row - y * block).astype(np.int64) * width + (col - x * block)
        if len(np.unique(at)) < len(at):
            raise ValueError("a pixel is given twice")
        v = table["value"].combine_chunks()
        ok = v.is_valid().to_numpy(zero_copy_only=False)
        values = np.full(height * width, fill, kind)
        values[at[ok]] = v.drop_null().to_numpy().astype(kind)
        data = tiff(values.reshape(height, width), tile, frame.dx, frame.dy, frame.x0 + frame.dx * x * block, frame.y0 + frame.dy * y * block, frame.crs, frame.unit, nodata, tags)
        name = f"block_{y:05d}_{x:05d}.tif"
        on, folder = opened(new)
        temporary = f"{folder}/{name}.{uuid.uuid4().hex}"
        with on.open_output_stream(temporary) as f:
            f.write(data)
        on.move(temporary, f"{folder}/{name}")
        return pa.table([[name], [y * block], [x * block], [height], [width], [int(ok.sum())], [len(data)]], schema=pa.schema([("file", pa.string()), *((c, pa.int32()) for c in ("row", "col", "height", "width")), ("valid", pa.int64()), ("bytes", pa.int64())]))

    try:
        rows = pixels.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).alias("value"))
        number = lambda c: F.floor(F.col(c) / block).cast("int").alias(f"_{c}")
        rows.groupBy(number("row"), number("col")).applyInArrow(write, BLOCK).write.parquet(f"{new}/_index")
        index = spark.read.parquet(f"{new}/_index")
        if index.count() <= MOST_LISTED:
            on, folder = opened(new)
            with on.open_output_stream(f"{folder}/mosaic.vrt") as f:
                f.write(vrt(frame, dtype, nodata, [r.asDict() for r in index.orderBy("row", "col").collect()]))
        swap(spark, new, path)
    finally:
        fs.delete(p, True)
    return spark.read.parquet(f"{path}/_index")


def vrt(frame: Frame, dtype: str, nodata: float | None, blocks: list[dict]) -> bytes:
    """An XML file by which other programs read the blocks as one raster."""
    names = {"float32": "Float32", "float64": "Float64", "uint8": "Byte", "int8": "Int8", "uint16": "UInt16", "int16": "Int16", "uint32": "UInt32", "int32": "Int32"}
    root = ElementTree.Element("VRTDataset", rasterXSize=str(frame.width), rasterYSize=str(frame.height))
    ElementTree.SubElement(root, "SRS").text = frame.crs
    ElementTree.SubElement(root, "GeoTransform").text = ", ".join(map(repr, map(float, (frame.x0, frame.dx, 0, frame.y0, 0, frame.dy))))
    band = ElementTree.SubElement(root, "VRTRasterBand", dataType=names[dtype], band="1")
    if nodata is not None:
        ElementTree.SubElement(band, "NoDataValue").text = "nan" if math.isnan(nodata) else repr(float(nodata))
    for b in blocks:
        source = ElementTree.SubElement(band, "ComplexSource" if nodata is not None else "SimpleSource")
        ElementTree.SubElement(source, "SourceFilename", relativeToVRT="1").text = b["file"]
        ElementTree.SubElement(source, "SourceBand").text = "1"
        size = {"xSize": str(b["width"]), "ySize": str(b["height"])}
        ElementTree.SubElement(source, "SrcRect", xOff="0", yOff="0", **size)
        ElementTree.SubElement(source, "DstRect", xOff=str(b["col"]), yOff=str(b["row"]), **size)
        if nodata is not None:
            ElementTree.SubElement(source, "NODATA").text = "nan" if math.isnan(nodata) else repr(float(nodata))
    return ElementTree.tostring(root)


# ---------------------------------------------------------------- grids


def read_grid(spark: SparkSession, path: str, bbox: tuple | None = None, band: int = 1) -> tuple[DataFrame, Header]:
    """A reference grid as operators.sampling takes it, i (column), j (row), val, where it has a value, and its header. A grid without a geographic
    system isn't one that longitudes and latitudes can be looked up in: an error."""
    index = read_index(path)
    first = listed(path)
    if not first:
        raise FileNotFoundError(path)
    h = read_header(first[0][1] if index is None else f"{path.rstrip('/')}/{index['file'][0].as_py()}")
    if not h.crs or h.unit != "degree":
        raise ValueError(f"{path}: a reference grid needs a geographic reference system, not {h.crs or 'none'}")
    options = {"bands": str(band)} | ({"bbox": ",".join(map(repr, bbox))} if bbox else {})
    grid = read_raster(spark, path, **options).where("z is not null").select(F.col("col").alias("i"), F.col("row").alias("j"), F.col("z").alias("val"))
    if index is not None:  # where the whole begins, and how far its blocks go
        blocks = index.to_pylist()
        width, height = (max(b[at] + b[n] for b in blocks) for at, n in (("col", "width"), ("row", "height")))
        h = Header(**{**vars(h), "c": h.c - h.a * blocks[0]["col"], "f": h.f - h.e * blocks[0]["row"], "width": width, "height": height})
    return grid, h


def fractional(lon, lat, h: Header):
    """Columns with the fractional column and row of a place in the grid of a header; longitudes are brought within its width first."""
    lon = F.pmod(lon - F.lit(h.c), F.lit(360.0)) + F.lit(h.c) if h.a > 0 else lon
    return (lon - h.c) / h.a - 0.5, (lat - h.f) / h.e - 0.5

"""What the corpus operators share: the shared folder, word arrays over Arrow text, and blocks of documents."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.sources.tables import freed, scratch, small  # noqa: F401
from shoreline.sources.tables import stored as written  # noqa: F401

#: Word bytes: everything but space and \t \n \v \f \r. All separators are ASCII, so this holds byte-wise on UTF-8.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that is worked on at once; numpy takes some 40 bytes for each.
SLICE_BYTES = 1 << 20
MAX_BLOCKS = 1 << 20
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str):
    """A top-level column by its name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(names: list[str]) -> list:
    """Columns under names of our own (_c0, _c1, ...), which can't clash with those that an operator adds."""
    return [column(c).alias(f"_c{k}") for k, c in enumerate(names)]


def renamed(names: list[str]) -> list:
    """The columns of numbered() under their own names again."""
    return [F.col(f"_c{k}").alias(c) for k, c in enumerate(names)]


def crc_mod(col, n: int):
    """crc32 of a column as decimal text, modulo n; null counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


# ---------------------------------------------------------------- words of Arrow text


@functools.cache
def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trimmed(batches):
    """The batches, giving freed memory back to the system after each: a worker lives on between tasks, and what it holds counts against its executor."""
    for b in batches:
        yield b
        pa.default_memory_pool().release_unused()
        if _libc() is not None:
            _libc().malloc_trim(0)


def as_strings(col: pa.Array) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return (col if pa.types.is_large_string(col.type) else col.cast(pa.large_string())).fill_null("")


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """(first row, length) runs of about `limit` bytes, never splitting a text."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j - i
        i = j


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and its len+1 offsets, from 0."""
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def table_of(separators: bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = table_of(b"\x20\x09\x0a\x0b\x0c\x0d")


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the bytes, and for each text the index of its first word (len+1)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    before[off[:-1][off[:-1] < n]] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, w[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x9E3779B97F4A7C15 | 5
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands: prefix sums of byte values times
    powers of an odd base, moved back to the word's start by the inverse power."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES) + 1
        _powers[:] = [_odd_powers(_BASE, size), _odd_powers(pow(_BASE, -1, 1 << 64), size)]
    up, down = _powers
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[:n], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text; works in slices."""
    hashes, counts = [], []
    for i, n in slices(col):
        data, off = raw(col.slice(i, n))
        s, e, first = spans(data, off)
        hashes.append(word_hashes(data, s, e))
        counts.append(np.diff(first))
    none = np.zeros(0, np.uint64)
    return (np.concatenate(hashes) if hashes else none), (np.concatenate(counts) if counts else none.astype(np.int64))


# ---------------------------------------------------------------- blocks of documents in doc_id order


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(column(text))).alias("b")).first()["b"] or 0


def block_count(docs: DataFrame, text: str, target_bytes: int) -> tuple[int, int]:
    """Blocks of about target_bytes of text, and the bytes of all texts."""
    total = text_bytes(docs, text)
    return min(MAX_BLOCKS, max(1, math.ceil(total / target_bytes))), total


def in_blocks(docs: DataFrame, doc_id: str, text: str, blocks: int) -> DataFrame:
    """Adds `block`: the document's place among about equally full ranges of doc_id (null first). The boundaries
    are quantiles, at most MAX_BLOCKS longs (8 MB), so that they can go to every executor."""
    if blocks <= 1:
        return docs.withColumn("block", F.lit(0))
    q = [i / blocks for i in range(1, blocks)]
    cuts = docs.agg(F.percentile_approx(doc_id, q, max(10_000, 20 * blocks)).alias("q")).first()["q"] or []
    edges = docs.sparkSession.sparkContext.broadcast(np.unique(np.array(cuts, np.int64)))

    @F.pandas_udf("int")
    def place(ids):
        import pandas as pd

        at = np.searchsorted(edges.value, ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), "right")
        return pd.Series(at.astype(np.int32))

    return docs.withColumn("block", place(F.col(doc_id).cast("long")))


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()

"""Test heights of the cells of a quadtree at all its levels, from pixels that are read and shuffled once.

A cell is named by its macro cell (mr, mc) and its path (pr, pc): a bit an axis and level. Along an axis the windows of the deepest cells
follow each other and overlap in at most the pixels that a border crosses, so what a pixel belongs to is looked up in two sorted lists. A pixel that lies
in several deepest cells has a copy for each; a copy counts from the level on at which its cell is another one than that of the copy before it, so every
cell of every level has each of its pixels once.

The copies of a block, the cell of the first level whose cells have at most BLOCK_PIXELS pixels, meet in one task, which sorts them for each level
from there on. Coarser cells, of larger macro cells, get their deciles by selection from the same copies, which shuffles counts only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoreline.operators import quantiles
from shoreline.sources.rasters import Frame
from shoreline.sources.tables import freed, stored

#: Pixels of one block, about 100 bytes each in its task, and deepest cells along an axis, which go to every executor (25 bytes each).
BLOCK_PIXELS, MOST_CELLS = 1 << 22, 1 << 22
DECILES, FEW = (0.1, 0.5, 0.9), 10
COPIES = "mr int, mc int, pr int, pc int, since int, z double"
HEIGHTS = "mr int, mc int, level int, pr int, pc int, heights array<double>"


@dataclass
class Line:
    """The deepest cells along an axis: macro cell, path, first and end pixel, in the order of the pixels, and the level from which each is another than the
    one before."""

    macro: np.ndarray
    path: np.ndarray
    first: np.ndarray
    end: np.ndarray
    since: np.ndarray

    def cells_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many cells each pixel is in, and the first of them."""
        low = np.searchsorted(self.end, at, "right")
        return np.maximum(np.searchsorted(self.first, at, "right") - low, 0), low


def line(start: float, stop: float, step: float, origin: float, size: float, pixels: int, depth: int) -> Line:
    """Of macro cells from start to stop, over pixels of a size from an origin. Bounds are halved as the cells' are, so both agree to the last bit."""
    n = max(1, math.ceil((stop - start) / step - 1e-9))
    if n << depth > MOST_CELLS:
        raise ValueError(f"{n << depth} cells along an axis are over {MOST_CELLS}: take a wider least spacing")
    low, high = start + np.arange(n) * step, start + (np.arange(n) + 1) * step
    macro, path = np.arange(n), np.zeros(n, np.int64)
    for _ in range(depth):
        middle = (low + high) / 2
        low, high = np.stack((low, middle), 1).ravel(), np.stack((middle, high), 1).ravel()
        macro, path = np.repeat(macro, 2), np.stack((path * 2, path * 2 + 1), 1).ravel()
    a, b = (low - origin) / size, (high - origin) / size
    first, end = np.maximum(0, np.floor(np.minimum(a, b))).astype(np.int64), np.minimum(pixels, np.ceil(np.maximum(a, b))).astype(np.int64)
    kept = np.flatnonzero(end > first)
    kept = kept[np.argsort(first[kept], kind="stable")] if size > 0 else kept[::-1]
    macro, path, first, end = macro[kept], path[kept], first[kept], end[kept]
    differ = np.concatenate(([0], path[1:] ^ path[:-1]))
    bits = np.frexp(differ.astype(np.float64))[1]  # the length of a whole number in bits
    since = np.where(np.concatenate(([True], macro[1:] != macro[:-1])), 0, depth - bits + 1)
    return Line(macro, path, first, end, since)


def copies(pixels: DataFrame, rows: Line, cols: Line) -> DataFrame:
    """mr, mc, pr, pc, since, z of each pixel with a height in each deepest cell that it is in."""
    shared = pixels.sparkSession.sparkContext.broadcast((rows, cols))

    def run(batches):
        down, across = shared.value
        for b in batches:
            r, c, z = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            (nr, r0), (nc, c0) = down.cells_of(r), across.cells_of(c)
            n = nr * nc
            at = np.repeat(np.arange(len(r)), n)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            i, j = nth // nc[at], nth % nc[at]
            y, x = r0[at] + i, c0[at] + j
            since = np.maximum(np.where(i > 0, down.since[y], 0), np.where(j > 0, across.since[x], 0))
            out = [down.macro[y], across.macro[x], down.path[y], across.path[x], since]
            yield pa.RecordBatch.from_arrays([*(pa.array(v.astype(np.int32)) for v in out), pa.array(z[at])], names=["mr", "mc", "pr", "pc", "since", "z"])

    return pixels.where(F.col("z").isNotNull()).select("row", "col", F.col("z").cast("double").alias("z")).mapInArrow(run, COPIES)


def deciles(z: np.ndarray) -> np.ndarray:
    """Of sorted heights: the deciles 1, 5 and 9 of ten or more, else all different ones."""
    if len(z) < FEW:
        return np.unique(z)
    out = []
    for p in DECILES:
        at = p * (len(z) - 1)
        lo, hi = math.floor(at), math.ceil(at)
        out.append(z[lo] if lo == hi or z[lo] == z[hi] else (hi - at) * z[lo] + (at - lo) * z[hi])
    return np.array(out)


def pyramid(pixels: DataFrame, frame: Frame, initial: tuple[float, float], depth: int, block_pixels: int = BLOCK_PIXELS) -> DataFrame:
    """mr, mc, level, pr, pc, heights of every cell with heights at the levels 0 to depth, as a written table. pixels: row, col, z; initial: the steps of macro
    cells along x and y from the west and south of the frame."""
    west, south, east, north = frame.bounds
    cols = line(west, east, initial[0], frame.x0, frame.dx, frame.width, depth)
    rows = line(south, north, initial[1], frame.y0, frame.dy, frame.height, depth)
    each = (initial[0] / abs(frame.dx) + 2) * (initial[1] / abs(frame.dy) + 2)  # pixels of a macro cell
    first = min(depth, max(0, math.ceil(math.log(max(1.0, each / block_pixels), 4))))
    table = copies(pixels, rows, cols)
    if first:
        table = stored(table, "pixel-copies")  # read again by the selection
    shift = lambda c, level: F.shiftright(c, depth - level)

    def block(key, t):
        mr, mc = (k.as_py() for k in key[:2])
        pr, pc, since, z = (t[c].combine_chunks().to_numpy() for c in ("pr", "pc", "since", "z"))
        order = np.argsort(z, kind="stable")
        pr, pc, since, z = pr[order].astype(np.int64), pc[order].astype(np.int64), since[order], z[order]
        out = []
        for level in range(first, depth + 1):
            here = np.flatnonzero(since <= level)
            cell = ((pr[here] >> (depth - level)) << 32) | (pc[here] >> (depth - level))
            here, cell = (v[np.argsort(cell, kind="stable")] for v in (here, cell))  # heights stay in order
            edge = np.append(np.flatnonzero(np.diff(cell, prepend=-1)), len(cell))
            heights = [deciles(z[here[a:b]]) for a, b in zip(edge, edge[1:], strict=False)]
            code = cell[edge[:-1]]
            out.append(pa.table({"mr": pa.array([mr] * len(code), pa.int32()), "mc": pa.array([mc] * len(code), pa.int32()), "level": pa.array([level] * len(code), pa.int32()), "pr": pa.array((code >> 32).astype(np.int32)), "pc": pa.array((code & 0xFFFFFFFF).astype(np.int32)), "heights": pa.array(heights, pa.list_(pa.float64()))}))
        return pa.concat_tables(out)

    fine = table.groupBy("mr", "mc", shift("pr", first).alias("_r"), shift("pc", first).alias("_c")).applyInArrow(block, HEIGHTS)
    parts = [fine]
    for level in range(first):
        here = table.where(F.col("since") <= level).select("mr", "mc", shift("pr", level).alias("pr"), shift("pc", level).alias("pc"), "z")
        keys = ("mr", "mc", "pr", "pc")
        q = quantiles.percentiles(here, "z", list(DECILES), *keys)
        few = here.join(q.where(F.col("n") < FEW).select(*keys), list(keys), "left_semi").groupBy(*keys).agg(F.array_sort(F.collect_set("z")).alias("s"))
        coarse = q.join(few, list(keys), "left").select("mr", "mc", F.lit(level).alias("level"), "pr", "pc", F.coalesce("s", "q").alias("heights"))
        parts.append(coarse)
    out = stored(reduce(DataFrame.unionByName, parts), "pyramid")
    if first:
        freed(table)
    return out

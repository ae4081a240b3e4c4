"""Sharding by extendible hashing, in DataFrame functions only.

A document's key is 60 bits of md5 over doc_id and text. The directory is indexed by prefixes of these bits: a
bucket over `limit` bytes is split on its next bit, and on no other bucket's account, until it fits or holds one
document. The state that this reaches doesn't depend on the order of insertion: a document's shard is the shortest
prefix of its key whose documents fit. So it is computed from sums over prefixes: one aggregation by the bits of a
cell (a few more than log2(bytes / limit)), sums of the cells over all shorter prefixes, and only for cells that still
don't fit another round on more bits.

Cases: null texts have no bytes; a document larger than `limit` is a shard of its own (`shard_bytes` then
exceeds the limit); rows with equal doc_id and text have equal keys, and where all rows of a 60-bit prefix are such
copies and exceed the limit, they are numbered and dealt to shards of as many copies as fit, named by the
prefix, a '.' and a number; an empty table gives an empty result. Other columns are kept as they are; columns of the
result that the table has already are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.base import column, numbered, read, renamed, small, written

BITS = 60
STEP = 8
LIMIT = 16 << 20
#: Directory entries that may be sent to every executor (about 40 bytes each).
BROADCAST_CELLS = 1 << 18


def key_bits(doc_id: Column, text: Column) -> Column:
    """The first 60 bits of md5 over doc_id, a space and the text."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _cells(rows: DataFrame, bits: int, shallow: int, limit: int) -> DataFrame:
    """_cell, depth, shard_bytes, shard_docs of each cell of `bits` bits; depth is null where it must be split further.
    `shallow`: prefixes up to this length are known not to fit."""
    sums = rows.groupBy(F.shiftright("_key", BITS - bits).alias("_cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    each = sums.select("_cell", "b", "n", F.explode(F.sequence(F.lit(shallow), F.lit(bits))).alias("d")).withColumn("p", F.expr(f"shiftright(_cell, {bits} - d)"))
    fit = each.groupBy("d", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs")).where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    best = each.select("_cell", "d", "p").join(fit, ["d", "p"], "left").groupBy("_cell").agg(F.min(F.when(F.col("shard_bytes").isNotNull(), F.struct(F.col("d").alias("depth"), "shard_bytes", "shard_docs"))).alias("s"))
    return best.select("_cell", "s.depth", "s.shard_bytes", "s.shard_docs")


def assign_shards(docs: DataFrame, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all) of docs with n_bytes, shard (the bits of its prefix), depth, shard_bytes, shard_docs."""
    ours = ("n_bytes", "shard", "depth", "shard_bytes", "shard_docs")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ours]
    rows = docs.select(*numbered(kept), F.coalesce(F.octet_length(column(text)), F.lit(0)).cast("long").alias("n_bytes"), key_bits(column(doc_id), column(text)).alias("_key"))
    if text not in kept:
        rows = written(rows, "shard-keys")  # narrow rows: read again below instead of the texts
    sizes = rows.select("_key", "n_bytes")
    total = sizes.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    bits, shallow, deep = min(BITS, max(1, math.ceil(math.log2(max(2, total / limit))) + 3)), 0, sizes
    places = ["depth", "shard_bytes", "shard_docs"]
    found = rows.select(*rows.columns, *(F.lit(None).cast(t).alias(c) for c, t in zip(places, ("int", "long", "long"), strict=True)))
    while True:
        cells = written(_cells(deep, bits, shallow, limit), "directory")
        new = small(cells.select("_cell", *(F.col(c).alias(f"_{c}") for c in places)), BROADCAST_CELLS)
        found = found.withColumn("_cell", F.shiftright("_key", BITS - bits)).join(new, "_cell", "left").withColumns({c: F.coalesce(c, f"_{c}") for c in places}).drop("_cell", *(f"_{c}" for c in places))
        open_cells = cells.where("depth is null")
        if bits == BITS or open_cells.isEmpty():
            break
        deep = deep.withColumn("_cell", F.shiftright("_key", BITS - bits)).join(open_cells.select("_cell"), "_cell", "left_semi").drop("_cell")
        bits, shallow = min(BITS, bits + STEP), bits + 1
    found = found.withColumn("shard", F.expr(f"right(lpad(bin(shiftright(_key, {BITS} - depth)), {BITS}, '0'), depth)"))
    if bits == BITS and not open_cells.isEmpty():
        found = found.where("depth is not null").unionByName(_copies(written(found.where("depth is null"), "copies"), limit))
    return found.select(*renamed(kept), *ours)


def _copies(rows: DataFrame, limit: int) -> DataFrame:
    """Rows whose whole key is shared by more than fits: numbered by counts per input split and dealt out. Rows of
    different sizes under one key, which needs a collision of 60 bits, are dealt by the largest."""
    rows = written(rows.withColumns({"_split": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "copies")
    counts = rows.groupBy("_key", "_split").agg(F.count("*").alias("n"), F.max("n_bytes").alias("m"))
    by_key = Window.partitionBy("_key")
    counts = counts.withColumns({"_before": F.sum("n").over(by_key.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), "_fit": F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.max("m").over(by_key))))})
    rows = rows.join(counts.select("_key", "_split", F.coalesce("_before", F.lit(0)).alias("_before"), "_fit"), ["_key", "_split"])
    nth = F.col("_before") + F.row_number().over(Window.partitionBy("_key", "_split").orderBy("_at")) - 1
    rows = rows.withColumn("_part", F.floor(nth / F.col("_fit")))
    sums = rows.groupBy("_key", "_part").agg(F.sum("n_bytes").alias("_b"), F.count("*").alias("_n"))
    name = F.expr(f"concat(lpad(bin(_key), {BITS}, '0'), '.', _part)")
    return rows.join(sums, ["_key", "_part"]).withColumns({"depth": F.lit(BITS), "shard": name, "shard_bytes": F.col("_b"), "shard_docs": F.col("_n")}).drop("_split", "_at", "_before", "_fit", "_part", "_b", "_n")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"), carry=["doc_id"])


def oracle(table: str = "documents", limit: int = LIMIT) -> str:
    return f"""
with k as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes,
                  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 15))::bigint k from {table}),
     e as (select doc_id, n_bytes, k, d, k >> (60 - d) p from k, (select unnest(range(0, 61))::int d)),
     s as (select d, p, sum(n_bytes)::bigint shard_bytes, count(*)::bigint shard_docs from e group by 1, 2),
     f as (select e.*, shard_bytes, shard_docs from e join s using (d, p) where shard_bytes <= {limit} or shard_docs = 1)
select doc_id, n_bytes, right(lpad(bin(p), 60, '0'), d) shard, d depth, shard_bytes, shard_docs
from f qualify row_number() over (partition by doc_id order by d) = 1"""


QUERIES = {"op6_sharding": op6_sharding}
ORACLE = {"op6_sharding": oracle()}

"""Mixing sources to target weights as a curriculum, in DataFrame functions only.

Every source has a target (words to take) and a schedule, a density over training time 0..1 of how its words are
spread. The documents of a source stand in the order of a hash; the words before a document are the demand that must
have been met when it comes up. Integrating the schedule gives the cumulative demand of the source, and its inverse at the
document's offset is the document's training position; a range sort by position gives the order of training.

Targets: all sources share the sum of all sizes in proportion to weight, at most `most` times a source's size, with
the excess shared again by weight until none is above: target = min(most * size, level * weight), where level is
the largest of (total - sizes of the k sources capped first) / (weights of the others). A target above the source's
size repeats the source; the last pass ends inside the document at which the target is met, so that the words
taken are the target, rounded.

Offsets in a source are found without gathering it: documents fall into fine buckets by the leading bits of their
hash (about ROWS documents), these into coarse ones, and sums are carried from coarse to fine to document, so
that no window holds more than a bucket of documents or the square root of the number of buckets.

Cases: null texts have no words; null is a source of its own, after all others; sources are ordered by code point;
a source without words gets nothing; rows that are equal in doc_id and text are interchangeable and each is
taken by itself; documents at equal positions come in any order; a very long text is one document whose size is its words; an empty
table gives an empty result; mix() replaces columns that have the names of its own, training_order() keeps all columns as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.base import WORD, column, numbered, read, renamed, small, written
from shoreline.llm.sharding import BITS, key_bits

WEIGHTS = (1, 2, 3)
OURS = ("size", "source_size", "target", "taken", "first_position")
MOST = 3
ROWS = 256
#: Sources whose targets may be sent to every executor (about 60 bytes each).
BROADCAST_SOURCES = 50_000
#: By place among the weights: (time, density) knots; early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))


def segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(time, length, density at the start, slope, demand before) of each piece, scaled to a demand of 1."""
    area = sum((b - a) * (f + g) / 2 for (a, f), (b, g) in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (a, f), (b, g) in zip(knots, knots[1:], strict=False):
        f, g = f / area, g / area
        out.append((a, b - a, f, (g - f) / (b - a), done))
        done += (b - a) * (f + g) / 2
    return out


def position(share: Column, schedule: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand is `share` of its target."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        inner = F.lit(None).cast("double")
        for t, _, f, slope, done in segments(knots):  # later pieces take over
            rest = share - F.lit(done)
            at = F.lit(t) + F.lit(2.0) * rest / (F.lit(f) + F.sqrt(F.lit(f * f) + F.lit(2 * slope) * rest))
            inner = F.when(share >= F.lit(done), at).otherwise(inner)
        out = F.when(schedule == k, inner).otherwise(out)
    return out


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes: _source, source_size. Adds _schedule, target and _take (the target in whole words). One row a source."""
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    w = sizes.withColumn("_schedule", (F.row_number().over(by_name) - 1) % len(weights))
    w = w.withColumns({"_weight": F.element_at(F.array(*map(F.lit, weights)), F.col("_schedule") + 1), "_cap": most * F.col("source_size")})
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    w = w.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    w = w.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")))
    return w.select("_source", "source_size", "_schedule", "target", F.round("target").cast("long").alias("_take"))


def _mixed(docs: DataFrame, doc_id: str, text: str, source: str, carry: list[str], weights, most: int, schedules) -> DataFrame:
    """The columns `carry` of docs as numbered(), and size, source_size, target, taken, _passes, _last, _offset, _take, _schedule, _key."""
    rows = docs.select(*numbered(carry), column(source).alias("_source"), column(doc_id).alias("_id"), F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key_bits(column(doc_id), column(text)).alias("_key"))
    if text not in carry:
        rows = written(rows, "mix-sizes")  # narrow rows: read again below instead of the texts
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit("")))
    fine_bits = max(0, math.ceil(math.log2(max(1, docs.count()) / ROWS)))
    coarse_bits = fine_bits // 2
    rows = rows.withColumn("_fine", F.shiftright("_key", BITS - fine_bits))
    fine = written(rows.groupBy("_name", "_source", "_fine").agg(F.sum("size").alias("s")), "mix-buckets")
    shares = written(targets(fine.groupBy("_source").agg(F.sum("s").alias("source_size")), weights, most).withColumn("_name", F.coalesce(F.concat(F.lit("="), "_source"), F.lit(""))).drop("_source"), "mix-targets")
    fine = fine.withColumn("_coarse", F.shiftright("_fine", fine_bits - coarse_bits))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    coarse = fine.groupBy("_name", "_coarse").agg(F.sum("s").alias("c")).withColumn("_base", F.coalesce(F.sum("c").over(earlier("_name").orderBy("_coarse")), F.lit(0))).drop("c")
    fine = fine.join(coarse, ["_name", "_coarse"]).withColumn("_base", F.col("_base") + F.coalesce(F.sum("s").over(earlier("_name", "_coarse").orderBy("_fine")), F.lit(0)))
    fine = fine.select("_name", "_fine", "_base").join(small(shares, BROADCAST_SOURCES), "_name")
    rows = rows.join(fine, ["_name", "_fine"]).withColumn("_offset", F.col("_base") + F.coalesce(F.sum("size").over(earlier("_name", "_fine").orderBy("_key", "_id", "size")), F.lit(0)))
    passes = F.coalesce(F.expr("_take div nullif(source_size, 0)"), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("_take") - passes * F.col("source_size") - F.col("_offset"), F.col("size")))
    rows = rows.withColumns({"_passes": passes, "_last": last})
    return rows.withColumn("taken", F.col("_passes") * F.col("size") + F.col("_last"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, weights=WEIGHTS, most: int = MOST, schedules=SCHEDULES) -> DataFrame:
    """The columns `carry` (all) of docs with size, source_size, target, taken and first_position (null if not taken), which take the
    place of columns of these names, in order of first_position; what isn't taken comes last, in the order of its key."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in OURS]
    rows = _mixed(docs, doc_id, text, source, kept, weights, most, schedules)
    first = F.when(F.col("taken") > 0, position(F.col("_offset") / F.col("_take"), F.col("_schedule"), schedules))
    rows = rows.withColumn("first_position", first).orderBy(F.col("first_position").asc_nulls_last(), "_key")
    return rows.select(*renamed(kept), *OURS)


def training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", schedules=SCHEDULES) -> DataFrame:
    """The rows of docs, with all their columns and no others, as often as the mix takes them, in order of position. The pass in
    which the target ends takes a document whole if it takes half of it or more."""
    rows = _mixed(docs, doc_id, text, source, docs.columns, WEIGHTS, MOST, schedules)
    copies = F.col("_passes") + (2 * F.col("_last") >= F.col("size")).cast("long")
    rows = rows.where((F.col("size") > 0) & (F.col("_take") > 0)).withColumn("_copies", copies).where("_copies > 0")
    rows = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    share = (F.col("_offset") + F.col("_pass") * F.col("source_size")) / F.col("_take")
    return rows.withColumn("_position", position(share, F.col("_schedule"), schedules)).orderBy("_position").select(*renamed(docs.columns))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), carry=["doc_id"])


def _position_sql(share: str, schedule: str) -> str:
    out = ""
    for k, knots in enumerate(SCHEDULES):
        for t, _, f, slope, done in reversed(segments(knots)):
            d = lambda x: f"cast('{x!r}' as double)"
            out += f" when {schedule} = {k} and {share} >= {d(done)} then {d(t)} + 2.0::double * ({share} - {d(done)}) / ({d(f)} + sqrt({d(f * f)} + {d(2 * slope)} * ({share} - {d(done)})))"
    return f"case{out} end"


ORACLE = {
    "op2_mixing": f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
                  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 15))::bigint k from documents),
     s as (select source, sum(size)::bigint source_size, (row_number() over (order by encode(source) nulls last) - 1) % {len(WEIGHTS)} c from d group by 1),
     w as (select *, list_value({", ".join(map(str, WEIGHTS))})[c + 1] w, {MOST} * source_size cap from s),
     l as (select *, (sum(source_size) over ())::double / 1 t, sum(cap) over o - cap before, sum(w) over () - (sum(w) over o - w) rest
           from w window o as (order by cap::double / w, encode(source) nulls last rows unbounded preceding)),
     m as (select max((t - before)::double / rest) level from l),
     t as (select source, source_size, c, least(cap::double, level * w) target, round(least(cap::double, level * w))::bigint take from w, m),
     o as (select doc_id, size, source_size, target, take, c, coalesce(sum(size) over (partition by d.source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint off
           from d join t on d.source is not distinct from t.source),
     r as (select *, case when source_size > 0 then take // source_size else 0 end passes from o),
     x as (select *, passes * size + greatest(0, least(take - passes * source_size - off, size)) taken, off::double / take share from r)
select doc_id, size, source_size, target, taken::bigint taken, case when taken > 0 then {_position_sql("share", "c")} end first_position from x""",
}
QUERIES = {"op2_mixing": op2_mixing}

"""What changed between two snapshots of a table, with rows that only got another key recognised.

1. Each snapshot becomes narrow rows: the key, an MD5 digest of each compared column, and the SHA-256 of the row. Texts are read once and
   are not shuffled.
2. Rows of both snapshots meet in buckets of hashed keys (cogrouped applyInPandas): equal keys pair, by pandas' merge.
3. What is left meets in buckets of hashed contents: in each content the earlier rows are sorted by key upwards, the later downwards, and
   numbered by cumcount, and equal numbers pair.

A key or content of more than BLOCK rows isn't one group: its rows are range-sorted over the cluster in the order of their pairing,
numbered from the counts of the ranges, and cut into blocks of BLOCK numbers, each of them a unit of its own that may be in any bucket. Rows with equal
numbers are in equal blocks, so the blocks pair what the whole would. A bucket holds some BUCKET_ROWS rows of many units. The driver gets
counts only, and nothing is broadcast.

Cases: nulls equal only nulls, in compared columns (a null is not the text `~`) and in keys (a null key is the smallest); empty and very long
texts are digested whole; where a key is repeated, its rows pair in the order of their digests, the i-th earlier with the i-th later
one, and the rest is unpaired; repeated rows are told apart by number; empty snapshots give inserts or deletes only; other
columns are ignored, whatever their names. Keys are integers (returned as long) or strings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.base import column, crc_mod, freed, read, written

COMPARED = ("text", "lang", "source")
BUCKET_ROWS, BLOCK = 1 << 15, 1 << 14
NONE = "~"


def narrow(rows: DataFrame, key: str, compared: tuple[str, ...]) -> DataFrame:
    """key (never null), none (whether it was), d0, d1, ... (digests), sha, _row (a number of its own), as a written table."""
    kind = "string" if rows.schema[key].dataType.simpleString() == "string" else "long"
    own = column(key).cast(kind)
    digests = [F.coalesce(F.md5(column(c).cast("string").cast("binary")), F.lit(NONE)).alias(f"d{k}") for k, c in enumerate(compared)]
    whole = F.concat_ws("\n", *(F.coalesce(column(c).cast("string"), F.lit(NONE)) for c in compared))
    out = rows.select(F.coalesce(own, F.lit("" if kind == "string" else 0).cast(kind)).alias("key"), own.isNull().alias("none"), *digests, F.sha2(whole.cast("binary"), 256).alias("sha"), F.monotonically_increasing_id().alias("_row"))
    return written(out, "snapshot")


def in_blocks(rows: DataFrame, unit: Column, order: list[Column], block: int) -> DataFrame:
    """Adds _unit and _block: which run of `block` rows of its unit, in this order, a row is in."""
    rows = rows.withColumn("_unit", unit)
    large = written(rows.groupBy("_unit").count().where(F.col("count") > block).select("_unit"), "large-units")
    few = rows.withColumn("_block", F.lit(0).cast("long"))
    if large.isEmpty():
        freed(large)
        return few
    few = few.join(large.hint("merge"), "_unit", "left_anti")
    many = written(rows.join(large.hint("merge"), "_unit", "left_semi"), "large-rows")
    by = ["_unit", *order, "_row"]
    ranges = many.repartitionByRange(max(1, math.ceil(many.count() / (4 * block))), *by).sortWithinPartitions(*by)
    ranges = written(ranges.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    starts = ranges.groupBy("_unit", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_unit").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.select("_unit", "_range", (F.col("_first") - before).alias("_zero"))
    numbered = ranges.join(starts.hint("merge"), ["_unit", "_range"]).withColumn("_block", F.call_function("div", F.col("_at") - F.col("_zero"), F.lit(block)))
    freed(many)
    return few.unionByName(numbered.select(*few.columns))


def bucketed(rows: DataFrame, buckets: int):
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("_unit", "_block"), F.lit(buckets))).groupBy("_bucket")


def aligned(old, new):
    """Positions of rows of equal unit, block and number in the two sorted frames, -1 where there is none."""
    import numpy as np

    by = ["_unit", "_block"]
    left, right = (t[by].assign(_i=t.groupby(by, sort=False).cumcount(), **{name: np.arange(len(t))}) for t, name in ((old, "a"), (new, "b")))
    both = left.merge(right, how="outer", on=[*by, "_i"])
    return (both[c].fillna(-1).to_numpy(np.int64) for c in "ab")


def by_key(old: DataFrame, new: DataFrame, compared: tuple[str, ...], bucket_rows: int, block: int) -> DataFrame:
    """side (pair, old, new), key, none, old_key, old_none, changed, sha, content (of unpaired rows)."""
    kind, d = old.schema["key"].dataType.simpleString(), [f"d{k}" for k in range(len(compared))]
    names = ["key", "none", *d, "sha", "_row", "_unit", "_block"]

    def pair(left, right):
        import numpy as np
        import pandas as pd

        left, right = (t.reindex(columns=names).sort_values(["_unit", "_block", *d, "_row"], ignore_index=True) for t in (left, right))  # an empty side has no columns
        a, b = aligned(left, right)
        met = (a >= 0) & (b >= 0)
        x, y = left.take(a[met]).reset_index(drop=True), right.take(b[met]).reset_index(drop=True)
        changed = pd.Series("", index=x.index, dtype=object)
        for c, name in zip(d, compared, strict=True):
            changed = changed.where(x[c] == y[c], np.where(changed == "", name, changed + "," + name))
        out = [pd.DataFrame({"side": "pair", "key": y["key"], "none": y["none"], "old_key": x["key"], "old_none": x["none"], "changed": changed, "sha": y["sha"], "content": ""})]
        for side, t, at in (("old", left, a[b < 0]), ("new", right, b[a < 0])):
            t = t.take(at)
            content = t[d[0]].str.cat([t[c] for c in d[1:]], sep=" ") if len(t) else t["sha"]
            out.append(pd.DataFrame({"side": side, "key": t["key"], "none": t["none"], "old_key": t["key"], "old_none": t["none"], "changed": "", "sha": t["sha"], "content": content}))
        return pd.concat([t for t in out if len(t)] or out[:1])

    buckets = max(1, math.ceil((old.count() + new.count()) / bucket_rows))
    unit = F.when(F.col("none"), "").otherwise(F.concat(F.lit("="), F.col("key").cast("string")))
    sides = [bucketed(in_blocks(t, unit, [F.col(c) for c in d], block), buckets) for t in (old, new)]
    return sides[0].cogroup(sides[1]).applyInPandas(pair, f"side string, key {kind}, none boolean, old_key {kind}, old_none boolean, changed string, sha string, content string")


def by_content(old: DataFrame, new: DataFrame, bucket_rows: int, block: int) -> DataFrame:
    """key, none, old_key, old_none, op (rekey, delete, insert), sha of unpaired rows: the i-th smallest earlier key of a content with its i-th largest later one."""
    kind = old.schema["key"].dataType.simpleString()
    names = ["key", "none", "sha", "_unit", "_block"]

    def pair(left, right):
        import pandas as pd

        left, right = (t.reindex(columns=names) for t in (left, right))
        # a null key is the smallest
        left = left.sort_values(["_unit", "_block", "none", "key"], ascending=[True, True, False, True], ignore_index=True)
        right = right.sort_values(["_unit", "_block", "none", "key"], ascending=[True, True, True, False], ignore_index=True)
        a, b = aligned(left, right)
        out = []
        for op, x, y in (("rekey", a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]), ("delete", a[b < 0], None), ("insert", None, b[a < 0])):
            one = left.take(x).reset_index(drop=True) if x is not None else None
            two = right.take(y).reset_index(drop=True) if y is not None else None
            at, was = (two if two is not None else one), (one if one is not None else two)
            sha = two["sha"] if two is not None else None
            out.append(pd.DataFrame({"key": at["key"], "none": at["none"], "old_key": was["key"], "old_none": was["none"] if one is not None else True, "op": op, "sha": sha}, index=at.index))
        return pd.concat([t for t in out if len(t)] or out[:1])

    buckets = max(1, math.ceil((old.count() + new.count()) / bucket_rows))
    orders = [F.col("none").desc(), F.col("key")], [F.col("none"), F.col("key").desc()]
    sides = [bucketed(in_blocks(t, F.col("content"), order, block), buckets) for t, order in zip((old, new), orders, strict=True)]
    return sides[0].cogroup(sides[1]).applyInPandas(pair, f"key {kind}, none boolean, old_key {kind}, old_none boolean, op string, sha string")


def diff(earlier: DataFrame, later: DataFrame, key: str = "doc_id", compared: tuple[str, ...] = COMPARED, bucket_rows: int = BUCKET_ROWS, block: int = BLOCK) -> DataFrame:
    """key, old_key, op, changed, row_sha256 of each pair and each unpaired row. op: same, update, rekey, insert, delete."""
    old, new = narrow(earlier, key, compared), narrow(later, key, compared)
    met = written(by_key(old, new, compared, bucket_rows, block), "snapshot-keys")
    freed(old, new)
    pairs = met.where("side = 'pair'").withColumn("op", F.when(F.col("changed") == "", "same").otherwise("update"))
    # columns under aliases: Spark loses those of the second side of a cogroup that has the same as the first
    open_rows = [met.where(F.col("side") == s).select(*(F.col(c).alias(c) for c in ("key", "none", "sha", "content")), F.monotonically_increasing_id().alias("_row")) for s in ("old", "new")]
    rest = by_content(*open_rows, bucket_rows, block).withColumn("changed", F.lit(""))
    names = ["key", "none", "old_key", "old_none", "op", "changed", "sha"]
    both = pairs.select(*names).unionByName(rest.select(*names))
    return both.select(F.when(~F.col("none"), F.col("key")).alias("key"), F.when(~F.col("old_none"), F.col("old_key")).alias("old_key"), "op", "changed", F.col("sha").alias("row_sha256"))


def later_snapshot(docs: DataFrame) -> DataFrame:
    """The documents of op13_snapshot_diff as they are later, by the crc32 of their key modulo 10."""
    m, key = crc_mod(F.col("doc_id"), 10), F.col("doc_id")
    rows = docs.select("doc_id", "text", "lang", "source", m.alias("m")).where("m != 0")
    m, other = F.col("m"), -1 - key
    keys = F.when(m.isin(3, 4), F.array(other)).when(m == 5, F.array(key, other)).otherwise(F.array(key))
    text = F.when(m == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text"))
    source = F.when(m == 2, F.col("lang")).when(m != 4, F.col("source"))
    return rows.select(F.explode(keys).alias("doc_id"), text.alias("text"), F.when(m == 2, F.col("source")).otherwise(F.col("lang")).alias("lang"), source.alias("source"))


def op13_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return diff(docs, later_snapshot(docs))


def oracle(table: str = "documents", later: str | None = None) -> str:
    """Of a table and a later one, or the later one that later_snapshot makes."""
    made = f"""
c as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda x: ascii(x)::bigint)),
                    lambda r, x: xor(r >> 8, t[1 + (xor(r, x) & 255)])), 4294967295) % 10 m from {table}, steps),
later as (select unnest(case when m in (3, 4) then [-1 - doc_id] when m = 5 then [doc_id, -1 - doc_id] else [doc_id] end) doc_id,
                 case when m = 1 then coalesce(text, '') || '+' else text end text, case when m = 2 then source else lang end lang,
                 case when m = 2 then lang when m <> 4 then source end source from c where m <> 0 and doc_id is not null),"""
    digest = "coalesce(md5(text), '~') || ' ' || coalesce(md5(lang), '~') || ' ' || coalesce(md5(source), '~')"
    return f"""
with recursive g(i, k, v) as (select range::bigint, 0, range::bigint from range(256) union all select i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from g where k < 8),
steps as (select list(v order by i) t from g where k = 8),{made if later is None else f" later as (select * from {later}),"}
u as (select 0 side, doc_id k, text, lang, source, row_number() over (partition by doc_id order by {digest}) n from {table}
      union all select 1, doc_id, text, lang, source, row_number() over (partition by doc_id order by {digest}) from later),
p as (select k, n, first({{'text': text, 'lang': lang, 'source': source}}) filter (where side = 0) a, first({{'text': text, 'lang': lang, 'source': source}}) filter (where side = 1) b from u group by 1, 2),
l as (select 0 side, k, a.text, a.lang, a.source, row_number() over (partition by a order by k nulls first) n from p where b is null
      union all select 1, k, b.text, b.lang, b.source, row_number() over (partition by b order by k desc nulls last) from p where a is null),
q as (select text, lang, source, n, count(*) filter (where side = 0) old, count(*) filter (where side = 1) new, max(k) filter (where side = 0) ok, max(k) filter (where side = 1) nk from l group by 1, 2, 3, 4),
r as (select k "key", k old_key, concat_ws(',', case when a.text is distinct from b.text then 'text' end, case when a.lang is distinct from b.lang then 'lang' end,
             case when a.source is distinct from b.source then 'source' end) changed, b.text, b.lang, b.source, null::varchar op from p where a is not null and b is not null
      union all select case when new > 0 then nk else ok end, ok, '', text, lang, source, case when new = 0 then 'delete' when old = 0 then 'insert' else 'rekey' end from q)
select "key", old_key, coalesce(op, case when changed = '' then 'same' else 'update' end) op, changed,
       case when op is distinct from 'delete' then sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) end row_sha256 from r"""


QUERIES = {"op13_snapshot_diff": op13_snapshot_diff}
ORACLE = {"op13_snapshot_diff": oracle()}

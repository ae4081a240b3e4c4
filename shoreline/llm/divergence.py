"""Divergence of the sources of each language: how far apart the term shares of any two sources are, and which terms a source has more
of than its language.

All of it is relational. Texts become rows of terms, counted by (lang, source, term), in one pass that also counts documents: of the sorted
terms of a document each that differs from the one before it stands for the document. A language keeps the terms of enough
documents. Every (lang, source) group gets all kept terms of its language, absent ones with a count of 0, and from the smoothed counts whole
shares in billionths. A self-join on language and term compares the groups pair by pair, each pair once, and sums what they differ in.

Languages are few and their vocabularies large, so nothing is joined by language alone: groups meet the vocabulary by language
and a salt, of which every group has all. Counts are multiplied as decimals, so no count is too large. Memory of a task is
that of hash and sort operators that spill. The work of the pairs is that of the method: groups of a language squared, times its vocabulary.

Cases: null text, lang and source count as ''; a document without terms still makes its group; a language without kept terms has
pairs of value 0 and no terms; a language with one source has no pairs; texts of any length are taken whole; repeated rows
are documents of their own; ties are ranked by the item's bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.base import column, freed, read, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SMOOTHING, UNIT = 30, 50, 5, 10**9
SALTS = 256


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with the term). A group without terms has one row of the null term."""
    lower = F.translate(F.coalesce(column(text), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    found = docs.select(*(F.coalesce(column(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))), F.sort_array(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("terms"))
    before = F.concat(F.array(F.lit("")), F.slice("terms", 1, F.greatest(F.lit(0), F.size("terms") - 1)))
    rows = found.select("lang", "source", F.inline_outer(F.arrays_zip(F.col("terms").alias("term"), before.alias("before"))))
    return rows.groupBy("lang", "source", "term").agg(F.count("term").alias("n"), F.count_if(F.col("term") != F.col("before")).alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 5) / (total + 5 * terms)), exactly."""
    big = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", big(n + SMOOTHING) * F.lit(UNIT).cast("decimal(10,0)"), big(total + SMOOTHING * terms)) + 1


def ranked(rows: DataFrame, part: str, most: int | None = None) -> DataFrame:
    """lang, source, part, item, value, rank of rows of lang, source, item, value."""
    r = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    r = r if most is None else r.where(F.col("rank") <= most)
    return r.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")


def dense_shares(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Of term_counts: the groups (lang, source, total, lang_total, terms: how many their language keeps), and lang, source, term, n, p, q of each kept
    term in each group: its occurrences, the group's share and the language's. Both are written tables."""
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least_docs).drop("docs")
    kept = written(kept, "kept-terms")
    have = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    groups = counts.select("lang", "source").distinct().join(have.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = written(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "terms"))), "groups")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    every = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    n = F.coalesce("n", F.lit(0).cast("long"))
    dense = every.join(have, ["lang", "source", "term"], "left")
    dense = written(dense.select("lang", "source", "term", n.alias("n"), share(n, F.col("total"), F.col("terms")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "dense-shares")
    freed(kept, have)
    return groups, dense


def pair_distances(groups: DataFrame, dense: DataFrame) -> DataFrame:
    """lang, source, item (another source of the language), value: the sum of what their shares differ in, both ways."""
    a, b = (dense.select("lang", "term", F.col("source").alias(s), F.col("p").alias(p)) for s, p in (("source", "p"), ("item", "o")))
    once = a.join(b, ["lang", "term"]).where("source < item").groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("o"))).alias("value"))
    bare = groups.where("terms = 0").select("lang", "source")
    once = once.unionByName(bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long")))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return once.select("lang", F.explode(ways).alias("w"), "value").select("lang", "w.source", "w.item", "value")


def telling_terms(dense: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has, and more of than its language), value: how much more."""
    return dense.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of each source to the others (part `pair`), and its `top` most telling terms (part `term`)."""
    counts = written(term_counts(docs, text, lang, source), "term-counts")
    groups, dense = dense_shares(counts, least_docs)
    freed(counts)
    return ranked(pair_distances(groups, dense), "pair").unionByName(ranked(telling_terms(dense), "term", top))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


def oracle(table: str = "documents", least_docs: int = LEAST_DOCS, top: int = TOP) -> str:
    return rf"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
                  regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') ts from {table}),
     t as (select r, lang, source, unnest(ts) term from d),
     k as (select lang, term, count(*)::bigint ln from t group by 1, 2 having count(distinct r) >= {least_docs}),
     l as (select lang, count(*) v, sum(ln)::hugeint ls from k group by 1),
     c as (select lang, source, term, count(*) n from t join k using (lang, term) group by 1, 2, 3),
     g as (select distinct lang, source from d),
     e as (select g.lang, g.source, k.term, coalesce(n, 0)::hugeint n, ln::hugeint ln, v::hugeint v, ls,
                  (sum(coalesce(n, 0)) over (partition by g.lang, g.source))::hugeint s
           from g join k on g.lang = k.lang join l on l.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
     p as (select lang, source, term, n, 1 + ({UNIT}::hugeint * (n + 5)) // (s + 5 * v) p, 1 + ({UNIT}::hugeint * (ln + 5)) // (ls + 5 * v) q from e),
     f as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
     u as (select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value
           from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
           union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int "rank" from u) where part = 'pair' or "rank" <= {top}"""


QUERIES = {"op11_divergence": op11_divergence}
ORACLE = {"op11_divergence": oracle()}

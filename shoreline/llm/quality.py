"""Quality rules with risk-controlled cutoffs.

Each rule rejects a document whose score is above a cutoff. Documents with a quality label are the holdout. For
every stratum (language) and rule, cutoffs are tried from the most lenient to stricter ones; a cutoff is certified
while the exact binomial tail P(Bin(good, alpha / rules) <= good rejected) is at most delta / (rules * strata), and the
first that isn't ends the sequence (fixed-sequence testing needs no further correction within a rule; Bonferroni
covers rules and strata). Of the certified cutoffs the one with the best balance of rejected bad and rejected good is
used, none if none helps. With probability 1 - delta, every stratum loses at most a share alpha of its good
documents to the rules together.

Cases: null texts have no words; documents with a null language are a stratum of their own; a stratum without enough
labels has no certified cutoff and keeps all that the base rules keep; labels that are null, or that contradict each
other for a doc_id, are not used; repeated labels count once, as do repeated rows of a labelled document (the
least by stratum and scores stands for them), while every row is judged; a very long text is measured whole; documents at a cutoff pass; empty tables give no cutoffs or no rows;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import SPACES, as_strings, hashed_words, mix, raw, read, slices, spans, trimmed, written

SYMBOLS = "#*$%&|<>"
#: Scores and their cutoffs, most lenient first.
RULES = {
    "symbols": (2.0, 1.0, 0.7, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "repeats": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1),
    "same_lines": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.1),
    "capitals": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
}
ALPHA, DELTA = 0.05, 0.05
#: How many rejected shares of bad documents weigh as much as one of good ones.
COST = 4.0
#: Strata whose cutoffs may be sent to every executor (about 100 bytes each).
BROADCAST_STRATA = 10_000

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def features(col: pa.Array) -> list[np.ndarray]:
    """FEATURES of each text; repeated windows are found by a hash of three word hashes within each text."""
    parts = []
    for i, k in slices(col):
        part = col.slice(i, k)
        data, off = raw(part)
        s, e, first = spans(data, off)
        n = np.diff(first)
        doc = np.repeat(np.arange(k), n)
        begins = (data & 0xC0) != 0x80
        sums = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[off])  # noqa: E731, B023
        chars = sums(begins & SPACES[data])
        symbols = sums(SYMBOL[data])
        capitals = sums((data >= 65) & (data <= 90))
        h, _ = hashed_words(part)
        repeat = np.zeros(k, np.int64)
        if len(h) >= 3:
            g = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
            at = np.flatnonzero(doc[:-2] == doc[2:])
            key = mix(g[at] ^ (doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(at), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            word = np.zeros(len(h), bool)
            for j in range(3):
                word[at[twice] + j] = True
            repeat = np.bincount(doc[word], minlength=k)
        lines = [[x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] for t in part.to_pylist()]
        dup = np.array([len(x) - len(set(x)) for x in lines], np.int64)
        parts.append([n, chars, symbols, dup, repeat, np.array([len(x) for x in lines], np.int64), capitals])
    return [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 7


SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS.encode())] = True


def measure(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry` of docs and FEATURES of each text."""
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    names = [*carry, *(x.split()[0] for x in FEATURES.split(", "))]

    def run(batches):
        for b in trimmed(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, features(as_strings(b.column(0))))], names=names)

    return docs.select(text, *carry).mapInArrow(run, f"{kinds}, {FEATURES}")


def scores() -> dict:
    """Rule scores, per word, line or character."""
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    return {"symbols": part("n_symbols", F.col("n_words")), "repeats": part("n_repeat_words", F.col("n_words")), "same_lines": part("n_dup_lines", F.col("n_lines")), "capitals": part("n_capitals", F.col("word_chars"))}


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    if n <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(min(k, n) + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose(counts: dict[str, list[tuple[int, int]]], good: int, bad: int, tests: int, alpha: float = ALPHA, delta: float = DELTA, rules=None) -> dict[str, float]:
    """counts: for each rule the (good, bad) rejected at each of its cutoffs. The cutoff of each rule that has one."""
    rules, out = rules or RULES, {}
    for rule, cutoffs in rules.items():
        best, gain = None, 0.0
        for cutoff, (g, b) in zip(cutoffs, counts[rule], strict=True):
            if tail(good, g, alpha / len(rules)) > delta / tests:
                break
            value = b / max(bad, 1) - COST * g / max(good, 1)
            if value > gain:
                best, gain = cutoff, value
        if best is not None:
            out[rule] = best
    return out


def learn_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA, doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """stratum, labelled good and bad, and the cutoff of each rule (null: the rule is off). All labelled documents count."""
    rules = RULES
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_q"), F.max(label).alias("_r")).where("_q = _r").select("_id", "_q")
    s = scores()
    held = measured.select(F.col(doc_id).alias("_id"), F.col(stratum).alias("stratum"), *(x.alias(r) for r, x in s.items())).join(marks, "_id")
    # a labelled document is one trial of the binomial, however many rows it has
    held = held.groupBy("_id").agg(F.min(F.struct("stratum", *rules, "_q")).alias("h")).select("h.*")
    each = [F.sum(F.when((F.col(r) > c) & (F.col("_q") == q), 1).otherwise(0)).alias(f"{r}_{k}_{q}") for r, cs in rules.items() for k, c in enumerate(cs) for q in (1, 0)]
    table = written(held.groupBy("stratum").agg(F.sum("_q").alias("good"), F.sum(1 - F.col("_q")).alias("bad"), *each), "quality-counts")
    strata = max(1, table.count())
    kind = table.schema["stratum"].dataType.simpleString()

    def run(batches):
        for b in trimmed(batches):
            rows = []
            for r in b.to_pylist():
                counts = {x: [(r[f"{x}_{k}_1"], r[f"{x}_{k}_0"]) for k in range(len(cs))] for x, cs in rules.items()}
                cut = choose(counts, r["good"], r["bad"], len(rules) * strata, alpha, delta)
                rows.append([r["stratum"], r["good"], r["bad"], *(cut.get(x) for x in rules)])
            cols = list(zip(*rows, strict=True)) or [[]] * (3 + len(rules))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, [b.schema.field("stratum").type, pa.int64(), pa.int64(), *[pa.float64()] * len(rules)], strict=True)], names=["stratum", "good", "bad", *rules])

    return table.mapInArrow(run, f"stratum {kind}, good long, bad long, {', '.join(f'{x} double' for x in rules)}")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, FEATURES, base_failed, rejected_by (names of rules) and kept for every row of docs."""
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.col(stratum).alias("_stratum"))
    measured = written(measure(plain, "_text", ("doc_id", "_stratum")), "quality-features")
    cutoffs = written(learn_cutoffs(measured, labels, "_stratum", alpha, delta), "quality-cutoffs").select(F.col("stratum").alias("_s"), *(F.col(r).alias(f"_{r}") for r in RULES))
    if cutoffs.count() <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    rows = measured.join(cutoffs, F.col("_stratum").eqNullSafe(F.col("_s")), "left")
    s = scores()
    rejected = F.array_compact(F.array(*(F.when(s[r] > F.col(f"_{r}"), F.lit(r)) for r in RULES)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *(x.split()[0] for x in FEATURES.split(", ")), failed.alias("base_failed"), rejected.alias("rejected_by"), (~failed & (F.size(rejected) == 0)).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE: dict[str, str] = {}

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shoreline.llm.mixing import MOST, SCHEDULES, WEIGHTS, _mixed, mix, position, segments, training_order


def shares(sizes, weights=(1, 2, 3), most=3):
    """Sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        now = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s: most * sizes[s] for s in free if now[s] > most * sizes[s]}
        if not over:
            return fixed | now
        fixed |= over


def docs(spark, n=600, seed=2):
    r = random.Random(seed)
    names = ["b", "a", None, "é", "z", "tiny", "none"]
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choice(names[:5])) for i in range(n)] + [(n, "one two", "tiny"), (n + 1, None, "none"), (n + 2, "", "a"), (0, "dup dup", "b"), (0, "dup dup", "b")]
    return rows, spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, source string, target double").repartition(4)


def test_targets_and_taken(spark):
    rows, df = docs(spark)
    got = mix(df).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = shares(sizes)
    taken = Counter()
    for x in got:
        assert abs(x.target - want[x.source]) < 1e-6 and x.source_size == sizes[x.source]
        assert 0 <= x.taken <= 3 * x.size and (x.first_position is None) == (x.taken == 0)
        taken[x.source] += x.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mix(df.repartition(2)).collect()
    assert Counter((x.doc_id, x.text, x.taken) for x in got) == Counter((x.doc_id, x.text, x.taken) for x in again)


def test_positions_follow_the_schedules(spark):
    rows, df = docs(spark, 3000, 5)
    names = sorted({s for *_, s in rows if s is not None}) + [None]
    at = defaultdict(list)
    placed = _mixed(df, "doc_id", "text", "source", ["source"], WEIGHTS, MOST, SCHEDULES).where("taken > 0")
    placed = placed.select(F.col("_c0").alias("source"), F.col("_offset").alias("offset"), F.col("_take").alias("take"), position(F.col("_offset") / F.col("_take"), F.col("_schedule")).alias("first_position"))
    for x in placed.collect():
        assert 0 <= x.first_position <= 1
        k = names.index(x.source) % 3
        share = x.offset / x.take
        demand = next(d + (f + slope * (x.first_position - t) / 2) * (x.first_position - t) for t, _, f, slope, d in reversed(segments(SCHEDULES[k])) if x.first_position >= t - 1e-12)
        assert abs(demand - share) < 1e-9
        at[x.source].append(x.first_position)
    order = [x.doc_id for x in training_order(df.limit(500)).collect()]
    assert order and training_order(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix(df).count() == 0 and training_order(df).count() == 0


def test_clashing_names(spark):
    names = "size int, _key string, _source int, _name string, target string, _c0 int, _take int, `a.b` int"
    rows = [(k, f"w{k} " * (1 + k % 5), "ab"[k % 2], k, "k", 1, "n", "t", 5, 6, 7) for k in range(40)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, source string, {names}")
    out = training_order(df)
    assert out.columns == df.columns and {tuple(x) for x in out.collect()} <= set(rows)
    assert mix(df).columns == ["doc_id", "text", "source", "_key", "_source", "_name", "_c0", "_take", "a.b", "size", "source_size", "target", "taken", "first_position"]
    assert {x.doc_id: x.size for x in mix(df).collect()} == {k: 1 + k % 5 for k in range(40)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 1_000_000, "a"), (2, "x" * 3_000_000, "a"), (3, "y z", "b")], "doc_id long, text string, source string")
    got = {x.doc_id: (x.size, x.target, x.taken) for x in mix(df, carry=["doc_id"]).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1_000_000, 2: 1, 3: 2} and got[3][1:] == (6.0, 6)

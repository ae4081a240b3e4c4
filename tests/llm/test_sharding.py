import hashlib
import random
from collections import defaultdict

from shoreline.llm.sharding import assign_shards


def brute(docs, limit):
    """Splits oversized buckets one bit at a time."""
    key = {n: int(hashlib.md5(f"{'' if i is None else i} {t or ''}".encode()).hexdigest()[:15], 16) for n, (i, t) in enumerate(docs)}
    size = lambda n: len((docs[n][1] or "").encode())
    out, todo = {}, [("", list(key))] if docs else []
    while todo:
        p, rows = todo.pop()
        total = sum(map(size, rows))
        if total <= limit or len(rows) == 1 or len(p) == 60:
            for n in rows:
                out[n] = (p, total, len(rows))
            continue
        parts = defaultdict(list)
        for n in rows:
            parts[p + format(key[n], "060b")[len(p)]].append(n)
        todo += parts.items()
    return out


def test_directory(spark):
    r = random.Random(4)
    docs = [(i, "é" * r.randrange(200)) for i in range(300)] + [(400, None), (401, ""), (None, "x" * 3000), (7, "y" * 50), (7, "y" * 50)]
    df = spark.createDataFrame([(i, t, "old", n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, shard string, n int").repartition(3)
    for limit in (200, 1000, 10**6):
        got = {x.n: (x.shard, x.shard_bytes, x.shard_docs) for x in assign_shards(df, limit).collect()}
        assert got == brute(docs, limit)


def test_copies_over_the_limit(spark):
    docs = [(1, "z" * 100)] * 25 + [(2, "q" * 30), (3, "q" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = assign_shards(df, 300).collect()
    assert len(got) == 27 and sorted(x.text for x in got) == sorted(t for _, t in docs)
    assert all(x.shard_bytes <= 300 for x in got)
    by = defaultdict(int)
    for x in got:
        by[x.shard] += x.n_bytes
    assert all(by[x.shard] == x.shard_bytes for x in got) and len([s for s in by if "." in s]) == 9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, depth string")
    assert assign_shards(df).columns == ["doc_id", "text", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    assert assign_shards(df).count() == 0


def test_clashing_names(spark):
    rows = [(k, "x" * k, k, "k", "c", "d", 9) for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, _cell string, _depth string, _c0 string, n_bytes int")
    out = assign_shards(df, 100)
    assert out.columns == ["doc_id", "text", "_key", "_cell", "_depth", "_c0", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs"]
    assert {(x.doc_id, x._key, x._cell, x._depth, x._c0, x.n_bytes) for x in out.collect()} == {(k, k, "k", "c", "d", k) for k in range(50)}


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (2, "a"), (3, None)], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.shard_docs) for x in assign_shards(df, 1000).collect()}
    assert got[1] == (4_000_000, 1) and got[2][0] == 1 and got[3][0] == 0

"""The pipeline against one process that does each stage by its definition."""

import random
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from shoreline.llm import mixing, sharding, toxicity
from test_decontaminate import brute as contaminated
from test_mixing import shares
from test_near_dedup import brute as groups
from test_sharding import brute as shards
from test_toxicity import texts


def tables(folder):
    r = random.Random(12)
    bad, good = texts(60, 1, True), texts(200, 2, False)
    rows = [(i, t, r.choice(["en", None]), r.choice(["a", "b", "c", None]), len(t)) for i, t in enumerate(bad + good)]
    items = [(k, " ".join(f"q{k}x{j}" for j in range(14))) for k in range(5)]
    for k in range(12):
        rows.append((300 + k, rows[100 + k][1] + " " + items[k % 5][1], "en", "a", 1))
    for k in range(40):
        w = rows[150][1].split()
        w[r.randrange(len(w))] = f"changed{k}"
        rows.append((400 + k, rows[160 + k][1] if k % 2 else " ".join(w), "en", "b", 1))
    rows += [(500, None, None, None, None), (501, "", "en", "a", 0), (502, "one", "en", "a", 3)]
    write = lambda name, cols, data, kinds: pq.write_table(pa.table({c: pa.array(list(x), k) for c, x, k in zip(cols, zip(*data), kinds)}), folder / f"{name}.parquet")
    i, s = pa.int64(), pa.string()
    write("documents", ["doc_id", "text", "lang", "source", "n_chars"], rows, [i, s, s, s, i])
    write("labels", ["doc_id", "quality", "toxic"], [(k, 1, int(k < 60)) for k in range(260)], [i, pa.int32(), pa.int32()])
    write("benchmark", ["item_id", "text"], items, [i, s])
    return rows, items


def test_brute_force(spark, tmp_path):
    rows, items = tables(tmp_path)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()

    labelled = [(k, t) for k, t, *_ in rows if k < 260]
    m = toxicity.fit([t for k, t in labelled if k < 60], [t for k, t in labelled if k >= 60])
    plain, both = toxicity.compressor(m.ordinary), toxicity.compressor(m.toxic + m.ordinary)
    import numpy as np

    kept = [x for x in rows if m(np.array([toxicity.features(x[1] or "", plain, both)]))[0] < 0.5]
    assert 0 < sum(x[0] < 60 for x in kept) + 55 < 75 and sum(x[0] >= 60 for x in kept) > 230
    kept = [kept[min(g)] for g in groups([(x[0], x[1]) for x in kept])]
    bad = {x[0] for x in contaminated([(x[0], x[1]) for x in kept], items) if x[2]}
    kept = [x for x in kept if x[0] not in bad]

    size = {x[0]: len((x[1] or "").split()) for x in kept}
    total = Counter()
    for x in kept:
        total[x[3]] += size[x[0]]
    want, target = [], shares(total)
    import hashlib

    key = {x[0]: int(hashlib.md5(f"{x[0]} {x[1] or ''}".encode()).hexdigest()[:15], 16) for x in kept}
    for s in total:
        take, at = round(target[s]), 0
        passes, rest = divmod(take, total[s]) if total[s] else (0, 0)
        for x in sorted((x for x in kept if x[3] == s), key=lambda x: (key[x[0]], x[0])):
            last = max(0, min(rest - at, size[x[0]]))
            at += size[x[0]]
            if size[x[0]] and take:
                want += [x] * (passes + (2 * last >= size[x[0]]))
    assert Counter((x.doc_id, x.text, x.source) for x in got) == Counter((x[0], x[1], x[3]) for x in want)
    place = shards([(x[0], x[1]) for x in want], sharding.LIMIT)
    assert Counter((x.doc_id, x.shard, x.shard_bytes) for x in got) == Counter((want[n][0], p, b) for n, (p, b, _) in place.items())
    assert mixing.MOST == 3 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_odd_tables(spark, tmp_path):
    """Empty tables, null ids and texts, repeated rows, a very long text and columns with names of the operators' own."""
    def write(folder, docs):
        folder.mkdir()
        i, s = pa.int64(), pa.string()
        names = {"doc_id": i, "text": s, "lang": s, "source": s, "n_chars": i, "size": s, "node": s, "_key": i, "_h": s, "shard": s, "a.b": s}
        pq.write_table(pa.table({c: pa.array([d.get(c) for d in docs], k) for c, k in names.items()}), folder / "documents.parquet")
        pq.write_table(pa.table({"doc_id": pa.array([], i), "toxic": pa.array([], pa.int32())}), folder / "labels.parquet")
        pq.write_table(pa.table({"item_id": pa.array([], i), "text": pa.array([], s)}), folder / "benchmark.parquet")
        return corpus_pipeline.run(spark, f"file://{folder}")

    assert write(tmp_path / "empty", []).count() == 0
    r = random.Random(5)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(200_000))
    docs = [{"doc_id": None, "text": "a b c d e f", "source": None}, {"doc_id": 1, "text": long, "source": "a", "size": "keep", "_key": 7, "_h": "h", "a.b": "dot"}, {"doc_id": 2, "text": None, "source": "a"}, {"doc_id": 3, "text": "x" * 2_000_000, "source": "b"}]
    docs += [{"doc_id": 4, "text": "p q r s t u v", "source": "b", "node": "n"}] * 5
    got = write(tmp_path / "odd", docs).collect()
    assert {x.doc_id for x in got} == {None, 1, 3, 4} and {x.text for x in got if x.doc_id == 1} == {long}
    assert {(x.size, x._key, x._h, x["a.b"]) for x in got if x.doc_id == 1} == {("keep", 7, "h", "dot")} and {x.node for x in got if x.doc_id == 4} == {"n"}
    assert all(x.shard is not None for x in got) and max(Counter(x.doc_id for x in got).values()) <= 3


def test_nothing_is_left(spark, tmp_path):
    """Tables that a run wrote are deleted when its session stops."""
    import subprocess

    code = f"""
import sys; sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
from pyspark.sql import SparkSession
import corpus_pipeline, os
s = SparkSession.builder.master('local[2]').config('spark.checkpoint.dir', 'file://{tmp_path}/shared').config('spark.sql.shuffle.partitions', '2').config('spark.ui.enabled', 'false').getOrCreate()
assert corpus_pipeline.run(s, '/root/testdata/sf0.001').count()
assert os.listdir('{tmp_path}/shared')
s.stop()
assert [x for x in os.listdir('{tmp_path}/shared') if '-' in x and not x.count('-') == 4] == [], os.listdir('{tmp_path}/shared')
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]

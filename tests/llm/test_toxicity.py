import random

import numpy as np

from shoreline.llm import toxicity
from shoreline.llm.toxicity import fit, keep_clean, learnable, logistic, op4_toxicity, sample, score


def texts(n, seed, bad):
    r = random.Random(seed)
    syl = ["an", "er", "tion", "the", "ing", "ou", "st", "ble", "re", "nd"]
    word = lambda: "".join(r.choice(syl) for _ in range(r.randrange(1, 4)))
    return [" ".join(r.choice(["vileword", "rotter", "foulmo" + word()]) if bad and r.random() < 0.06 else word() for _ in range(r.randrange(30, 300))) for _ in range(n)]


def test_held_out_accuracy(spark):
    bad, good = texts(160, 1, True), texts(400, 2, False)
    rows = [(i, t, None) for i, t in enumerate(bad + good)] + [(9000, None, 1), (9001, "", 1), (None, "the tion", 1), (0, bad[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    labels = spark.createDataFrame([(i, int(i < 160), 0) for i in range(560)] + [(3, 0, 0), (9001, None, 0), (None, 1, 0)], "doc_id long, toxic int, text int")
    model = fit(*sample(docs, labels, usable=learnable))
    got = {r.doc_id: r.score for r in score(docs, model).collect()}
    assert len(got) == 563 and all(0 <= s <= 1 for s in got.values())
    import zlib

    held = [i for i in range(560) if zlib.crc32(str(i).encode()) % 5 == 0]
    hit = [got[i] >= 0.5 for i in held if i < 160]
    wrong = [got[i] >= 0.5 for i in held if i >= 160]
    assert np.mean(hit) > 0.9 and np.mean(wrong) < 0.05
    kept = keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit(*sample(docs, none))
    assert model is None and [r.score for r in score(docs, model).collect()] == [0, 0] and keep_clean(docs, model).count() == 2
    assert score(docs.limit(0), model).count() == 0


def test_logistic():
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    assert np.abs(logistic(x, y, 1e-6) - [1, -2, 0.5]).max() < 0.2


def test_query(spark):
    got = op4_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.predicted == (r.score >= 0.5) for r in got)


def test_features_and_score_against_brute_force(spark):
    """Windows, lengths and statistics once more, each window with compressors of its own."""
    import zstandard

    m = fit(texts(60, 3, True), texts(120, 4, False))
    options = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=6, hash_log=14, chain_log=14, window_log=17, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

    def length(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=options)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress(window))

    rows = [(k, t) for k, t in enumerate([*texts(6, 9, True), *texts(6, 10, False), "", "one", "  ", "vileword " * 4000])]
    want = {}
    for k, t in rows:
        w = t.lower().split()
        saved = [length(m.ordinary, x) - length(m.toxic + m.ordinary, x) for x in (f" {' '.join(w[i : i + 12])} ".encode() for i in range(0, len(w), 12))] or [0]
        top = sorted(saved)[-3:]
        n = len(saved)
        x = [max(saved), sum(top) / len(top), *(sum(s >= c for s in saved) / n for c in (1, 2, 3)), sum(saved) / n, sum(saved) / max(1, len(t)), np.log(n)]
        z = sum((a - b) / c * d for a, b, c, d in zip(x, m.mean, m.scale, m.weights[:-1], strict=True)) + m.weights[-1]
        want[k] = 1 / (1 + np.exp(-z))
    got = {r.doc_id: r.score for r in score(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_absent_and_long_documents_leave_room(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC_SAMPLE", 5)
    monkeypatch.setattr(toxicity, "ORDINARY_SAMPLE", 5)
    docs = spark.createDataFrame([(k, "x " * 20_000 if k % 2 else f"t{k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k // 4 % 2) for k in range(400)], "doc_id long, toxic int")
    bad, good, odds = sample(docs, labels)
    assert len(bad) == len(good) == 5 and all(len(t) < 9 for t in bad + good) and odds == 1.0

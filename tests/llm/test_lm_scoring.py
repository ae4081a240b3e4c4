import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from shoreline.llm import lm_scoring
from shoreline.llm.lm_scoring import CLASSES, CONTEXTS, contexts_of, learnable, log_classes, op5_lm_scoring, score_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, t in docs:
        if not held(i):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    return {(i, t): (len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None])) for i, t in docs}


def documents():
    r = random.Random(1)
    tongues = [[a + b for a in x for b in y] for x, y in (("th he an".split(), "er in on re".split()), ("ch sch ge".split(), "en ung keit".split()))]
    docs = [(i, " ".join(r.choice(t)[: r.randrange(2, 9)] + r.choice(["", "", ".", "É"]) for _ in range(r.randrange(1, 150)))) for i in range(300) for t in [r.choice(tongues)]]
    return docs + [(400, None), (401, ""), (402, "ONLY Here \n\x0b once"), (5, docs[5][1]), (None, "th　x")]


def test_base_and_model(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXT", 20_000)
    docs = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string").repartition(4)
    got, want = score_texts(df, learnable).collect(), brute(docs)
    assert len(got) == len(docs)
    texts = dict(docs)
    gain = []
    for x in got:
        w = want[x.doc_id, texts[x.doc_id]]
        assert (x.n_tokens, x.n_known, x.train_tokens) == w[:3] and abs(x.base_score - w[3]) < 1e-6
        assert x.score < 0
        gain.append((x.score - x.base_score) / x.n_tokens)
    assert np.mean(gain) > 0


def test_classes_are_a_distribution():
    r = np.random.default_rng(0)
    p = np.exp(log_classes(np.arange(0, CONTEXTS, 999), r.normal(size=(lm_scoring.FEATURES, CLASSES)), r.normal(size=CLASSES)))
    assert np.abs(p.sum(1) - 1).max() < 1e-9


def test_contexts_stop_at_ends():
    g = np.array([5, 6, 7, 0, 8, 9, 0])
    one, two, three = (contexts_of(g) % CLASSES, contexts_of(g) // CLASSES % CLASSES, contexts_of(g) // CLASSES**2)
    assert one.tolist() == [0, 5, 6, 7, 0, 8, 9] and two.tolist() == [0, 0, 5, 6, 0, 0, 8] and three.tolist() == [0, 0, 0, 5, 0, 0, 0]


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    from pyspark.sql import functions as F

    x = score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), lambda _: F.lit(False)).first()
    assert (x.n_tokens, x.n_known, x.train_tokens, x.base_score) == (3, 0, 0, 0.0)


def test_held_out_beats_the_base(spark):
    got = [x for x in op5_lm_scoring(spark, "/root/testdata/sf0.01").collect() if x.held_out]
    assert sum(x.score for x in got) > sum(x.base_score for x in got)


def test_score_against_brute_force(spark, monkeypatch):
    """The model's probabilities once more, token by token, from its weights and the plain counts."""
    monkeypatch.setattr(lm_scoring, "BLOCK_TEXT", 20_000)
    docs = documents()[:150] + [(900, "the " * 300), (901, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = df.selectExpr("coalesce(text, '') _text")
    vocab = lm_scoring.vocabulary(rows, 6)
    weights, bias = lm_scoring.train_classes(lm_scoring.context_counts(rows, vocab), vocab)
    import pyarrow as pa

    key = lambda w: int(lm_scoring.tokens(pa.array([w], pa.large_string()))[0][0])
    counts = Counter(w for _, t in docs for w in words(t))
    top = {int(k): j + 1 for j, k in enumerate(vocab.top)}
    kind = {w: top.get(key(w), (key(w) & 63) + 1 + lm_scoring.TOP) for w in counts}
    members = Counter(kind.values())
    mass = Counter()
    for w, n in counts.items():
        mass[kind[w]] += n
    members[0], mass[0] = 1, len(docs)
    assert [mass[c] for c in range(CLASSES)] == vocab.class_tokens.tolist() and [members[c] for c in range(CLASSES)] == vocab.class_types.tolist()
    want = {}
    for i, t in docs:
        g, total = [0, 0, 0], 0.0
        for w in [*words(t), None]:
            one, two, three = g[-1], g[-2], g[-3]
            two = two if one else 0
            three = three if two else 0
            context = (three % lm_scoring.GROUPS * CLASSES + two) * CLASSES + one
            z = weights[lm_scoring.features_of(np.array([context]))[0]].sum(0) + bias
            c = kind[w] if w else 0
            n = counts[w] if w else len(docs)
            total += z[c] - np.log(np.exp(z).sum()) + math.log((n + 1) / (mass[c] + members[c] + 1))
            g.append(c)
        want[i] = total / math.log(10)
    got = {x.doc_id: x.score for x in score_texts(df).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 + 1e-5 * abs(want[i]) for i in want) and len(got) == len(want)


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "a b " * 250_000), (2, "x" * 3_000_000), (3, "c")], "doc_id long, text string")
    got = {x.doc_id: (x.n_tokens, x.n_known) for x in score_texts(df).collect()}
    assert got == {1: (500_001, 500_001), 2: (2, 2), 3: (2, 2)}

import random

import numpy as np
import pytest

from shoreline.llm import passages
from shoreline.llm.passages import drop_repeats, locate


def brute(docs, window=20):
    """docs: in order. (n_words, places removed) of each."""
    seen, out = set(), []
    for _, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if key in seen:
                gone |= set(range(a, a + window))
            seen.add(key)
        out.append((len(w), gone, b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def documents(seed=3):
    r = random.Random(seed)
    text = lambda n, v=300: " ".join(f"w{r.randrange(v)}" for _ in range(n))
    shared = [text(n) for n in (19, 20, 21, 35, 60, 200)]
    docs = []
    for i in range(120):
        parts = [text(r.randrange(0, 60)) for _ in range(3)]
        for _ in range(r.randrange(3)):
            parts.insert(r.randrange(4), r.choice(shared))
        docs.append((i, r.choice(["\n", " ", " \t "]).join(parts)))
    docs += [(200 + k, docs[5][1]) for k in range(6)] + [(300, "a " * 400), (301, "a b " * 60), (302, None), (303, ""), (304, "é x y " * 30), (305, text(5000, 3))]
    return docs


@pytest.mark.parametrize("block", [1 << 22, 4000])
def test_brute_force(spark, block):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, kept string, n_words int").repartition(5)
    got = sorted(drop_repeats(df, block_text=block).collect(), key=lambda x: x.doc_id)
    for x, (_, _), (n, gone, kept) in zip(got, docs, brute(docs), strict=True):
        assert (x.n_words, x.n_removed, x.kept) == (n, len(gone), kept), x.doc_id
        assert {k for s in x.removed for k in range(s.first, s.last + 1)} == gone


@pytest.mark.parametrize("window", [60, 69, 100, 200])
def test_long_windows(spark, window):
    """Phrases that stand for windows which begin 64 words and more before them."""
    r = random.Random(window)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    shared = [text(window), text(window), text(3 * window)]
    docs = [(k, " ".join((text(r.randrange(30)), r.choice(shared), text(r.randrange(30))))) for k in range(60)]
    got = sorted(drop_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window=window, block_text=20_000).collect(), key=lambda x: x.doc_id)
    assert [(x.n_words, x.n_removed, x.kept) for x in got] == [(n, len(gone), kept) for n, gone, kept in brute(docs, window)]
    assert sum(x.n_removed for x in got) > 50 * window


def test_string_ids_are_refused(spark):
    with pytest.raises(TypeError):
        drop_repeats(spark.createDataFrame([("k", "a b")], "doc_id string, text string"))


def test_equal_ids_and_nulls(spark):
    long = " ".join(map(str, range(50)))
    rows = [(None, long), (7, long), (7, long), (7, "0 " + long), (None, None), (-3, "x " + long)]
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_words, x.n_removed) for x in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == [(False, 0, 0, 0), (False, 0, 50, 0), (True, -3, 51, 50), (True, 7, 50, 50), (True, 7, 50, 50), (True, 7, 51, 50)]
    assert drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def places(words, phrase):
    return [k for k in range(len(words) - len(phrase) + 1) if (words[k : k + len(phrase)] == phrase).all()]


@pytest.mark.parametrize("shard", [500_000, 20])
def test_every_occurrence_is_located(monkeypatch, shard):
    """Only what the automata find is proposed: all places of the phrases, also where they overlap, and no others."""
    monkeypatch.setattr(passages, "PHRASES", shard)
    r = np.random.default_rng(2)
    words = r.integers(1, 90000, 3000).astype(np.uint64)
    words = np.concatenate((words, words[100:160], words[500:520], words[100:130], np.full(30, 7, np.uint64), words[2000:2040]))
    at, offsets = np.array([100, 103, 505, 2010, 2010, 2999, len(words) - 60]), np.array([0, 3, 5, 2, 7, 1, 0])
    want = {k - o for p, o in zip(at, offsets, strict=True) for k in places(words, words[p : p + 5])}
    assert set(locate(words, at, offsets).tolist()) == want and len(want) > 30
    assert len(locate(words, at[:0], offsets[:0])) == 0


def test_very_long_text(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "x " + long), (3, "y" * 2_000_000)], "doc_id long, text string")
    assert {x.doc_id: (x.n_words, x.n_removed) for x in drop_repeats(df, block_text=1 << 20).collect()} == {1: (300_000, 0), 2: (300_001, 300_000), 3: (1, 0)}

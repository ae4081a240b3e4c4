import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shoreline.llm.decontaminate import Items, Words, cover, find_contamination, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, items, n=10):
    out = []
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for k, x in items:
            v = WORD.findall(low(x))
            m = min(n, len(v))
            for a in range(len(v) - m + 1) if v else ():
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == v[a : a + m]:
                        hit |= set(range(b, b + m))
                        ids.add("" if k is None else str(k))
        out.append((i, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def data(seed=1):
    r = random.Random(seed)
    words = ["Ab", "cd", "É", "x1", "語", "the", "of"]
    line = lambda n: "".join(r.choice(words) + r.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, line(r.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(None, line(12)), (3, line(15)), (40, None), (41, "...")]
    docs = [(i, line(r.randrange(60)) + r.choice(items)[1].upper() if r.random() < 0.5 and items[i % 12][1] else line(r.randrange(90))) for i in range(40) if True]
    return [(i, (t or "") + " " + (items[i % 14][1] or "")) for i, t in docs] + [(50, None), (51, ""), (None, items[8][1] + " q"), (0, docs[0][1]), (0, docs[0][1])], items


def test_brute_force(spark):
    docs, items = data()
    d = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    got = find_contamination(d, b).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got], key=str) == want
    texts = dict(docs)
    for r in got:
        assert r.n_hit == sum(s.last_word - s.first_word + 1 for s in r.spans)
        for s in r.spans:
            w = WORD.findall(low(texts[r.doc_id]))
            assert WORD.findall(low(texts[r.doc_id][s.start : s.end])) == w[s.first_word : s.last_word + 1]
    kept = remove_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([w[0] for w in want if not w[2]], key=str)


@pytest.mark.parametrize("seed", range(30))
def test_items_of_all_sizes(seed):
    """Few words, so that windows and phrases repeat and overlap."""
    r = random.Random(seed)
    line = lambda n: " ".join(r.choice("ab c" if seed % 2 else "abcdefghij") for _ in range(n))
    items = [(k, line(r.randrange(0, 14))) for k in range(r.randrange(0, 9))]
    docs = [(k, line(r.randrange(0, 60))) for k in range(12)]
    w = Words(pa.array([t for _, t in docs], pa.large_string()))
    known = Items([(str(k), t) for k, t in items], 5)
    start, size, who = known.hits(w)
    hit = np.bincount(w.doc[cover(w, start, size)], minlength=12)
    ids = [sorted({known.ids[j] for d, x in zip(w.doc[start], who, strict=True) if d == k for j in x}) for k in range(12)]
    want = {i: (n, h, k) for i, n, h, k in brute(docs, items, 5)}
    assert [(int(np.diff(w.first)[k]), int(hit[k]), ids[k]) for k in range(12)] == [want[k] for k in range(12)]


def test_large_benchmarks_and_long_texts(spark):
    r = random.Random(2)
    line = lambda n: " ".join(f"w{r.randrange(50_000)}" for _ in range(n))
    items = [(k, line(100)) for k in range(3000)]
    b = spark.createDataFrame(items, "item_id long, text string")
    long = line(200_000) + " " + items[7][1][:200] + " " + line(1000)
    d = spark.createDataFrame([(1, long), (2, "x" * 2_000_000), (3, items[2999][1].upper())], "doc_id long, text string")
    got = {x.doc_id: x for x in find_contamination(d, b).collect()}
    assert got[1].item_ids == ["7"] and got[1].n_hit >= 20 and got[2].n_hit == 0 and (got[3].n_hit, got[3].item_ids) == (100, ["2999"])
    with pytest.raises(ValueError, match="bytes"):
        find_contamination(d, b, most=1000)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in find_contamination(d, none).collect()] == [(1, 2, 0, [], [])]
    assert remove_contaminated(d, none).count() == 1
    assert find_contamination(d.where("false"), none).count() == 0

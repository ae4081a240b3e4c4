import random
from collections import Counter, defaultdict

import numpy as np

from shoreline.llm.near_dedup import bag_minhash, components, keep_one, near_duplicates

WORDS = "abcdefghijklmnopqrstuvwxyz"


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a and b else 0.0


def brute(docs):
    """Smallest doc_id of each connected component of links of 0.8 or more."""
    bags = [bag(t) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            if jaccard(a, bags[j]) >= 0.8:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    return [list(g) for g in groups.values()]


def test_unbiased():
    r = np.random.default_rng(5)
    m = 4096
    for _ in range(6):
        a, b = (r.integers(0, 9, 40) * (r.random(40) < 0.8) for _ in range(2))
        hashes = r.integers(0, 1 << 63, 40, dtype=np.uint64)
        parts = [(np.full((w > 0).sum(), k), hashes[w > 0], w[w > 0]) for k, w in enumerate((a, b))]
        sig = bag_minhash(*(np.concatenate(x) for x in zip(*parts, strict=True)), 2, m)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 5 * np.sqrt(0.25 / m)


def documents(seed=6):
    r = random.Random(seed)
    text = lambda n: [f"w{r.randrange(4000)}" for _ in range(n)]
    docs = [" ".join(text(r.randrange(1, 120))) for _ in range(120)]
    for n in (30, 100, 300):
        base = text(n)
        for k in range(25):  # near copies, some too far from each other but linked through the base
            t = list(base)
            for _ in range(r.randrange(0, 2 + n // 60)):
                t[r.randrange(n)] = f"x{r.randrange(9999)}"
            docs.append(" ".join(t))
    docs += ["a b c a b c a b c a b c", "a b c a b c a b c a b c a b c", "one two", "one  two", "one two three", "", None, "  ", None, "z"] + [docs[3]] * 40
    docs += [" ".join(["rep"] * n) for n in (100, 95, 70, 50)]
    return [(i, t) for i, t in enumerate(docs)]


def test_brute_force(spark):
    docs = documents()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, class_id string").repartition(4)
    want = {}
    for g in brute(docs):
        for i in g:
            want[docs[i][0]] = (docs[min(g)][0], len(g))
    got = near_duplicates(df).collect()
    assert {x.doc_id: (x.class_id, x.class_size) for x in got} == want and len(got) == len(docs)
    assert {x.doc_id for x in got if x.keeper} == {c for c, _ in want.values()}
    kept = keep_one(df)
    assert kept.columns == df.columns and {(x.doc_id, x.text) for x in kept.collect()} == {docs[c] for c, _ in want.values()}


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "p q r s t u"), (None, "p q r s t u"), (None, "x y"), (2, None)], "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id or 0, x.class_id or 0, x.class_size) for x in near_duplicates(df).collect())
    assert got == [(0, 0, 1), (0, 1, 2), (1, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 1)]
    assert keep_one(df).count() == 4
    assert near_duplicates(df.limit(0)).count() == 0


def test_near_copies_without_ids(spark):
    t = [f"w{k}" for k in range(60)]
    df = spark.createDataFrame([(None, " ".join(t)), (None, " ".join([*t[:-1], "x"])), (4, " ".join(t[::-1]))], "doc_id long, text string")
    assert sorted(x.class_size for x in near_duplicates(df).collect()) == [1, 2, 2]


def test_group_of_far_copies(spark):
    """A large group whose members are mostly 0.6 to 0.75 alike: all links of 0.8 or more count, and few pairs are compared."""
    r = random.Random(9)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    docs, last = [], base
    for k in range(400):
        t = list(last if k % 10 == 0 else base)  # some are copies of copies
        for _ in range(r.randrange(1, 6)):
            t[r.randrange(len(t))] = f"x{r.randrange(99999)}"
        last = t
        docs.append((k, " ".join(t)))
    want = {docs[i][0]: (docs[min(g)][0], len(g)) for g in brute(docs) for i in g}
    assert len({c for c, _ in want.values()}) > 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: (x.class_id, x.class_size) for x in near_duplicates(df).collect()} == want


def test_clashing_names_and_long_texts(spark):
    r = random.Random(4)
    long = [f"w{r.randrange(10**6)}" for _ in range(300_000)]
    rows = [(1, " ".join(long), 7, b"a"), (2, " ".join([*long[:-9], "z"]), 8, b"b"), (3, "x" * 3_000_000, 9, None), (4, "p q", None, b"d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h int, node binary")
    kept = keep_one(df)
    assert kept.columns == df.columns and sorted((x.doc_id, x._h or 0, x.node or b"") for x in kept.collect()) == [(1, 7, b"a"), (3, 9, b""), (4, 0, b"d")]


def test_repeated_rows_come_back_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f", k) for k in range(9)] + [(2, "a b c d e f", 99), (3, None, 1), (3, None, 1)], "doc_id long, text string, _g int")
    assert sorted((x.doc_id, x.text) for x in keep_one(df).collect() if x.text) == [(1, "a b c d e f")]
    assert keep_one(df).count() == 3


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(200, 201), (201, 200)]
    names = {x: r.randrange(-(10**6), 10**6) for x in {v for e in edges for v in e}}
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = dict(map(tuple, components(df).collect()))
    for group in (range(61), range(100, 150), (200, 201)):
        assert {got[names[x]] for x in group} == {min(names[x] for x in group)}

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa

from shoreline.llm.quality import RULES, choose, features, judge, tail

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    w = WORD.findall(t or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for k, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit |= {k, k + 1, k + 2}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>") if t else 0, len(lines) - len(set(lines)), len(hit)]


def texts(n, seed=3):
    r = random.Random(seed)
    v = ["a", "b", "É#", "語|", "the", "x" * 30]
    return ["".join(r.choice(v) + r.choice([" ", "\n", "\t ", "\n\n", "\r\n"]) for _ in range(r.randrange(0, 40))) for _ in range(n)] + ["", None, " \n\x0b", "a b c a b c", "one\none", "  x  "]


def test_features():
    t = texts(300)
    got = features(pa.array(t, pa.large_string()).fill_null(""))
    assert [[int(c[k]) for c in got[:5]] for k in range(len(t))] == [brute(x) for x in t]


def test_exact_tail():
    for n, k, p in ((10, 3, Fraction(1, 4)), (60, 0, Fraction(1, 20)), (200, 7, Fraction(3, 100))):
        want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert abs(tail(n, k, float(p)) - float(want)) < 1e-12


def test_choice_stops_at_the_first_uncertified():
    counts = {r: [(0, 0)] * len(c) for r, c in RULES.items()}
    counts["symbols"] = [(0, k) for k in range(8)] + [(900, 90)] + [(0, 99)] * (len(RULES["symbols"]) - 9)
    assert choose(counts, 1000, 100, 16) == {"symbols": RULES["symbols"][7]}
    assert choose(counts, 100, 100, 16) == {}


def test_judge(spark):
    r = random.Random(8)
    clean = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(70))
    junk = lambda: " ".join(f"w{r.randrange(10**6)}###" for _ in range(70))
    rows = [(i, junk() if i % 5 == 0 else clean(), ["en", None][i % 2], 3) for i in range(3000)] + [(3000, "short", "en", 1), (3001, None, "xx", 1), (3002, clean(), "xx", 1), (3002, clean(), "xx", 1)]
    labels = [(i, int(i % 5 != 0), None) for i in range(2600)] + [(2, 0, 1), (3001, None, 0), (7, 1, 1), (9999, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").repartition(3)
    got = judge(d, spark.createDataFrame(labels, "doc_id long, quality int, lang int")).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x.kept == (x.doc_id == 3002 or x.doc_id < 3000 and x.doc_id % 5 != 0), x
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert judge(d.limit(0), none).count() == 0
    assert judge(d.where("doc_id < 10"), none).where("kept").count() == 10


def cut(values, good, bad, cutoffs, tests, alpha):
    """The rule of the docstring in exact arithmetic."""
    best, gain = None, 0
    for c in cutoffs:
        g, b = sum(v > c for v in values[1]), sum(v > c for v in values[0])
        p = Fraction(alpha).limit_denominator() / len(RULES)
        if sum(math.comb(good, k) * p**k * (1 - p) ** (good - k) for k in range(g + 1)) > Fraction(5, 100) / tests:
            break
        value = Fraction(b, max(bad, 1)) - 4 * Fraction(g, max(good, 1))
        if value > gain:
            best, gain = c, value
    return best


def test_kept_against_brute_force(spark):
    """Features, cutoffs and verdicts once more, in plain Python; labelled documents with repeated rows count once."""
    r = random.Random(4)
    text = lambda k: " ".join(("w%d" % r.randrange(10**6)) + ("#" if k == 1 and r.random() < 0.2 else "") + ("\nsame line here" if k == 2 and r.random() < 0.1 else "") for _ in range(r.randrange(40, 90)))
    rows = [(i, text(i % 9), ["de", "en", None][i % 3]) for i in range(2700)]
    rows += [rows[k] for k in range(0, 900, 2)] * 2
    labels = [(i, int(i % 9 not in (1, 2))) for i in range(2500)]
    y, seen, scores = dict(labels), set(), {}
    part = lambda a, b: a / b if b else 0.0
    for i, t, lang in rows:
        n, chars, sym, dup, rep = brute(t)
        lines = len([x for x in t.split("\n") if WORD.search(x)])
        scores[i] = {"symbols": part(sym, n), "repeats": part(rep, n), "same_lines": part(dup, lines), "capitals": part(sum("A" <= c <= "Z" for c in t), chars)}, n < 50 or 100 * rep > 50 * n, lang
        seen.add(lang)
    cuts = {}
    for lang in seen:
        mine = {q: [i for i in y if y[i] == q and scores[i][2] == lang] for q in (0, 1)}
        for rule, cs in RULES.items():
            cuts[lang, rule] = cut({q: [scores[i][0][rule] for i in ids] for q, ids in mine.items()}, len(mine[1]), len(mine[0]), cs, len(RULES) * len(seen), 0.05)
    assert any(c is not None for c in cuts.values())
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = judge(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows)
    for x in got:
        s, failed, lang = scores[x.doc_id]
        assert (x.base_failed, x.kept) == (failed, not failed and not any(cuts[lang, k] is not None and s[k] > cuts[lang, k] for k in RULES)), x


def test_null_ids_and_long_texts(spark):
    d = spark.createDataFrame([(None, "a b c", "en"), (1, "w " * 500_000, "en"), (2, "x" * 3_000_000, None)], "doc_id long, text string, lang string")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_repeat_words) for x in judge(d, spark.createDataFrame([(None, 1)], "doc_id long, quality int")).collect()}
    assert got == {None: (3, 3, 0), 1: (500_000, 500_000, 500_000), 2: (1, 3_000_000, 0)}

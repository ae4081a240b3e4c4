"""Kinds of toxic text that are rare beside the commonest one are learned too."""

import random

from test_toxicity import texts

from shoreline.llm.toxicity import families, fit


def marked(n, seed, words):
    r = random.Random(seed)
    return [" ".join([*(w := t.split())[: len(w) // 2], *r.sample(words, 3), *w[len(w) // 2 :]]) for t in texts(n, seed, False)]


def test_rare_kind():
    common, rare = ["vileword", "rotter", "muckwit"], ["zurrbach", "quolpen", "jaffrok"]
    bad = marked(400, 1, common) + marked(24, 2, rare)
    m = fit(bad, texts(500, 3, False))
    assert all(f" {w}".encode() in m.toxic for w in common + rare)


def test_near_copies_are_one():
    a, b = texts(2, 5, False)
    near = [a + f" the{k}" for k in range(30)]
    of = families([*near, b])
    assert len(set(of[:-1])) == 1 and of[-1] not in of[:-1]
    # a word of one text and its copies doesn't tell; as many texts of their own do
    odd = [t + " grumblefex" for t in near]
    bad = marked(200, 6, ["vileword", "rotter", "muckwit"])
    assert b"grumblefe" not in fit(bad + odd, texts(300, 7, False)).toxic

import random
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pyarrow as pa

from conftest import SF
from shoreline.llm.divergence import ORACLE, audit, op11_divergence, oracle

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c >= "\x80" or c.isascii() and c.isalpha():
            word += c.lower() if c.isascii() else c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(docs, least, top):
    """Over plain dictionaries; docs: text, lang, source."""
    seen, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source, ws = lang or "", source or "", words(text)
        groups[lang].add(source)
        seen[lang].update(set(ws))
        count[lang, source].update(ws)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def some(r, n):
    vocabulary = ["Alpha", "beta", "BETA", "été", "Été", "naïve", "ſtraße", "日本", "x_y", "don't", "a1b", "Ω"] + [f"w{c}" for c in "abcdefgh"]
    docs = []
    for _ in range(n):
        lang, source = r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "é", "Z"])
        docs.append((" ".join(r.choice(vocabulary) for _ in range(r.randrange(12))), lang, source))
    return docs


def rows_of(df):
    return sorted(tuple(x) for x in df.collect())


def test_against_dictionaries(spark):
    docs = some(random.Random(3), 400)
    docs += [(None, "en", "s1"), ("", "en", "only nothing"), ("rare words", "xx", "a"), ("rare words", "xx", "b"), ("", "yy", "lonely"), ("beta " * 50_000, "en", "s1"), ("beta\x00gamma", "de", "s2")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4)
    for least, top in ((1, 3), (8, 50), (1000, 50)):
        got = audit(df, least_docs=least, top=top)
        assert got.columns == COLUMNS and [t for _, t in got.dtypes] == ["string"] * 4 + ["bigint", "int"]
        assert rows_of(got) == brute(docs, least, top)
    flat = [x for x in brute(docs, 8, 50) if x[0] == "xx"]
    assert flat == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_sql_on_odd_rows(spark):
    docs = some(random.Random(8), 300)
    con = duckdb.connect()
    con.register("odd", pa.table(list(map(list, zip(*docs, strict=True))), names=["text", "lang", "source"]))
    df = spark.createDataFrame(docs, "text string, lang string, source string")
    assert rows_of(audit(df, least_docs=5, top=4)) == sorted(con.sql(oracle("odd", 5, 4)).project(", ".join(f'"{c}"' for c in COLUMNS)).fetchall())


def test_one_source_has_most_rows(spark):
    docs = [("same words here", "en", "hot")] * 3000 + [(f"same word{chr(97 + k % 26)}", "en", f"s{k % 7}") for k in range(900)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(6)
    assert rows_of(audit(df)) == brute(docs, 30, 50)


def test_clashing_and_other_names(spark):
    docs = some(random.Random(4), 60)
    df = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "text string, `my.lang` string, term string, lang string, n int, `a.b` int")
    assert rows_of(audit(df, lang="my.lang", source="term", least_docs=2)) == brute(docs, 2, 50)


def test_empty(spark):
    out = audit(spark.createDataFrame([], "text string, lang string, source string"))
    assert out.columns == COLUMNS and out.count() == 0


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLE["op11_divergence"]).df()[COLUMNS]
    got = op11_divergence(spark, SF).toPandas()
    order = lambda d: d.sort_values(COLUMNS).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)

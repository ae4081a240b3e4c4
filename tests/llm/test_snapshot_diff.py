import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa

from conftest import SF
from shoreline.llm.snapshot_diff import ORACLE, diff, later_snapshot, op13_snapshot_diff, oracle

COLUMNS = ["key", "old_key", "op", "changed", "row_sha256"]
SCHEMA = "doc_id long, text string, lang string, source string"


def sha(row):
    return hashlib.sha256("\n".join("~" if x is None else x for x in row).encode()).hexdigest()


def digests(row):
    return ["~" if x is None else hashlib.md5(x.encode()).hexdigest() for x in row]


def brute(earlier, later, names=("text", "lang", "source")):
    """Rows of a key and compared columns."""
    smallest = lambda k: (k is not None, k if k is not None else 0)
    sides = []
    for rows in (earlier, later):
        by = defaultdict(list)
        for k, *row in rows:
            by[k].append(row)
        sides.append({(k, n): tuple(row) for k, group in by.items() for n, row in enumerate(sorted(group, key=digests))})
    old, new = sides
    out = []
    for at in old.keys() & new.keys():
        changed = ",".join(c for c, a, b in zip(names, old[at], new[at], strict=True) if a != b)
        out.append((at[0], at[0], "update" if changed else "same", changed, sha(new[at])))
    left = defaultdict(lambda: ([], []))
    for s, (one, other) in enumerate(((old, new), (new, old))):
        for at in one.keys() - other.keys():
            left[one[at]][s].append(at[0])
    for row, (olds, news) in left.items():
        olds, news = sorted(olds, key=smallest), sorted(news, key=smallest, reverse=True)
        met = min(len(olds), len(news))
        out += [(b, a, "rekey", "", sha(row)) for a, b in zip(olds, news, strict=False)]
        out += [(a, a, "delete", "", None) for a in olds[met:]] + [(b, None, "insert", "", sha(row)) for b in news[met:]]
    return Counter(out)


def rows_of(df):
    return Counter(tuple(x) for x in df.collect())


def some(r, n, keys):
    values = ["a", "b", None, "", "~", "é", "x" * 3000]
    return [(r.choice([None, *range(-keys, keys), 2**62 + r.randrange(3)]), *(r.choice(values) for _ in range(3))) for _ in range(n)]


def test_against_plain_python(spark):
    r = random.Random(9)
    for n, keys, block in ((60, 40, 1 << 14), (300, 20, 3), (300, 1000, 2), (200, 1, 7)):
        a, b = some(r, n, keys), some(r, n + 20, keys)
        b += r.sample(a, 20) + a[:5] * 3
        one, two = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (a, b))
        assert rows_of(diff(one, two, bucket_rows=50, block=block)) == brute(a, b)


def test_large_groups(spark):
    """Half of the rows have one content, a key is on many rows, and both are cut into blocks."""
    a = [(k, "same", "en", None) for k in range(3000)] + [(5000, f"t{k % 9}", "en", "s") for k in range(900)] + [(None, "n", None, None)] * 300
    b = [(-1 - k, "same", "en", None) for k in range(2500)] + [(5000, f"t{k % 7}", "de", "s") for k in range(1100)] + [(None, "n", None, None)] * 200
    one, two = (spark.createDataFrame(x, SCHEMA).repartition(5) for x in (a, b))
    for block in (64, 1000, 1 << 14):
        assert rows_of(diff(one, two, bucket_rows=200, block=block)) == brute(a, b)


def test_sql_on_odd_rows(spark):
    r = random.Random(10)
    a, b = some(r, 200, 50), some(r, 200, 50)
    con = duckdb.connect()
    for name, rows in (("a", a), ("b", b)):
        con.register(name, pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 3), strict=True)], names=["doc_id", "text", "lang", "source"]))
    assert brute(a, b) == Counter(con.sql(oracle("a", "b")).project(", ".join(f'"{c}"' for c in COLUMNS)).fetchall())


def test_later_snapshot(spark):
    docs = [(k, None if k % 5 == 0 else f"text {k}", None if k % 3 == 0 else "en", f"s{k}") for k in range(200)]
    want = []
    for k, t, lang, s in docs:
        m = zlib.crc32(str(k).encode()) % 10
        if m == 1:
            t = (t or "") + "+"
        elif m == 2:
            lang, s = s, lang
        elif m == 4:
            s = None
        want += [(j, t, lang, s) for j in ([] if m == 0 else [-1 - k] if m in (3, 4) else [k, -1 - k] if m == 5 else [k])]
    assert rows_of(later_snapshot(spark.createDataFrame(docs, SCHEMA))) == Counter(want)


def test_string_keys_other_columns_and_names(spark):
    a = [("k1", "x", "p"), ("k2", "x", "q"), ("", "x", "r"), (None, "y", "r"), ("kept", None, "z")]
    b = [("n1", "x", "q"), ("n2", "x", "p"), ("", "x", "r"), ("kept", "~", "z")]
    schema = "`the.key` string, `a.b` string, none string"
    one = spark.createDataFrame([(*x, 1, True) for x in a], schema + ", key int, _unit boolean")
    out = diff(one, spark.createDataFrame(b, schema), "the.key", ("a.b", "none"))
    assert out.columns == COLUMNS and rows_of(out) == brute(a, b, ("a.b", "none"))


def test_empty_and_one_sided(spark):
    empty, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "é" * 2_000_000, None, ""), (1, None, None, None)], SCHEMA)
    assert diff(empty, empty).count() == 0 and diff(empty, empty).columns == COLUMNS
    assert [(x.key, x.old_key, x.op) for x in diff(one, empty).collect()] == [(1, 1, "delete")] * 2
    assert [(x.key, x.old_key, x.op) for x in diff(empty, one).collect()] == [(1, None, "insert")] * 2
    assert [t for _, t in diff(one, empty).dtypes] == ["bigint", "bigint", "string", "string", "string"]


def test_query(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = rows_of(op13_snapshot_diff(spark, SF).select(*COLUMNS))
    assert got == Counter(con.sql(ORACLE["op13_snapshot_diff"]).project(", ".join(f'"{c}"' for c in COLUMNS)).fetchall())
    assert {x[2] for x in got} == {"same", "update", "rekey", "insert", "delete"}

"""Near-duplicates by BagMinHash over bags of five-word shingles, with exact verification.

Signature: a document is a bag of shingles with their counts as weights. For every shingle and every dyadic level of
weight ([0,1), [1,2), [2,4), ...) a Poisson process of rate `M` times the level's width runs from a seed that depends on shingle
and level alone; each point draws one of M components and a height within its level, and counts if the height is
below the weight (so the process over a level is the sum of those over its parts, which only a weight inside the
level has to tell apart). A component keeps its earliest point. Two bags agree in a component with probability sum(min) / sum(max),
their weighted Jaccard similarity. A process stops once it passes the latest of its document's components, so a
document costs about its shingles plus M ln M points, whatever its weights. All documents of a slice run together.

Search: exact copies (equal words) are one class, represented once. Components are banded (BANDS bands of ROWS); classes that
share a band are a bucket. With s = 0.8 the chance to share none is (1 - s^5)^32 = 3e-6. A bucket isn't expanded into pairs:

1. Its pivot z is the member that shares the most buckets with others. All members are compared with it (a star).
2. What a member lacks of z and has beyond z is its difference. For two members of a star let s be what their differences share and
   g = (1 - l) missing + l extra with l = threshold / (1 + threshold); they link exactly if s >= g(a) + g(b) - (1 - 2l)|z|.
   Two members that both link to z are joined already. Of any other pair one doesn't link to z, so its g alone exceeds
   (1 - 2l)|z| and the pair must share more of their differences than the smaller one's g: about half of it, which near copies
   with edits of their own never do. Such pairs are found by prefixes of the differences in order of rarity
   (parts that nobody else has are left out), with the bound on what can still be shared after a place, and only between components
   that the stars haven't joined; what is found is verified on the whole bags.

So every link within a bucket counts, exactly, and the work is a comparison a member and bucket and a few for what is left, however
large a group of copies is; there are no rounds.

Cases: documents without words (null, empty, blank) are alone; one with fewer than five words is one shingle; repeated rows are
copies, of which keep_one() keeps one; class_id is the smallest doc_id of the class (null ids aside); documents are told apart by
128-bit hashes of their words; a very long text is one bag, in memory as 8 bytes a word; members of equal rank are taken in order
of their hash; an empty table gives an empty result; other columns, whatever their names, are ignored, or kept by keep_one().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import as_strings, freed, hashed_words, mix, read, slices, small, trimmed, written

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
#: Keys that may be sent to every executor (about 40 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 1 << 21
_EPS = 1e-6
_STEP, _DRAW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_UNIT = 2.0**-53


def shingles(h: np.ndarray, n: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of every shingle, from word hashes and words per text; a shorter text is one shingle."""
    first = np.concatenate(([0], np.cumsum(n)))
    doc = np.repeat(np.arange(len(n)), n)
    out_doc, out = [], []
    if len(h) >= k:
        g = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            g = mix(g + h[j : len(h) - k + 1 + j])
        ok = doc[: len(g)] == doc[k - 1 :]
        out_doc.append(doc[: len(g)][ok])
        out.append(g[ok])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        out_doc.append(short)
        out.append(np.array([_chain(h[first[d] : first[d + 1]], int(n[d])) for d in short], np.uint64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out)


def _chain(words: np.ndarray, start: int) -> int:
    g = np.array([start], np.uint64)
    for w in words:
        g = mix(g + w)
    return int(g[0])


def bags(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) in order, and how often each is there."""
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def bag_minhash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, m: int = M) -> np.ndarray:
    """Earliest points, texts x m; infinite for texts without shingles."""
    sig = np.full(texts * m, np.inf)
    parts, low, width = [], 0, 1
    while True:
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        parts.append((doc[at], mix(shingle[at] + np.uint64(low * int(_HIGH) & 0xFFFFFFFFFFFFFFFF)), weight[at], np.full(len(at), low), np.full(len(at), width)))
        low, width = low + width, low + width
    if not parts:
        return sig.reshape(texts, m)
    d, seed, w, lo, wide = map(np.concatenate, zip(*parts, strict=True))
    x = np.zeros(len(d))
    latest = np.full(texts, np.inf)
    while len(d):
        seed = mix(seed + _STEP)
        x = x - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * _UNIT) / (m * wide)
        live = x < latest[d]
        d, seed, x, w, lo, wide = d[live], seed[live], x[live], w[live], lo[live], wide[live]
        draw = mix(seed ^ _DRAW)
        part = (((draw >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        height = lo + ((draw & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) * wide
        good = height < w
        np.minimum.at(sig, (d * m + part)[good], x[good])
        latest = sig.reshape(texts, m).max(1)
    return sig.reshape(texts, m)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    v = sig.view(np.uint64).reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), v.shape[:2]).copy()
    for j in range(rows):
        key = mix(key + v[:, :, j])
    return key.view(np.int64)


def content(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """128 bits of hash of each text's sequence of words; null for texts without."""
    first = np.concatenate(([0], np.cumsum(n)))
    place = mix((np.arange(len(h)) - np.repeat(first[:-1], n)).astype(np.uint64))
    out = np.empty((len(n), 2), np.uint64)
    for k, salt in enumerate((np.uint64(0), _DRAW)):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix((h ^ place) + salt * place), dtype=np.uint64)))
        out[:, k] = mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(n.astype(np.uint64) + salt))
    valid = np.packbits(n > 0, bitorder="little").tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [pa.py_buffer(valid), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def signed(docs: DataFrame, text: str, carry: list[str]) -> DataFrame:
    """The columns `carry` of docs, node (null for texts without words) and bands of every row."""
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in carry)

    def run(batches):
        for b in trimmed(batches):
            nodes, keys = [], []
            col = as_strings(b.column(0))
            for i, k in slices(col):
                h, n = hashed_words(col.slice(i, k))
                d, s, w = bags(*shingles(h, n))
                nodes.append(content(h, n))
                keys.append(band_keys(bag_minhash(d, s, w, k)))
            flat = np.concatenate(keys).reshape(-1) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1) * BANDS, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.concat_arrays(nodes) if nodes else pa.array([], pa.binary()), lists], names=[*carry, "node", "bands"])

    return docs.select(F.col(text).alias("_text"), *carry).mapInArrow(run, f"{kinds}node binary, bands array<long>")


def sketches(docs: DataFrame, text: str) -> DataFrame:
    """node and bag (sorted 64-bit hashes of shingle and number of its occurrence) of every row with words."""

    def run(batches):
        for b in trimmed(batches):
            nodes, bag = [], []
            col = as_strings(b.column(0))
            for i, k in slices(col):
                h, n = hashed_words(col.slice(i, k))
                d, s, w = bags(*shingles(h, n))
                at = np.repeat(np.cumsum(w) - w, w)
                nth = np.arange(len(at)) - at
                e, dd = mix(np.repeat(s, w) + nth.astype(np.uint64) * _STEP), np.repeat(d, w)
                order = np.lexsort((e, dd))
                e, cut = e[order], np.searchsorted(dd[order], np.arange(k + 1))
                nodes.append(content(h, n))
                bag += [e[cut[j] : cut[j + 1]].tobytes() for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(nodes) if nodes else pa.array([], pa.binary()), pa.array(bag, pa.binary())], names=["node", "bag"])

    return docs.select(F.col(text).alias("_text")).mapInArrow(run, "node binary, bag binary")


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _links(both: int, n: int, m: int, threshold: float) -> bool:
    return both >= threshold * (n + m - both) - 1e-9


def _with_bags(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """Pairs a, b with their bags. Pairs of a hot node are split by the join."""
    one = pairs.select("a", "b").join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return one.join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").select("a", "b", "bag_a", "bag_b")


def compared(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs a, b that link."""

    def run(batches):
        for b in trimmed(batches):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                possible = threshold * max(len(x), len(y)) <= min(len(x), len(y)) + 1e-9
                keep.append(possible and _links(overlap(x, y), len(x), len(y), threshold))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with_bags(pairs, bag).mapInArrow(run, "a binary, b binary")


def stars(pairs: DataFrame, bag: DataFrame, threshold: float) -> DataFrame:
    """For each member a and pivot b: link, g (the weight of a's difference), room ((1 - 2l) of the pivot's size) and the difference."""
    share = threshold / (1 + threshold)

    def run(batches):
        for b in trimmed(batches):
            link, g, room, parts = [], [], [], []
            for x, z in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, z = np.frombuffer(x, np.uint64), np.frombuffer(z, np.uint64)
                d = np.setxor1d(x, z, assume_unique=True)
                missing = (len(d) + len(z) - len(x)) // 2
                link.append(_links(len(z) - missing, len(x), len(z), threshold))
                g.append((1 - share) * missing + share * (len(d) - missing))
                room.append((1 - 2 * share) * len(z))
                parts.append(d)
            at = np.concatenate(([0], np.cumsum([len(d) for d in parts]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(link, pa.bool_()), pa.array(g, pa.float64()), pa.array(room, pa.float64()), lists], names=["a", "b", "link", "g", "room", "difference"])

    return _with_bags(pairs, bag).mapInArrow(run, "a binary, b binary, link boolean, g double, room double, difference array<long>")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of every node of the edges a, b: labels are taken over from neighbours and
    from labels, so that long chains shorten by doubling."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "near-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "near-labels")
    while True:
        of = lambda key, name: labels.select(F.col("node").alias(key), F.col("component").alias(name))  # noqa: B023, E731
        near = both.join(of("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        new = labels.join(near, "node").select("node", F.least("component", "l").alias("up"), F.col("component").alias("old"))
        new = written(new.join(of("up", "top"), "up").select("node", F.least("up", "top").alias("component"), F.col("old") != F.least("up", "top")).toDF("node", "component", "changed"), "near-labels")
        freed(labels)
        labels = new
        if new.where("changed").isEmpty():
            freed(both)
            done = labels.select("node", "component")
            done.scratch_path = labels.scratch_path
            return done


def _unjoined(star: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs a, b of members of a star whose differences may share enough for a link, and whose components differ."""
    rows = star.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    over = F.col("g") - F.col("room")
    some = rows.groupBy("b").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("g").alias("least"), F.min(F.when(over > _EPS, over)).alias("beyond")).where("x != y and beyond is not null").select("b", "least", "beyond")
    rows = written(rows.join(some, "b"), "near-open")
    parts = rows.select("b", "a", F.explode("difference").alias("part"))
    shared = parts.groupBy("b", "part").agg(F.count("*").alias("k")).where("k > 1")
    lists = parts.join(shared, ["b", "part"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    # a pair is looked for from its member of the larger g (as asker) among those of at most its g (as the one listed)
    prefix = lambda need: F.size("parts") - F.greatest(F.lit(1), F.ceil(need - _EPS)).cast("int") + 1
    outer = over > _EPS
    rows = lists.join(rows.drop("difference"), ["b", "a"]).select("b", "a", "component", "g", "room", F.size("parts").alias("size"), "parts", F.when(outer, prefix(over + F.col("least"))).otherwise(0).alias("asks"), prefix(F.when(outer, F.col("g") + over).otherwise(F.col("g") + F.col("beyond"))).alias("listed"))
    longest = F.greatest("asks", "listed")
    rows = rows.where(longest > 0).select("b", "a", "component", "g", "room", "size", "asks", "listed", F.posexplode(F.slice("parts", F.lit(1), longest)).alias("at", "p"))
    rows = written(rows.select("b", "a", "component", "g", "room", (F.col("size") - F.col("at")).alias("rest"), (F.col("at") < F.col("asks")).alias("asks"), (F.col("at") < F.col("listed")).alias("listed"), F.col("p.part").alias("part")), "near-prefixes")
    x, y = rows.where("asks").alias("x"), rows.where("listed").alias("y")
    enough = F.least("x.rest", "y.rest") >= F.col("x.g") + F.col("y.g") - F.col("x.room") - _EPS
    met = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.g") >= F.col("y.g")) & (F.col("x.component") != F.col("y.component")) & enough)
    return met.select(F.least("x.a", "y.a").alias("a"), F.greatest("x.a", "y.a").alias("b")).distinct()


def classes(rows: DataFrame, docs: DataFrame, text: str, threshold: float = SIMILAR) -> DataFrame:
    """rows: written signed() rows; docs with the column `_h` of rows. node, component of every node with a link to another one."""
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("bands").alias("bands"))
    bands = nodes.select("node", F.explode("bands").alias("key"))
    full = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(bands.join(full, "key").select("key", "node", "n"), "near-members")
    rank = members.groupBy("node").agg(F.sum("n").alias("met"))
    pivots = members.join(rank, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("p")).select("key", F.col("p.node").alias("b"))
    pairs = members.join(pivots, "key").where("node != b").select(F.col("node").alias("a"), "b").distinct()
    some = written(members.select("node").distinct(), "near-nodes")
    ids = written(rows.join(some, "node", "left_semi").groupBy("node").agg(F.min("_h").alias("_h")).select("_h").distinct(), "near-ids")
    bag = sketches(docs.join(small(ids, BROADCAST_KEYS), "_h", "left_semi"), text)
    bag = written(bag.join(some, "node", "left_semi").dropDuplicates(["node"]), "near-bags")
    star = written(stars(pairs, bag, threshold), "near-stars")
    edges = star.where("link").select("a", "b")
    labels = components(edges)
    more = written(compared(_unjoined(star, labels), bag, threshold), "near-links")
    if not more.isEmpty():
        freed(labels)
        labels = components(edges.union(more))
    freed(members, some, ids, bag, star, more)
    return labels


def _hashes(doc_id: str, text: str) -> list:
    return [F.xxhash64(F.lit(1), doc_id, text), F.xxhash64(text, doc_id)]


def _grouped(docs: DataFrame, doc_id: str, text: str, threshold: float) -> DataFrame:
    """_id, _h, _g (hashes of _id and text), class_id, class_size and keeper of every row; class_size is null for what is alone."""
    if not SIMILAR <= threshold <= 1:
        raise ValueError(f"bands are laid out for a similarity of {SIMILAR}: less would lose links")
    h, g = _hashes(doc_id, text)
    plain = docs.select(F.col(doc_id).alias("_id"), h.alias("_h"), g.alias("_g"), F.col(text).alias("_text"))
    # _row is a number of the row within the written table
    signs = written(signed(plain, "_text", ["_id", "_h", "_g"]), "near-signs")
    rows = written(signs.drop("bands").withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    labels = classes(signs, plain, "_text", threshold)
    freed(signs)
    sizes = rows.where("node is not null").groupBy("node").agg(F.min("_id").alias("id"), F.count("*").alias("n"), F.min(F.struct("_id", "_row")).alias("k"))
    some = written(sizes.join(labels, "node", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "node")), "near-classes")
    whole = some.groupBy("component").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.min("k").alias("k"))
    found = written(some.select("node", "component").join(whole, "component").select("node", "class_id", "class_size", F.col("k._row").alias("first")), "near-found")
    freed(labels, some)
    out = rows.join(found, "node", "left")
    alone = F.col("class_size").isNull()
    return out.select("_id", "_h", "_g", F.when(alone, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), "class_size", (alone | (F.col("_row") == F.col("first"))).alias("keeper"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """doc_id, class_id, class_size (rows) and keeper (true for one row of each class) of every row of docs."""
    return _grouped(docs, doc_id, text, threshold).select(F.col("_id").alias("doc_id"), "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), "keeper")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, without all but one row of each class. Only keys of rows that go are joined to the
    texts. Rows equal in doc_id and text can't be told apart by them: such rows go together, and one of them comes back."""
    keys = _grouped(docs, doc_id, text, threshold).where("class_size is not null").groupBy("_h", "_g").agg(F.count("*").alias("n"), F.max("keeper").alias("stays"))
    gone = written(keys.where("n > 1 or not stays"), "near-gone")
    back = written(gone.where("stays").select("_h", "_g"), "near-back")
    names, (h, g) = [f"_c{k}" for k in range(len(docs.columns))], _hashes(doc_id, text)
    hashed = docs.select(h.alias("_h"), g.alias("_g"), *(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    kept = hashed.join(small(gone.select("_h", "_g"), BROADCAST_KEYS), ["_h", "_g"], "left_anti")
    if not back.isEmpty():
        one = hashed.join(small(back, BROADCAST_KEYS), ["_h", "_g"], "left_semi").groupBy("_h", "_g").agg(F.first(F.struct(*names)).alias("r"))
        kept = kept.select(*names).union(one.select(*(f"r.{n}" for n in names)))
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dedup": op8_near_dedup}
ORACLE: dict[str, str] = {}

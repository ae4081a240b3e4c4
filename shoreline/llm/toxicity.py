"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic text, and every window of `WORDS` words
is compressed against the ordinary dictionary and against both. The ordinary content stands at the same distance in
either, so an ordinary window has equal lengths but for chance; what the toxic dictionary saves shows that the window
shares passages with toxic text. A document's distribution of savings (largest, mean, shares over thresholds) goes into a
logistic curve fitted to held-back labels, which gives the score; 0.5 is the threshold it is calibrated to.

The ordinary dictionary is trained by zstandard's own trainer on windows of ordinary documents. That trainer keeps
what is frequent, which in toxic documents is ordinary text again; so the toxic content is chosen by contrast: passages
(beginnings of words, 4 to 10 bytes) that toxic documents have and ordinary ones have not, beyond chance (Chernoff's bound, over all
passages), taken greedily until every document is covered COVER times or no passage is left, however common the first ones
are. Near copies count as one document, or what they happen to share would look telling. Savings for fitting the
curve come from dictionaries that have not seen the document or a near copy (FOLDS folds).

Learning uses a bounded sample of labelled rows: at most TOXIC_SAMPLE and ORDINARY_SAMPLE documents, chosen by a hash of
doc_id, of at most SAMPLE_CHARS characters each (longer labelled documents are passed over, not cut), and of the ordinary ones ORDINARY_WINDOWS
windows for the trainer. Scoring covers every whole text.

Cases: null texts are empty; an empty text has the score of a text without savings; labels that are null or
contradict each other are not used; without labels of both classes all scores are 0; repeated rows are scored each;
a very long text is scored window by window, whole; documents of equal hash are chosen by doc_id, and passages that tell alike by
length and then by their bytes; other columns are ignored, or kept by keep_clean(); an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import as_strings, crc_mod, freed, numbered, read, renamed, trimmed, written

WORDS = 12
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 2000, 4000, 32_000
#: Bytes of the ordinary dictionary, and windows of ordinary sample documents that it is trained on at most.
ORDINARY_BYTES, ORDINARY_WINDOWS = 8192, 40_000
#: How many times as common in toxic documents a telling passage is.
RATIO = 4
COVER, FOLDS = 5, 4
#: A passage needs so many toxic families, and by chance any passage at all would be as telling with this probability.
LEAST, CHANCE = 3, 0.01
#: Bands of three hashes, of which near copies share one.
BANDS = 10
LENGTHS = range(5, 12)
#: Bytes of the compressor's shortest match.
MATCH = 4


def windows(text: str, n: int = WORDS) -> list[bytes]:
    w = text.lower().split()
    return [f" {' '.join(w[i : i + n])} ".encode() for i in range(0, len(w), n)]


def _starts(text: str) -> set[bytes]:
    return {b[:k] for b in (f" {w}".encode() for w in set(text.lower().split())) for k in LENGTHS if len(b) >= k}


def families(texts: list[str]) -> list[int]:
    """A number for each text, the same for near copies (equal in a band of word triples' least hashes) and what they chain to."""
    g = np.random.default_rng(11)
    mul, add = (g.integers(1, 1 << 31, BANDS * 3, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    root, seen = list(range(len(texts))), {}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, t in enumerate(texts):
        w = t.lower().split()
        h = np.array(list({zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))}), np.uint64)
        least = np.min(((h[:, None] * mul + add) & np.uint64((1 << 61) - 1)) >> np.uint64(20), axis=0)
        for k in range(BANDS):
            j = seen.setdefault((k, least[3 * k : 3 * k + 3].tobytes()), i)
            root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def _evidence(n: int, u: int, share: float) -> float:
    """Chernoff's bound of the logarithm of the chance that n or more of n + u are toxic where a share is."""
    q = n / (n + u)
    if q <= share:
        return 0.0
    return -(n * np.log(q / share) + (u * np.log((1 - q) / (1 - share)) if u else 0.0))


def toxic_content(toxic: list[list[str]], ordinary: list[list[str]]) -> bytes:
    """The passages that tell families of toxic documents from ordinary ones, the most telling last."""
    if not toxic or not ordinary:
        return b""
    starts = lambda f: set().union(*map(_starts, f))
    nt, no = len(toxic), len(ordinary)
    has = [starts(f) for f in toxic]
    count = Counter(p for ps in has for p in ps)
    count = {p: n for p, n in count.items() if n >= LEAST}
    usual = Counter(p for f in ordinary for p in starts(f) if p in count)
    bound = np.log(CHANCE / max(1, len(count)))
    count = {p: n for p, n in count.items() if n / nt > RATIO * usual[p] / no and _evidence(n, usual[p], nt / (nt + no)) < bound}
    of = [[p for p in ps if p in count] for ps in has]
    where = defaultdict(list)
    for i, ps in enumerate(of):
        for p in ps:
            where[p].append(i)
    need, chosen = [COVER] * nt, []
    while count:
        best = max(count, key=lambda p: (count[p] / nt - 3 * usual[p] / no, len(p), p))
        n = count[best]
        if n < LEAST or n / nt <= RATIO * usual[best] / no:
            count.pop(best)  # others may still tell
            continue
        # the longest passage that nearly all of these documents have
        best = max((p for p in count if p.startswith(best) and count[p] >= 0.85 * n), key=lambda p: (len(p), p))
        count.pop(best)
        chosen.append(best)
        # and what of others isn't in it yet is too short to be matched
        for p in [p for p in count if best.startswith(p[: max(LENGTHS.start, len(p) - MATCH + 1)]) or p.startswith(best)]:
            del count[p]
        for i in where[best]:
            need[i] -= 1
            if need[i] == 0:
                for p in of[i]:
                    if p in count:
                        count[p] -= 1
    return b"".join(reversed(chosen)) + b" "


def ordinary_content(ordinary: list[str]) -> bytes:
    import zstandard

    samples = [w for t in ordinary for w in windows(t, 8)]
    random.Random(17).shuffle(samples)
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples[:ORDINARY_WINDOWS], k=64, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text to train on
        return b"".join(samples)[:ORDINARY_BYTES]


def compressor(content: bytes):
    import zstandard as z

    p = z.ZstdCompressionParameters(strategy=z.STRATEGY_GREEDY, min_match=MATCH, search_log=6, hash_log=14, chain_log=14, window_log=17, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    d = z.ZstdCompressionDict(content or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=p)
    return z.ZstdCompressor(dict_data=d, compression_params=p).compress


def features(text: str, plain, both) -> list[float]:
    saved = np.array([len(plain(w)) - len(both(w)) for w in windows(text)] or [0], float)
    return [saved.max(), np.sort(saved)[-3:].mean(), (saved >= 1).mean(), (saved >= 2).mean(), (saved >= 3).mean(), saved.mean(), saved.sum() / max(1, len(text)), np.log(len(saved))]


class Model:
    """Contents of the two dictionaries, and the curve: means, scales, weights and bias."""

    def __init__(self, ordinary: bytes, toxic: bytes, mean, scale, weights):
        self.ordinary, self.toxic, self.mean, self.scale, self.weights = ordinary, toxic, mean, scale, weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1])))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's steps for penalised logistic regression; the last weight is the bias."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    ridge = np.diag([penalty * len(x)] * x.shape[1] + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def grouped(texts: list[str], family: dict[str, int]) -> list[list[str]]:
    out = defaultdict(list)
    for t in texts:
        out[family[t]].append(t)
    return list(out.values())


def fit(toxic: list[str], ordinary: list[str], odds: float | None = None) -> Model | None:
    """odds: toxic to ordinary documents among all labels, where the texts given are a sample with other odds."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary) - set(toxic))
    if not toxic or not ordinary:
        return None
    family = dict(zip(toxic + ordinary, families(toxic + ordinary), strict=True))
    fold = lambda t: zlib.crc32(str(family[t]).encode()) % FOLDS
    x, y = [], []
    for k in range(FOLDS):
        o = ordinary_content([t for t in ordinary if fold(t) != k])
        c = toxic_content(grouped([t for t in toxic if fold(t) != k], family), grouped([t for t in ordinary if fold(t) != k], family))
        plain, both = compressor(o), compressor(c + o)
        for label, texts in ((1, toxic), (0, ordinary)):
            for t in texts:
                if fold(t) == k:
                    x.append(features(t, plain, both))
                    y.append(label)
    x, y = np.array(x), np.array(y, float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, y)
    if odds:
        weights[-1] += np.log(odds * len(ordinary) / len(toxic))
    return Model(ordinary_content(ordinary), toxic_content(grouped(toxic, family), grouped(ordinary, family)), mean, scale, weights)


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", usable=None) -> tuple[list[str], list[str], float | None]:
    """Texts of labelled toxic and ordinary documents, within the bounds above, and the odds among all usable labels."""
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    if usable is not None:
        marks = marks.where(usable(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select("_id", "_y")
    # only documents that are there and can be taken stand for selection, so that others don't make the sample smaller
    there = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("_id")).distinct().join(marks, "_id")
    there = written(there.withColumn("_h", F.xxhash64("_id")), "toxic-labels")
    ids = [there.where(F.col("_y") == y).orderBy("_h", "_id").limit(n).select("_id", "_y") for y, n in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE))]
    rows = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(ids[0].union(ids[1])), "_id")
    # repeated doc_ids could make more rows than there are labels
    got = rows.orderBy(F.xxhash64("_id"), "_id", "_t").limit(TOXIC_SAMPLE + ORDINARY_SAMPLE).select("_t", "_y").toPandas()
    n = marks.agg(F.count_if(F.col("_y") == 1).alias("t"), F.count_if(F.col("_y") == 0).alias("o")).first()
    freed(there)
    return list(got["_t"][got["_y"] == 1]), list(got["_t"][got["_y"] == 0]), n.t / n.o if n.t and n.o else None


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (double) of every row of docs, and the columns `carry`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches):
        m = shared.value
        plain, both = (compressor(m.ordinary), compressor(m.toxic + m.ordinary)) if m else (None, None)
        for b in trimmed(batches):
            texts = as_strings(b.column(1))
            s = m(np.array([features(t.as_py(), plain, both) for t in texts]).reshape(-1, 8)) if m else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), *b.columns[2:]], names=["doc_id", "score", *carry])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *carry).mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double{kinds}")


def keep_clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is under 0.5."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        m = shared.value
        plain, both = (compressor(m.ordinary), compressor(m.toxic + m.ordinary)) if m else (None, None)
        for b in trimmed(batches):
            if m is None or not b.num_rows:
                yield b
            else:
                yield b.filter(pa.array(m(np.array([features(t.as_py(), plain, both) for t in as_strings(b.column(at))])) < 0.5))

    rows = docs.select(*numbered(docs.columns))
    return rows.mapInArrow(run, rows.schema).select(*renamed(docs.columns))


def learnable(doc_id):
    """Rows that a model may learn from: crc32 of the doc_id's text modulo 5 isn't 0."""
    return crc_mod(doc_id, 5) != 0


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(*sample(docs, read(spark, sf_dir, "labels"), usable=learnable))
    rows = score(docs, model)
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op4_toxicity": op4_toxicity}
ORACLE: dict[str, str] = {}

"""Language-model scoring with a hashed maximum-entropy model.

P(word | context) = P(class | context) * P(word | class). The first factor is a softmax over CLASSES classes whose logits are
sums of weights of hashed features of the context: the class of the word before (bigram), of the word two before (skip), of the
group of the word three before (skip), and the pairs of the first with the second (trigram) and third (skip pair). The second is
(count + 1) / (words of the class + its vocabulary + 1). END is a class, the TOP most frequent words are one each, and the
rest are spread over clusters by their first two bytes. Words never seen in training share one place of their cluster.

Training covers every training document. The contexts are classes, so the log likelihood depends on the corpus only through
how often each class follows each of the CONTEXTS contexts: these counts are taken in one pass, stay in a table, and
every step has its tasks compute the gradient of their contexts and sum it (ROUNDS steps of Adam on the driver's
FEATURES x CLASSES weights, whose size doesn't depend on the corpus).

Word counts go by 64-bit keys (58 bits of hash, 6 of cluster). For scoring, documents are dealt to blocks by a hash of doc_id;
each block sends its distinct words to the shards and gets their counts over the corpus back, so no vocabulary is broadcast.

Cases: null texts are empty and have the one token END; without training documents all counts are 0 and the classes are even;
repeated rows count and are scored each; a very long text is in one block, in memory as about 60 bytes a word; of words as frequent as the
last of the TOP the smaller key is taken; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import LOWER, as_strings, crc_mod, mix, raw, read, slices, spans, trimmed, word_hashes, written

CLASSES, TOP, CLUSTERS = 64, 23, 40
GROUPS = 8
CONTEXTS = CLASSES * CLASSES * GROUPS
FEATURES = 1 << 13
ROUNDS, RATE, RIDGE, TASKS = 30, 0.15, 1e-6, 8
BLOCK_TEXT, SHARD_KEYS = 4 << 20, 1 << 20
#: Distinct words a task holds before it sends their counts on.
HELD_KEYS = 1 << 21

_LOW6 = np.uint64(63)


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts and words per text."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, k in slices(col):
        data, off = raw(col.slice(i, k))
        data = LOWER[data]
        s, e, first = spans(data, off)
        head = data[s].astype(np.uint64) | np.where(e - s > 1, data[np.minimum(s + 1, max(0, len(data) - 1))], 0).astype(np.uint64) << np.uint64(8)
        keys.append((word_hashes(data, s, e) & ~_LOW6) | (mix(head) % np.uint64(CLUSTERS)))
        counts.append(np.diff(first))
    return np.concatenate(keys), np.concatenate(counts)


def classes_of(keys: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Classes of the tokens of all texts, an END (class 0) after each. top: keys of the frequent words, sorted."""
    g = (keys & _LOW6).astype(np.int64) + 1 + TOP
    if len(top):
        at = np.minimum(np.searchsorted(top, keys), len(top) - 1)
        hit = top[at] == keys
        g[hit] = at[hit] + 1
    return np.insert(g, np.cumsum(n), 0)


def contexts_of(g: np.ndarray) -> np.ndarray:
    """The context of each token; an END, also the one before the first text, hides what is before it."""
    one, two, three = (np.concatenate((np.zeros(k, np.int64), g))[: len(g)] for k in (1, 2, 3))
    two = np.where(one == 0, 0, two)
    three = np.where(two == 0, 0, three)
    return (three % GROUPS * CLASSES + two) * CLASSES + one


def features_of(context: np.ndarray) -> np.ndarray:
    """Hashed feature numbers, five for each context."""
    one, two, three = context % CLASSES, context // CLASSES % CLASSES, context // CLASSES**2
    parts = (one, two, three, one * CLASSES + two, one * GROUPS + three)
    return np.stack([(mix((p + (k << 20)).astype(np.uint64)) % np.uint64(FEATURES)).astype(np.int64) for k, p in enumerate(parts)], 1)


def log_classes(context: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = weights[features_of(context)].sum(1) + bias
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


# ---------------------------------------------------------------- counts over the corpus

PARTS = "shard int, block int, keys binary, counts binary"


def _cut(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.concatenate(([0], np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(keys)])) if bits else np.array([0, len(keys)])


def _deal(block: int, keys: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    cut = _cut(keys, bits)
    full = np.flatnonzero(np.diff(cut))
    blobs = lambda a: pa.array([a[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int32()), blobs(keys), blobs(counts)], names=["shard", "block", "keys", "counts"])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, of = np.unique(keys, return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, of, counts)
    return each, total


def _read(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()], [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()]


class Vocabulary:
    """What the model keeps of the counts: tokens and vocabulary of each class, keys of the frequent words, and the totals."""

    def __init__(self, top: np.ndarray, class_tokens: np.ndarray, class_types: np.ndarray):
        self.top, self.class_tokens, self.class_types = top, class_tokens, class_types
        self.tokens, self.types = int(class_tokens.sum()), int(class_types.sum())
        self.ends = int(class_tokens[0])


def vocabulary(train: DataFrame, bits: int) -> Vocabulary:
    """train: texts in column `_text`. Two numbers for each cluster and the most frequent words come to the driver."""

    def count(batches):
        held, size = [], 0
        for b in trimmed(batches):
            col = as_strings(b.column(0))
            for i, k in slices(col):
                held.append(np.unique(tokens(col.slice(i, k))[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD_KEYS:
                    held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                    if len(held[0][0]) > HELD_KEYS // 2:
                        yield _deal(0, *held.pop(), bits)
                    size = sum(len(x[0]) for x in held)
        if held:
            yield _deal(0, *summed(*map(np.concatenate, zip(*held, strict=True))), bits)

    def add(table):
        keys, counts = summed(*map(np.concatenate, _read(table)))
        cluster = (keys & _LOW6).astype(np.int64)
        n, v = np.bincount(cluster, counts, CLUSTERS).astype(np.int64), np.bincount(cluster, minlength=CLUSTERS)
        best = np.lexsort((keys, -counts))[:TOP]
        return pa.table({"top": pa.array([False] * CLUSTERS + [True] * len(best)), "key": pa.array(np.concatenate((np.arange(CLUSTERS), keys[best].view(np.int64)))), "n": pa.array(np.concatenate((n, counts[best]))), "v": pa.array(np.concatenate((v, np.ones(len(best), np.int64))), pa.int64())})

    stats = written(train.select("_text").mapInArrow(count, PARTS).groupBy("shard").applyInArrow(add, "top boolean, key long, n long, v long"), "lm-stats")
    n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    n[0] = train.count()
    v[0] = n[0] > 0
    for r in stats.where("not top").groupBy("key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        n[1 + TOP + r.key], v[1 + TOP + r.key] = r.n, r.v
    best = stats.where("top").orderBy(F.col("n").desc(), "key").limit(TOP).collect()
    top = np.array([r.key for r in best], np.int64).view(np.uint64)
    order = np.argsort(top)
    for place, k in enumerate(order):
        cluster = 1 + TOP + int(top[k] & _LOW6)
        n[1 + place], v[1 + place] = best[k].n, 1
        n[cluster] -= best[k].n
        v[cluster] -= 1
    return Vocabulary(top[order], n, v)


# ---------------------------------------------------------------- the classes' model


def context_counts(train: DataFrame, vocab: Vocabulary) -> DataFrame:
    """context and how often each class follows it, over all training texts; one row a context that occurs."""
    shared = train.sparkSession.sparkContext.broadcast(vocab.top)

    def count(batches):
        total = np.zeros(CONTEXTS * CLASSES, np.int64)
        for b in trimmed(batches):
            col = as_strings(b.column(0))
            for i, k in slices(col):
                g = classes_of(*tokens(col.slice(i, k)), shared.value)
                total += np.bincount(contexts_of(g) * CLASSES + g, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell // CLASSES, pa.int32()), pa.array(cell % CLASSES, pa.int32()), pa.array(total[cell])], names=["context", "class", "n"])

    cells = train.select("_text").mapInArrow(count, "context int, class int, n long").groupBy("context", "class").agg(F.sum("n").alias("n"))
    return written(cells.groupBy("context").agg(F.collect_list(F.struct("class", "n")).alias("next")).repartition(TASKS, "context"), "lm-contexts")


def _tables(batches):
    for b in trimmed(batches):
        context, counts = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.zeros((b.num_rows, CLASSES))
        for k, row in enumerate(b.column(1).to_pylist()):
            for c in row:
                counts[k, c["class"]] = c["n"]
        if len(context):
            yield context, counts


def train_classes(contexts: DataFrame, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by gradient steps; the tasks' gradients are summed."""
    sc = contexts.sparkSession.sparkContext
    bias = np.log((vocab.class_tokens + 1) / (vocab.class_tokens + 1).sum())
    weights = np.zeros((FEATURES, CLASSES))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    scale = max(1, vocab.tokens)
    for step in range(1, ROUNDS + 1 if vocab.tokens else 1):
        shared = sc.broadcast((weights.astype(np.float32), bias))

        def gradient(batches):
            w, b = shared.value  # noqa: B023
            out, used = np.zeros((FEATURES, CLASSES)), np.zeros(FEATURES, bool)
            for context, counts in _tables(batches):
                miss = np.exp(log_classes(context, w, b)) * counts.sum(1, keepdims=True) - counts
                for f in features_of(context).T:
                    order = np.argsort(f, kind="stable")
                    each, first = np.unique(f[order], return_index=True)
                    out[each] += np.add.reduceat(miss[order], first, axis=0)
                    used[each] = True
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([out[at].tobytes()], pa.binary())], names=["features", "g"])

        g = RIDGE * scale * weights
        for r in contexts.mapInArrow(gradient, "features binary, g binary").collect():  # a few MB from each of at most TASKS tasks
            g[np.frombuffer(r.features, np.int64)] += np.frombuffer(r.g).reshape(-1, CLASSES)
        g /= scale
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        rate = RATE / math.sqrt(step)
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        shared.unpersist()
    return weights.astype(np.float32), bias


# ---------------------------------------------------------------- scoring


def score_texts(docs: DataFrame, train=None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigram) and score (the model), both log10 probabilities of
    the whole text, of every row of docs. train: a condition on doc_id for the documents to learn from (all)."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(text, F.lit("")).alias("_text"), (train(F.col(doc_id)) if train else F.lit(True)).alias("_train"))
    size = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    bits = max(6, math.ceil(math.log2(max(1, size / 40 / SHARD_KEYS))))
    blocks = max(1, math.ceil(size / BLOCK_TEXT))
    vocab = vocabulary(rows.where("_train"), bits)
    weights, bias = train_classes(context_counts(rows.where("_train"), vocab), vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights, bias))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("_id"), F.lit(blocks)).cast("int"))
    by_block = lambda: dealt.groupBy("block")

    def offer(table):
        keys, n = tokens(as_strings(table["_text"]))
        counted = np.repeat(table["_train"].to_numpy(zero_copy_only=False).astype(bool), n)
        return pa.Table.from_batches([_deal(table["block"][0].as_py(), *summed(keys, counted.astype(np.int64)), bits)])

    def answer(table):
        keys, counts = _read(table)
        each, total = summed(np.concatenate(keys), np.concatenate(counts))
        return table.select(["shard", "block"]).append_column("counts", pa.array([total[np.searchsorted(each, k)].tobytes() for k in keys], pa.binary()))

    counts = by_block().applyInArrow(offer, PARTS).groupBy("shard").applyInArrow(answer, "shard int, block int, counts binary")

    def score(table, answers):
        vocab, weights, bias = shared.value
        keys, n = tokens(as_strings(table["_text"]))
        each, of = np.unique(keys, return_inverse=True)
        total, cut = np.zeros(len(each), np.int64), _cut(each, bits)
        for s, data in zip(answers["shard"].to_pylist(), answers["counts"].to_pylist(), strict=True):
            total[cut[s] : cut[s + 1]] = np.frombuffer(data, np.int64)
        ends = np.cumsum(n)
        c = np.insert(total[of].astype(float), ends, vocab.ends)
        g = classes_of(keys, n, vocab.top)
        context, at = np.unique(contexts_of(g), return_inverse=True)
        model = np.zeros(len(g))
        for i in range(0, len(context), 8192):  # log probabilities of the classes, for the contexts of the block
            here = (at >= i) & (at < i + 8192)
            model[here] = log_classes(context[i : i + 8192], weights, bias)[at[here] - i, g[here]]
        model += np.log((c + 1) / (vocab.class_tokens + vocab.class_types + 1)[g])
        base = np.log((c + 1) / (vocab.tokens + vocab.types + 1))
        doc = np.repeat(np.arange(len(n)), n + 1)
        add = lambda x: np.bincount(doc, x, len(n))
        return pa.table({"doc_id": table["_id"], "n_tokens": pa.array(n + 1, pa.int64()), "n_known": pa.array(add(c > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(n), vocab.tokens)), "base_score": pa.array(add(base) / math.log(10)), "score": pa.array(add(model) / math.log(10))})

    return by_block().cogroup(counts.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def learnable(doc_id):
    """Rows to learn from: crc32 of the doc_id's text modulo 7 isn't 2."""
    return crc_mod(doc_id, 7) != 2


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score_texts(read(spark, sf_dir, "documents"), learnable)
    return rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
ORACLE: dict[str, str] = {}

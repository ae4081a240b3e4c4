"""Token-ID output as directly addressable codes.

A segment holds the ids of a run of documents in ascending doc_id order. An id is cut into chunks of 8 bits, lowest
first; level k holds the k-th chunk of every id that has one, and a bitmap says for each of them whether another chunk
follows. A rank directory counts the set bits before every block of 512, so that the place of an id's next chunk is
one lookup and one popcount of at most 512 bits: any id is read without decoding its neighbours.

Bytes of a segment (little-endian):
    8s magic 'SHLDAC1\\0', u32 levels, u32 documents, u64 ids, u32 crc32 of all that follows
    documents x (u8 has_id, i64 doc_id), (documents + 1) x u64 place of the document's first id
    for each level: u64 entries; entries x u8; where it isn't the last: ceil(entries / 8) bytes of bitmap (bit i % 8 of
    byte i // 8), and (entries // 512 + 1) x u64 ranks

A store is a folder of Parquet files, written by Spark so that it can be on any file system the cluster has, with one
segment a row: (part, seq) in order, first id and document counts, and the bytes. Nothing else about ids is kept.

Cases: a null text is empty; every document gets the end id, so an empty one has one id; doc_id null comes first;
rows that share a doc_id follow each other in order of text; an empty table gives a store without segments; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shoreline.llm.base import as_strings, read, scratch, slices, trimmed

MAGIC = b"SHLDAC1\0"
HEAD = struct.Struct("<8sIIQI")
RANK = 512
END_ID = 2
SEGMENT_TEXT = 4 << 20
PART_TEXT = 64 << 20
#: Segments whose starts may be sent to every executor (about 40 bytes each).
BROADCAST_SEGMENTS = 1 << 18
#: Words and pieces that a worker remembers (about 200 bytes each).
WORDS = 1_500_000


# ---------------------------------------------------------------- the codes


def pack(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray) -> bytes:
    """A segment of documents whose ids stand at starts[k]:starts[k + 1]."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        levels.append(((rest & 255).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    table = np.zeros(len(doc_ids), np.dtype([("has", "u1"), ("id", "<i8")]))
    table["has"] = [d is not None for d in doc_ids]
    table["id"] = [d or 0 for d in doc_ids]
    out = [table.tobytes(), starts.astype("<u8").tobytes()]
    for k, (chunk, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if k < len(levels) - 1:
            ones = np.concatenate(([0], np.cumsum(more)))
            out += [np.packbits(more, bitorder="little").tobytes(), ones[: len(more) + 1 : RANK][: len(more) // RANK + 1].astype("<u8").tobytes()]
    body = b"".join(out)
    return HEAD.pack(MAGIC, len(levels), len(doc_ids), len(ids), zlib.crc32(body)) + body


class Segment:
    """Reads a packed segment. ids() decodes all; seg[i] reads one id by rank."""

    def __init__(self, data: bytes):
        magic, levels, self.documents, self.n_ids, crc = HEAD.unpack_from(data)
        if magic != MAGIC or zlib.crc32(memoryview(data)[HEAD.size :]) != crc:
            raise ValueError("not a token segment, or damaged")
        at = HEAD.size
        table = np.frombuffer(data, np.dtype([("has", "u1"), ("id", "<i8")]), self.documents, at)
        at += table.nbytes
        self.doc_ids = [int(i) if h else None for h, i in zip(table["has"], table["id"], strict=True)]
        self.starts = np.frombuffer(data, "<u8", self.documents + 1, at).astype(np.int64)
        at += 8 * (self.documents + 1)
        self.levels = []
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k < levels - 1:
                bits = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u8", n // RANK + 1, at)
                at += 8 * len(ranks)
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return self.n_ids

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if bits is None or not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK
            i = int(ranks[block]) + int(np.unpackbits(bits[block * RANK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK].sum())
        return value

    def ids(self) -> np.ndarray:
        value = None
        for chunk, bits, _ in reversed(self.levels):
            here = chunk.astype(np.uint32)
            if bits is not None:
                here[np.unpackbits(bits, count=len(chunk), bitorder="little").view(bool)] |= value << np.uint32(8)
            value = here
        return value


# ---------------------------------------------------------------- the tokenizer


def pack_ids(*ids: int) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Words and their ids; a new one is encoded when it is asked for."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, w: str) -> bytes:
        found = self[w] = self.encode(w)
        return found


class WordEncoder:
    """Encodes texts word by word with a remembered dictionary.

    White space is never part of a token of the tokenizers taken here, so the ids of a text are those of its words.
    A new word of letters below U+0300 is split by the tokenizer's own pattern and given to the tokenizer's model
    piece by piece; any other word, and any tokenizer of another make, goes through encode()."""

    NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, path: str, most: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, pre = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = normal.get("normalizers") == self.NORMAL and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and not pre[1]["add_prefix_space"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.by_word = self.by_word and not any(re.search(r"\s", t) for t in self.special)
        self.mark = os.path.commonprefix(self.special) or None
        self.find = re.compile(r"[^ \n\t\r]+").findall
        self.split = regex.compile(pre[0]["pattern"]["Regex"]).findall if self.by_word else None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.model = self.whole.model
        self.words = _Words(self._word)
        self.pieces: dict[str, bytes] = {}
        self.most = most

    def _piece(self, p: str) -> bytes:
        found = self.pieces.get(p)
        if found is None:
            letters = p if p.isascii() and p.isprintable() else "".join(map(self.letter.__getitem__, p.encode()))
            found = self.pieces[p] = pack_ids(*[t.id for t in self.model.tokenize(letters)])
        return found

    def _word(self, w: str) -> bytes:
        if max(w) < "̀" and not (self.special and (self.mark is None or self.mark in w)):
            low = w.lower()
            if max(low) < "̀":
                if low.isalpha():  # one run of letters, as the pattern takes it
                    return self._piece(low)
                if low[-1] in ".," and low[:-1].isalpha():
                    return self._piece(low[:-1]) + self._piece(low[-1])
                return b"".join(map(self._piece, self.split(low)))
        return self._encode(w)

    def _encode(self, t: str) -> bytes:
        return pack_ids(*self.whole.encode(t, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return [self._encode(t) for t in texts]
        if len(self.words) + len(self.pieces) > self.most:
            self.words.clear()
            self.pieces.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, self.find(t))) for t in texts]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- stores

SEGMENTS = "part int, seq int, n_docs long, n_ids long, payload binary"


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all texts, each with end_id after it, in order of doc_id."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PART_TEXT))
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")).repartitionByRange(parts, "d").sortWithinPartitions("d", "t")

    def run(batches):
        from pyspark import TaskContext

        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in trimmed(batches):
            col, names = as_strings(b.column(1)), b.column(0).to_pylist()
            for i, k in slices(col, SEGMENT_TEXT):
                coded = enc.encode(col.slice(i, k).to_pylist())
                starts = np.concatenate(([0], np.cumsum([len(x) // 4 + 1 for x in coded])))
                ids = np.frombuffer(b"".join(chain.from_iterable((x, end) for x in coded)), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([k]), pa.array([len(ids)]), pa.array([pack(names[i : i + k], ids, starts)], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])
                seq += 1

    rows.mapInArrow(run, SEGMENTS).write.option("compression", "none").parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    """The segments of a store with `first`, the number of ids before each."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sums = segments.select("part", "seq", "n_ids")
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0))).drop("n")
    starts = sums.join(parts, "part").withColumn("first", F.col("_before") + F.coalesce(F.sum("n_ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))).select("part", "seq", "first")
    if sums.count() <= BROADCAST_SEGMENTS:
        starts = F.broadcast(starts)
    return segments.join(starts, ["part", "seq"])


def read_documents(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store and, where asked for, its ids."""

    def run(batches):
        for b in trimmed(batches):
            for first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seg = Segment(data)
                flat, at = seg.ids().astype("<u4", copy=False), seg.starts
                crc = [zlib.crc32(flat[a:z]) for a, z in zip(at, at[1:], strict=False)]
                cols = [pa.array(seg.doc_ids, pa.int64()), pa.array(at[:-1] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    return open_store(spark, path).select("first", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def read_token(spark: SparkSession, path: str, place: int) -> int:
    """The id at a place of the whole store, from one segment."""
    row = open_store(spark, path).where((F.col("first") <= place) & (place < F.col("first") + F.col("n_ids"))).select("first", "payload").first()
    if row is None:
        raise IndexError(place)
    return Segment(bytes(row.payload))[place - row.first]


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "tokens")
    write_store(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_documents(spark, path)


QUERIES = {"op3_token_store": op3_token_store}
ORACLE: dict[str, str] = {}

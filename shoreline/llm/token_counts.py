"""Token counts without ids: pieces are counted once per distinct pre-token and joined to each document's
pre-token frequencies.

A SentencePiece BPE merge never crosses a border that no piece of the vocabulary spans. No piece has a space
mark after another character, and none holds a line feed, so a text falls into independent pre-tokens: a run of
space marks with what follows it, or a line feed with what follows it. The operator checks both properties of the
model it is given and otherwise counts whole texts.

1. Texts are read once. Every slice of a few MB becomes a row: its distinct pre-tokens, and for each document which of them it has and
   how often, as steps in the order of the pre-tokens, in the smallest integers that hold them, compressed. From here on no text is needed.
2. The distinct pre-tokens of the slices go by hash to shards. A shard counts the pieces of each of its pre-tokens once, however many
   slices have it, and answers each slice. A pre-token that all documents share costs a shard one entry a slice.
3. Slices and answers meet, and each document's frequencies times pieces are summed.

Cases: a null text counts as empty, and empty texts have 0 bytes and 0 tokens; repeated rows are counted row by
row; a text larger than a slice is a slice of its own, and one without blanks a single pre-token; pre-tokens of a slice are told apart
by 64 bits of hash, those of a shard by their text; an empty table gives an empty result; columns of the input other than doc_id
and text are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import as_strings, column, raw, read, slices, text_bytes, trimmed, word_hashes, written

SPACE = "▁"
#: Text of a slice, and pre-tokens of a shard.
SLICE_TEXT, SHARD_TOKENS = 4 << 20, 1 << 18
BYTES_A_TOKEN = 60
ANSWERS = "slice long, shard int, pieces binary"


class PieceCounter:
    """Counts the pieces of pre-tokens under one SentencePiece model."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces) and self._plain()

    def _plain(self) -> bool:
        """Whether the model's normaliser only puts a space mark in front and keeps all spaces."""
        odd = ["a  b", " a", "a ", "\ta", "\n", "ﬁ", "é", "　x"]
        return all(self.model.decode(self.model.encode(t)) == t for t in odd)

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def pieces(self, tokens: list[str]) -> np.ndarray:
        """A pre-token's leading space stands for the mark the model puts in front; one with a line feed gets the
        mark in addition."""
        n = np.array(self.whole([t[1:] if t[0] == " " else t for t in tokens]), np.int64)
        n -= np.array([t[0] == "\n" for t in tokens], np.int64)
        n[[k for k, t in enumerate(tokens) if t == " "]] = 1
        return n


@functools.lru_cache(2)
def counter(model: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(model)


def pretokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with a space before each that isn't empty, starts and ends of their pre-tokens, and the text each is in."""
    col = pc.replace_substring(col, SPACE, " ")
    col = pc.if_else(pc.equal(col, ""), col, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), col, pa.scalar("", pa.large_string())))
    data, off = raw(col)
    if not len(data):
        return data, *(np.zeros(0, np.int64),) * 3
    blank = data == 32
    new = blank.copy()
    new[1:] &= ~blank[:-1]
    first = off[:-1][np.diff(off) > 0]
    new[first] = True  # each begins with a blank
    new |= data == 10
    starts = np.flatnonzero(new)
    return data, starts, np.append(starts[1:], len(data)), np.searchsorted(off, starts, "right") - 1


def _tight(a: np.ndarray) -> bytes:
    """The width of the smallest unsigned integers that hold all values, and these by planes of bytes, compressed."""
    import zstandard

    kind = np.min_scalar_type(int(a.max(initial=0)))
    return bytes([kind.itemsize]) + zstandard.compress(np.ascontiguousarray(a.astype(kind).view(np.uint8).reshape(len(a), kind.itemsize).T).tobytes(), 3)


def _loose(b: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").reshape(-1).astype(np.int64)


def _pack(words: list[bytes]) -> bytes:
    import zstandard

    return np.uint32(len(words)).tobytes() + zstandard.compress(np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words), 3)


def _unpack(b: bytes) -> list[bytes]:
    import zstandard

    n, body = int(np.frombuffer(b[:4], "<u4")[0]), zstandard.decompress(b[4:])
    at = np.concatenate(([0], np.cumsum(np.frombuffer(body[: 4 * n], "<u4").astype(np.int64)))) + 4 * n
    return [body[x:y] for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _sliced(docs: DataFrame, doc_id: str, text: str, shards: int) -> DataFrame:
    """A row a slice: doc ids, bytes, frequencies (how many pre-tokens each document has, which as steps in their order, how often) and the
    pre-tokens of each shard."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in trimmed(batches):
            col = as_strings(b.column(1))
            _, off = raw(col)
            for i, k in slices(col, SLICE_TEXT):
                data, s, e, doc = pretokens(col.slice(i, k))
                h = word_hashes(data, s, e)
                each, at, of = np.unique(h, return_index=True, return_inverse=True)
                shard = (each % np.uint64(shards)).astype(np.int64)
                tokens = [data[x:y].tobytes() for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)]
                order = sorted(range(len(tokens)), key=lambda j: (shard[j], tokens[j]))  # noqa: B023
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                pair, times = np.unique(doc * max(1, len(each)) + place[of], return_counts=True)
                which, doc = pair % max(1, len(each)), pair // max(1, len(each))
                sizes = np.bincount(doc, minlength=k)
                steps = np.diff(which, prepend=0)
                first = (np.cumsum(sizes) - sizes)[sizes > 0]
                steps[first] = which[first]
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                parts = [_pack([tokens[j] for j in order[x:y]]) if y > x else None for x, y in zip(cut, cut[1:], strict=False)]
                row = [pa.array([number]), pa.array([b.column(0).slice(i, k).to_pylist()], pa.list_(b.column(0).type)), pa.array([np.diff(off[i : i + k + 1])], pa.list_(pa.int64()))]
                row += [pa.array([x], pa.binary()) for x in (_tight(sizes), _tight(steps), _tight(times))]
                yield pa.RecordBatch.from_arrays([*row, pa.array([parts], pa.list_(pa.binary()))], names=["slice", "ids", "n_bytes", "sizes", "steps", "times", "tokens"])
                number += 1

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, f"slice long, ids array<{id_type}>, n_bytes array<long>, sizes binary, steps binary, times binary, tokens array<binary>")


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of each row of docs."""
    out = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"
    if not PieceCounter(model).separable:

        def whole(batches):
            for b in trimmed(batches):
                col = as_strings(b.column(1))
                n = np.array(counter(model).whole(col.to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(raw(col)[1])), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

        return docs.select(doc_id, text).mapInArrow(whole, out)
    shards = max(16, math.ceil(text_bytes(docs, text) / BYTES_A_TOKEN / SHARD_TOKENS))
    rows = written(_sliced(docs, doc_id, text, shards), "token-slices")

    def answer(table):
        words = [_unpack(x) for x in table["tokens"].to_pylist()]
        coded = pa.array([w for ws in words for w in ws], pa.binary()).dictionary_encode()
        n = counter(model).pieces([w.decode("utf-8") for w in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        at = np.concatenate(([0], np.cumsum([len(ws) for ws in words])))
        return table.select(["slice", "shard"]).append_column("pieces", pa.array([_tight(n[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.binary()))

    def total(table, answers):
        cols, parts = [], answers.sort_by("shard")["pieces"].to_pylist() if answers.num_rows else []
        pieces = np.concatenate([_loose(x) for x in parts]) if parts else np.zeros(0, np.int64)
        for ids, n_bytes, sizes, steps, times in zip(*(table[c] for c in ("ids", "n_bytes", "sizes", "steps", "times")), strict=True):
            sizes, steps, times = (_loose(x.as_py()) for x in (sizes, steps, times))
            sums = np.cumsum(steps)
            first = np.cumsum(sizes) - sizes
            before = np.concatenate(([0], sums))[first]
            which = sums - np.repeat(before, sizes)
            n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), pieces[which] * times, len(sizes)).astype(np.int64)
            cols.append(pa.table([ids.values, n_bytes.values, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"]))
        return pa.concat_tables(cols)

    asked = rows.select("slice", F.posexplode("tokens").alias("shard", "tokens")).where("tokens is not null")
    answers = asked.groupBy("shard").applyInArrow(answer, ANSWERS)
    return rows.drop("tokens").groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(total, out)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}

"""Substring dedup by repeated-phrase automata.

A window is WINDOW consecutive words of a document. A word goes if a window that covers it also starts earlier: in a
smaller doc_id, or in the same document at an earlier word.

1. Documents are dealt to blocks, ranges of doc_id of a few MB of text, in order.
2. Candidates: every window names its smallest 5-word hash (winnowing: equal windows name the same one, and about one
   word in nine is named). Blocks exchange the distinct names; names that one block alone has are dropped.
3. Confirmation: windows with a shared name are exchanged as 128-bit hashes, and each block learns which of its windows
   an earlier block has. Repeats within a block are found there.
4. Each distinct confirmed window of a block is known by its phrase, the NAME words of its smallest hash. The distinct phrases are
   compiled into Aho-Corasick automata (pyahocorasick, one character a word), in shards of PHRASES words; all documents of
   the block are streamed through them. What is found there, and nothing else, decides: every occurrence proposes the windows around it,
   128 bits say whether one is a confirmed passage, and all but the first of the corpus are removed.

What is exchanged goes by hash, each block giving a phrase once however often it holds it, so that a passage that a third of
all documents share costs a shard one entry a block. Nothing is collected; the texts are shuffled once.

Cases: null texts have no words; rows with equal doc_id are ordered by text, and equal rows count as earlier and later;
null doc_ids come first; ids that are no integers are an error; documents shorter than a window keep all; a very long text is in one block, in memory as about 50 bytes a word; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import as_strings, block_count, column, hashed_words, in_blocks, mix, read

WINDOW, NAME = 20, 5
BLOCK_TEXT = 4 << 20
SHARD_BYTES = 8 << 20
#: Words of the phrases of one automaton; about 60 bytes each. No more than characters that can number them.
PHRASES = 500_000

_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5, 0xD6E8FEB86659FD93 | 5)


def _runs(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """A hash of every k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    up = np.full(len(h) + 1, base, np.uint64)
    up[0] = 1
    up = np.cumprod(up, dtype=np.uint64)
    down = np.full(len(h) + 1, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    down = np.cumprod(down, dtype=np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h ^ np.uint64(base)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


class Block:
    """The documents of a block in order, their word hashes and windows."""

    def __init__(self, table: pa.Table, window: int = WINDOW):
        table = table.combine_chunks().sort_by([("_id", "ascending"), ("_text", "ascending")]) if table.num_rows else table
        null = pc.is_null(table["_id"]).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, bool)
        if null.any():
            table = table.take(pa.array(np.concatenate((np.flatnonzero(null), np.flatnonzero(~null)))))
        self.ids, self.texts, self.k = table["_id"], as_strings(table["_text"]), window
        self.h, self.n = hashed_words(self.texts)
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        doc = np.repeat(np.arange(len(self.n)), self.n)
        self.doc = doc
        last = len(self.h) - window + 1
        self.at = np.flatnonzero(doc[: max(last, 0)] == doc[window - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def names(self) -> np.ndarray:
        """The name of each window, mixed."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        g = _runs(self.h, NAME, _BASES[2])
        span, done = self.k - NAME + 1, 1
        while done < span:  # minimum over `span` neighbours by doubling
            step = min(done, span - done)
            g = np.minimum(g[:-step], g[step:])
            done += step
        return mix(g[self.at])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        return _runs(self.h, self.k, _BASES[0])[self.at], _runs(self.h, self.k, _BASES[1])[self.at]


def _deal(block: int, keys: np.ndarray, bits: int, kind: int, more: np.ndarray | None = None) -> pa.Table:
    """Rows (kind, shard, block, data) of sorted keys by their leading bits."""
    cut = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    cut = np.concatenate(([0], cut, [len(keys)]))
    full = np.flatnonzero(np.diff(cut))
    data = keys if more is None else np.stack((keys, more), 1)
    return pa.table({"kind": pa.array(np.full(len(full), kind), pa.int32()), "shard": pa.array(full, pa.int32()), "block": pa.array(np.full(len(full), block), pa.int32()), "data": pa.array([data[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())})


SHARES = "kind int, shard int, block int, data binary"


def _bits(marks: pa.Table, kind: int, shards: int, keys: np.ndarray) -> np.ndarray:
    """The marks of all keys of a block, from the bitmaps its shards sent back."""
    out = np.zeros(len(keys), bool)
    if not len(keys):
        return out
    cut = np.concatenate(([0], np.searchsorted(keys, np.arange(1, 1 << shards, dtype=np.uint64) << np.uint64(64 - shards)), [len(keys)]))
    for k, s, data in zip(*(marks[c].to_pylist() for c in ("kind", "shard", "data")), strict=True):
        if k == kind:
            n = cut[s + 1] - cut[s]
            out[cut[s] : cut[s + 1]] = np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(bool)
    return out


def _shared_names(table: pa.Table) -> pa.Table:
    """A shard's answer to each block: which of its names another block has."""
    parts = [np.frombuffer(x, np.uint64) for x in table["data"].to_pylist()]
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    mark = np.zeros(len(keys), bool)
    mark[order[1:][same]] = True
    mark[order[:-1][same]] = True
    return _answer(table, mark, [len(p) for p in parts])


def _earlier_windows(table: pa.Table) -> pa.Table:
    """A shard's answer to each block: which of its windows an earlier block has."""
    parts = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in table["data"].to_pylist()]
    keys = np.concatenate(parts)
    block = np.repeat(np.array(table["block"].to_pylist(), np.int64), [len(p) for p in parts])
    order = np.lexsort((block, keys[:, 1], keys[:, 0]))
    k = keys[order]
    mark = np.zeros(len(keys), bool)
    mark[order[1:][(k[1:] == k[:-1]).all(1)]] = True
    return _answer(table, mark, [len(p) for p in parts])


def _answer(table: pa.Table, mark: np.ndarray, sizes: list[int]) -> pa.Table:
    at = np.concatenate(([0], np.cumsum(sizes)))
    return table.select(["kind", "shard", "block"]).append_column("data", pa.array([np.packbits(mark[a:z]).tobytes() for a, z in zip(at, at[1:], strict=False)], pa.binary()))


def anchors(names: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """The place of the first smallest of the `span` names from each of the places `at`."""
    found = np.empty(len(at), np.int64)
    for i in range(0, len(at), 1 << 16):
        part = at[i : i + (1 << 16)]
        found[i : i + len(part)] = part + names[part[:, None] + np.arange(span)].argmin(1)
    return found


def numbered(words: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The place of each word among the sorted words `used`, plus 1; 0 for others. Most others are told by a few bits of their hash."""
    bits = np.uint64(max(12, int(len(used)).bit_length() + 3))
    some = np.zeros(1 << int(bits), bool)
    some[used >> (np.uint64(64) - bits)] = True
    out = np.zeros(len(words), np.int64)
    at = np.flatnonzero(some[words >> (np.uint64(64) - bits)])
    place = np.minimum(np.searchsorted(used, words[at]), len(used) - 1)
    out[at] = np.where(used[place] == words[at], place + 1, 0)
    return out


def locate(words: np.ndarray, phrases: np.ndarray, offsets: np.ndarray, size: int = NAME) -> np.ndarray:
    """Starts of windows that occurrences of the phrases propose. A phrase is `size` words from a place in `phrases`; the window that it
    stands for starts as many words before as `offsets` says.

    The distinct phrases are compiled into automata of about PHRASES words; all words are streamed through each, and every
    occurrence proposes the windows of its phrase, wherever it stands."""
    import ahocorasick

    if not len(phrases):
        return np.zeros(0, np.int64)
    name = _runs(words, size, _BASES[2])[phrases]
    order = np.argsort(name, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    kind = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    kind, before = np.divmod(np.unique(kind * (int(offsets.max()) + 1) + offsets[order]), int(offsets.max()) + 1)  # the distinct offsets of each phrase
    at = np.searchsorted(kind, np.arange(len(first) + 1))
    place, step, proposed = phrases[order][first], max(1, PHRASES // size), []
    for i in range(0, len(place), step):
        here = place[i : i + step]
        # words are numbered among those of these phrases; all others are one letter
        used = np.unique(words[here[:, None] + np.arange(size)])
        line, a = _letters(numbered(words, used)), ahocorasick.Automaton()
        for k, p in enumerate(here.tolist()):
            a.add_word(line[p : p + size], k)
        a.make_automaton()
        ends, kinds = np.array(list(a.iter(line)), np.int64).reshape(-1, 2).T
        n = at[i + kinds + 1] - at[i + kinds]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        proposed.append(np.unique(np.repeat(ends - size + 1, n) - before[np.repeat(at[i + kinds], n) + nth]))
    found = np.unique(np.concatenate(proposed)) if proposed else np.zeros(0, np.int64)
    return found[found >= 0]


def _letters(numbers: np.ndarray) -> str:
    """A character for each number, passing over the surrogates."""
    v = numbers + 1
    return (v + (v >= 0xD800) * 0x800).astype("<u4").tobytes().decode("utf-32-le")


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_text: int = BLOCK_TEXT) -> DataFrame:
    """doc_id, n_words, n_removed, removed (runs of word places) and kept (the other words, one space between) of
    every row of docs."""
    id_type = docs.schema[doc_id].dataType.simpleString()
    if id_type not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"documents are put in order by an integer, not by {id_type}")
    blocks, total = block_count(docs, text, block_text)
    bits = max(6, math.ceil(math.log2(max(1, total * 0.2 / SHARD_BYTES))))
    rows = in_blocks(docs.select(column(doc_id).alias("_id"), F.coalesce(column(text), F.lit("")).alias("_text")), "_id", "_text", blocks)
    by_block = lambda: rows.select("block", "_id", "_text").groupBy("block")

    def name(table):
        b = Block(table, window)
        return _deal(table["block"][0].as_py(), np.unique(b.names()), bits, 0)

    names = by_block().applyInArrow(name, SHARES).groupBy("shard").applyInArrow(_shared_names, SHARES)

    def candidates(b: Block, marks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Windows with a name that another block has: sorted distinct first hashes, and the second ones."""
        n = b.names()
        keys = np.unique(n)
        shared = _bits(marks, 0, bits, keys)[np.searchsorted(keys, n)]
        w, v = b.windows()
        keys, at = np.unique(w[shared], return_index=True)
        return keys, v[shared][at]

    def confirm(table, marks):
        if not table.num_rows:
            return _deal(0, np.zeros(0, np.uint64), bits, 1)
        b = Block(table, window)
        keys, more = candidates(b, marks)
        return _deal(table["block"][0].as_py(), keys, bits, 1, more)

    earlier = by_block().cogroup(names.groupBy("block")).applyInArrow(confirm, SHARES).groupBy("shard").applyInArrow(_earlier_windows, SHARES)

    def remove(table, marks):
        b = Block(table, window)
        found = np.zeros(len(b.h), bool)
        if len(b.at):
            keys, more = candidates(b, marks)
            known = _bits(marks, 1, bits, keys)
            w, v = b.windows()
            each, first, count = np.unique(w, return_index=True, return_counts=True)
            at = np.minimum(np.searchsorted(keys, each), max(0, len(keys) - 1))
            before = (keys[at] == each) & known[at] if len(keys) else np.zeros(len(each), bool)
            again = before | (count > 1)  # distinct windows that occur elsewhere, each with one place
            if again.any():
                each, place, before, second = each[again], b.at[first[again]], before[again], v[first[again]]
                named = _runs(b.h, NAME, _BASES[2])
                anchor = anchors(named, place, window - NAME + 1)
                start = locate(b.h, anchor, anchor - place)
                start = start[start <= b.at[-1]]
                nth = np.searchsorted(b.at, start)
                start, nth = start[b.at[nth] == start], nth[b.at[nth] == start]  # within one document
                of = np.minimum(np.searchsorted(each, w[nth]), len(each) - 1)
                same = (each[of] == w[nth]) & (second[of] == v[nth])
                start, of = start[same], of[same]
                gone = before[of].copy()
                _, one, which = np.unique(of, return_index=True, return_inverse=True)
                gone |= one[which] != np.arange(len(of))  # all occurrences in the block but the first
                cover = np.zeros(len(b.h) + 1, np.int64)
                cover[start[gone]] += 1
                np.add.at(cover, start[gone] + window, -1)
                found = np.cumsum(cover[:-1]) > 0
        kept, runs, gone = [], [], []
        for d, t in enumerate(b.texts.cast(pa.large_binary()).to_pylist()):
            out = found[b.first[d] : b.first[d + 1]]
            gone.append(int(out.sum()))
            kept.append(b" ".join(compress(t.split(), (~out).tolist()) if gone[-1] else t.split()))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], out.view(np.int8), [0])))) if gone[-1] else ()
            runs.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        run = pa.struct([("first", pa.int32()), ("last", pa.int32())])
        return pa.table({"doc_id": b.ids, "n_words": pa.array(b.n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(runs, pa.list_(run)), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    marks = names.unionByName(earlier)
    return by_block().cogroup(marks.groupBy("block")).applyInArrow(remove, f"doc_id {id_type}, n_words long, n_removed long, removed array<struct<first:int,last:int>>, kept string")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op1_passages": """
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) w from documents),
     p as (select doc_id, w, unnest(range(1, greatest(len(w) - 19, 0) + 1)) a from d),
     s as (select doc_id, a, md5(array_to_string(w[a:a + 19], ' ')) k from p),
     r as (select doc_id, a, row_number() over (partition by k order by doc_id, a) nth from s),
     x as (select distinct doc_id, unnest(range(a, a + 20)) i from r where nth > 1),
     g as (select doc_id, list(i) gone, count(*) n from x group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed,
       sha256(coalesce(array_to_string([w[i] for i in range(1, len(w) + 1) if n is null or not list_contains(gone, i)], ' '), '')) kept_sha256
from d left join g using (doc_id)""",
}
QUERIES = {"op1_passages": op1_passages}

"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items; every text is scanned once, and hits are
given at their offsets in the original text.

Normalised text: A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` (letters, digits and all that isn't ASCII). A window is `n`
consecutive words of an item; an item of fewer words, but not none, is one window.

The automaton reads one character a word: a word's number among those of the phrases, and one character for all other words. Every window is known by
its phrase, the PHRASE words of its smallest hash (a shorter window is its own phrase), and the distinct phrases of all items are its patterns, about
one for five windows. An occurrence proposes the windows around it that have this phrase at this place; 128-bit hashes of the windows' words say which of
them are there. So one automaton takes some 15 bytes of memory a byte of item text and stands for all windows; texts are scanned once, whatever
the benchmark's size. Items go to the executors in a broadcast; more than `most` bytes of them are an error.

Cases: null texts have no words; empty or null items have no window; an item_id that is null is reported as an
empty string; repeated item_ids are one item; rows of documents that are repeated are reported each; a very long text is scanned whole, as one line; hits
that overlap or touch are one span, and items are listed in order of their bytes; extra columns
of either table are ignored, or kept by remove_contaminated(); empty tables give empty results or documents without hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import LOWER, as_strings, column, numbered, raw, read, renamed, slices, spans, table_of, trimmed, word_hashes
from shoreline.llm.passages import _BASES, _letters, _runs, anchors
from shoreline.llm.passages import numbered as numbered_words

WINDOW, PHRASE = 10, 3
#: Bytes of item text that may be sent to every executor.
MOST_ITEM_BYTES = 256 << 20
TABLE = table_of(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))

SPAN = pa.struct([(c, pa.int32()) for c in ("start", "end", "first_word", "last_word")])
HITS = "doc_id {}, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:int,end:int,first_word:int,last_word:int>>"


class Words:
    """The normalised words of a slice of texts: bytes, starts and ends, hashes, and the first word of each text."""

    def __init__(self, col: pa.Array):
        self.data, self.off = raw(col)
        low = LOWER[self.data]
        self.starts, self.ends, self.first = spans(low, self.off, TABLE)
        self.h = word_hashes(low, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(col)), np.diff(self.first))


class Items:
    """All windows of the items, their phrases in one automaton, and what finds them."""

    def __init__(self, items: list[tuple[str, str]], n: int = WINDOW):
        import ahocorasick

        self.ids = sorted({k for k, _ in items}, key=lambda k: k.encode())
        number = {k: j for j, k in enumerate(self.ids)}
        of = np.array([number[k] for k, _ in items], np.int64)
        w = Words(pa.array([t for _, t in items], pa.large_string()))
        count = np.diff(w.first)
        size = np.minimum(count, n)
        self.windows, phrases = {}, []  # by size: sorted first hashes, second hashes, and the items of each
        for m in np.unique(size[size > 0]).tolist():
            item = np.flatnonzero(size == m)
            each = count[item] - m + 1
            start = np.repeat(w.first[item], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            a, b = (_runs(w.h, m, base)[start] for base in _BASES[:2])
            order = np.lexsort((np.repeat(of[item], each), b, a))
            a, b, who, start = a[order], b[order], np.repeat(of[item], each)[order], start[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            at = np.flatnonzero(new)
            self.windows[m] = a[at], b[at], np.append(at, len(a)), who
            k = min(PHRASE, m)
            place = anchors(_runs(w.h, k, _BASES[2]), start[at], m - k + 1)
            phrases += [(k, m, x, x - y) for x, y in zip(place.tolist(), start[at].tolist(), strict=True)]
        self.used = np.unique(np.concatenate([w.h[x : x + k] for k, _, x, _ in phrases])) if phrases else np.zeros(0, np.uint64)
        self.find = None
        if phrases:
            line, kinds = self._line(w), {}
            place = np.arange(len(w.h)) + w.doc
            for k, m, x, o in phrases:
                kinds.setdefault(line[place[x] : place[x] + k], set()).add((m, o))
            most = max(map(len, kinds.values()))
            self.length = np.array([len(p) for p in kinds])
            self.known = np.array([[*sorted(v), *[(0, 0)] * (most - len(v))] for v in kinds.values()], np.int64)
            a = ahocorasick.Automaton()
            for j, p in enumerate(kinds):
                a.add_word(p, j)
            a.make_automaton()
            self.find = a.iter

    def _line(self, w: Words) -> str:
        """One character a word, and one between texts."""
        out = np.zeros(len(w.h) + len(w.first) - 1, np.int64)
        out[np.arange(len(w.h)) + w.doc] = numbered_words(w.h, self.used) + 1
        return _letters(out)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """First words and sizes of the windows found in the texts, and the items of each."""
        start, size, items = [], [], []
        if self.find is None or not len(w.h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), items
        found = np.array(list(self.find(self._line(w))), np.int64).reshape(-1, 2)
        if not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), items
        hashes = {}
        word = np.searchsorted(np.arange(len(w.h)) + w.doc, found[:, 0] - self.length[found[:, 1]] + 1)
        for c in range(self.known.shape[1]):
            m, o = self.known[found[:, 1], c].T
            for x in np.unique(m[m > 0]).tolist():
                a, b, at, who = self.windows[x]
                s = np.unique((word - o)[m == x])
                s = s[(s >= 0) & (s + x <= len(w.h))]
                s = s[w.doc[s] == w.doc[s + x - 1]]
                if x not in hashes:
                    hashes[x] = [_runs(w.h, x, base) for base in _BASES[:2]]
                first, second = (h[s] for h in hashes[x])
                lo, hi = np.searchsorted(a, first, "left"), np.searchsorted(a, first, "right")
                for shift in range(int((hi - lo).max(initial=0))):  # nearly always one
                    j = lo + shift
                    ok = (j < hi) & (b[np.minimum(j, len(b) - 1)] == second)
                    start.append(s[ok])
                    size.append(np.full(ok.sum(), x))
                    items += [who[at[i] : at[i + 1]] for i in j[ok].tolist()]
        return np.concatenate(start) if start else np.zeros(0, np.int64), np.concatenate(size) if size else np.zeros(0, np.int64), items


def cover(w: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words any of the windows covers."""
    c = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(c, start, 1)
    np.add.at(c, start + size, -1)
    return np.cumsum(c[:-1]) > 0


def items_of(benchmark: DataFrame, item_id: str, text: str, most: int = MOST_ITEM_BYTES) -> list[tuple[str, str]]:
    """All items with a text, whose size is checked first."""
    rows = benchmark.select(F.coalesce(column(item_id).cast("string"), F.lit("")).alias("k"), column(text).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    if size > most:
        raise ValueError(f"the items have {size} bytes of text; one automaton may have {most}")
    return [(r.k, r.t) for r in rows.toLocalIterator()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted strings) and spans (character offsets and word places of each
    maximal run of hit words) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(items_of(benchmark, item_id, item_text, most))

    def run(batches):
        known = Items(shared.value, n)
        for b in trimmed(batches):
            col = as_strings(b.column(1))
            for i, k in slices(col):
                w = Words(col.slice(i, k))
                start, size, items = known.hits(w)
                hit = cover(w, start, size)
                ids, places = [[] for _ in range(k)], [[] for _ in range(k)]
                for d, who in zip(w.doc[start].tolist(), items, strict=True):
                    ids[d].append(who)
                for d in np.unique(w.doc[start]).tolist():
                    ids[d] = [known.ids[j] for j in np.unique(np.concatenate(ids[d])).tolist()]
                    a, z, base = w.first[d], w.first[d + 1], w.off[d]
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:z].view(np.int8), [0])))).reshape(-1, 2)
                    char = np.concatenate(([0], np.cumsum((w.data[base : w.off[d + 1]] & 0xC0) != 0x80)))
                    places[d] = [{"start": int(char[w.starts[a + x] - base]), "end": int(char[w.ends[a + y - 1] - base]), "first_word": x, "last_word": y - 1} for x, y in edge.tolist()]
                out = [b.column(0).slice(i, k), pa.array(np.diff(w.first), pa.int64()), pa.array(np.bincount(w.doc[hit], minlength=k), pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(places, pa.list_(SPAN))]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_hit", "item_ids", "spans"])

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, HITS.format(docs.schema[doc_id].dataType.simpleString()))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = MOST_ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item; one pass over the texts."""
    shared, at = docs.sparkSession.sparkContext.broadcast(items_of(benchmark, item_id, item_text, most)), docs.columns.index(text)

    def run(batches):
        known = Items(shared.value, n)
        for b in trimmed(batches):
            col, clean = as_strings(b.column(at)), np.ones(b.num_rows, bool)
            for i, k in slices(col):
                w = Words(col.slice(i, k))
                clean[i + w.doc[known.hits(w)[0]]] = False
            yield b.filter(pa.array(clean))

    rows = docs.select(*numbered(docs.columns))
    return rows.mapInArrow(run, rows.schema).select(*renamed(docs.columns))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_W = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = {
    "op7_decontaminate": f"""
with d as (select doc_id, coalesce({_W.format("text")}, []) w from documents),
     i as (select cast(item_id as varchar) k, {_W.format("text")} w from benchmark where text is not null),
     p as (select k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) a, w from i where len(w) > 0),
     pat as (select k, array_to_string(w[a:a + 9], ' ') s, least(len(w), 10) n from p),
     sizes as (select distinct n from pat),
     dp as (select doc_id, n, unnest(range(1, len(w) - n + 2)) a, w from d, sizes where len(w) >= n),
     dw as (select doc_id, n, a, array_to_string(w[a:a + n - 1], ' ') s from dp),
     hit as (select doc_id, a, n, k from dw join pat using (n, s)),
     words as (select doc_id, count(distinct x) n_hit from (select doc_id, unnest(range(a, a + n)) x from hit) group by 1),
     items as (select doc_id, count(distinct k) n_items, string_agg(distinct k, ',' order by k) ks from hit group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ks, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)""",
}
QUERIES = {"op7_decontaminate": op7_decontaminate}

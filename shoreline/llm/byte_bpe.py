"""Byte-level BPE encoding and decoding in linear time.

A text is cut by a pattern, and each piece is encoded apart. A piece that is a token is that token. In any other the longest token at
each place comes from one pass of an Aho-Corasick automaton (pyahocorasick, over bytes mapped to Latin-1 characters), and a
sequence of tokens is built from the left: the longest match that may follow the token before it is taken, else its longest prefix that
is a token, and so on; where none is left the token before is given up, and the place after it is never tried again. So each place is
entered once. Two tokens may stand side by side if no merge of a lower rank than those inside them would have joined
their inner ends: this is looked up by taking both apart along their merges, and remembered for each pair. Sequences whose neighbours
are all compatible are unique, so the result is that of the merges.

Each vocabulary is checked when it is loaded: a token of two bytes or more that its own bytes do not merge into can only be a
whole piece, and is left out of the automaton. Vocabularies must have all 256 bytes, and the parts of a token must have lower ranks.

Cases: a null text counts as empty and has no ids; decoding null ids gives null, no ids the empty string, an unknown id an error;
texts of any length are encoded whole, a piece of a million letters too; repeated rows are encoded row by row; an empty table gives
an empty result; encode() ignores other columns, decode() keeps them all, and one that is named like its result is replaced.
"""

from __future__ import annotations

import array
import base64
import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoreline.llm.base import as_strings, column, numbered, read, renamed, slices, trimmed

#: Pieces (some 200 bytes each) and pairs (250 bytes) that a worker remembers before it starts again, and bytes of the longest remembered piece.
PIECES, PAIRS, LONGEST = 1 << 19, 1 << 18, 64
#: Text and ids that become a batch of results at once.
SLICE_TEXT, SLICE_IDS = 2 << 20, 1 << 19

#: Letters and numbers of Unicode 17, which the module regex knows and the library does not.
NEW_LETTERS = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2
1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF
2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""
NEW_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


class Splitter:
    """The pieces of a text under a pattern, with the letters and numbers that the library knows. Texts within Latin-1, where their classes are
    short, are split by Python's own expressions, which are faster."""

    def __init__(self, pattern: str):
        import regex

        def chars(ranges: str) -> str:
            return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())

        def of(letters: str, numbers: str, neither: str) -> str:
            return pattern.replace(r"[^\s\p{L}\p{N}]", neither).replace(r"\p{L}", letters).replace(r"\p{N}", numbers)

        def latin(kind: str) -> str:
            return "".join(c for c in map(chr, range(256)) if regex.match(kind, c))

        letters, numbers, spaces = latin(r"\p{L}"), latin(r"\p{N}"), latin(r"\s")
        self.near = re.compile(of(f"[{letters}]", f"[{numbers}]", f"[^{spaces}{letters}{numbers}]").replace(r"\S", f"[^{spaces}]").replace(r"\s", f"[{spaces}]")).findall
        letters, numbers = chars(NEW_LETTERS), chars(NEW_NUMBERS)
        self.far = regex.compile(pattern).findall
        self.new = regex.compile(f"[{letters}{numbers}]").search
        self.exact = regex.compile(of(rf"[\p{{L}}--[{letters}]]", rf"[\p{{N}}--[{numbers}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{letters}{numbers}]]"), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.exact(text) if self.new(text) else self.far(text)
        return self.near(text)


class Vocabulary:
    """Tokens by rank, the merge that each comes from, and what may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks = ranks
        self.size = {i: len(t) for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # a single byte's parts are itself
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}  # the longest proper prefix that is a token
        self.fits: dict[tuple[int, int], bool] = {}
        for token, i in sorted(ranks.items(), key=lambda kv: (len(kv[0]) > 1, kv[1])):
            if len(token) == 1:
                self.parts[i] = (i, i)
                continue
            for cut in range(len(token) - 1, 0, -1):
                a, b = ranks.get(token[:cut], -1), ranks.get(token[cut:], -1)
                if a in self.parts and b in self.parts and self._ordered(a, b, i) and self.compatible(a, b):
                    self.parts[i], self.joined[a, b] = (a, b), i
                    break
        self.fits.clear()  # pairs that were compatible until a later token joined them
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            if i in self.parts:
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
                self.shorter[i] = next((p for k in range(len(token) - 1, 0, -1) if (p := ranks.get(token[:k], -1)) in self.parts), -1)
        self.automaton.make_automaton()

    def _ordered(self, a: int, b: int, i: int) -> bool:
        return all(self.size[x] == 1 or x < i for x in (a, b))

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b side by side: going back through the merges of both, the later one first, no pair at the
        border is joined by a merge that comes before the one taken back."""
        key, limit = (a, b), 1 << 62
        found = self.fits.get(key)
        if found is not None:
            return found
        while True:
            if self.joined.get((a, b), limit) < limit:
                found = False
                break
            inner_a, inner_b = self.parts[a][1], self.parts[b][0]
            if inner_a != a and (inner_b == b or a > b):
                limit, a = a, inner_a  # b's place is after a's: of equal ranks a's merge comes first
            elif inner_b != b:
                limit, b = b + 1, inner_b
            else:
                found = True
                break
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[key] = found
        return found

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [] if whole is None else [whole]
        text, known = data.decode("latin-1"), self.fits.get
        out = [i for _, (i, _) in self.automaton.iter_long(text)]
        for pair in zip(out, out[1:], strict=False):
            if not (known(pair) or self.compatible(*pair)):
                return self._backtracked(text)
        return out  # the longest matches one after the other fit already

    def _backtracked(self, text: str) -> list[int]:
        n, size, shorter, known = len(text), self.size, self.shorter, self.fits.get
        longest = [0] * n
        for end, (i, k) in self.automaton.iter(text):
            longest[end - k + 1] = i  # ends rise, so the last is the longest
        untried = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        last, at, token = None, 0, longest[0]
        while True:
            end = at + size[token]
            if untried[end]:
                fit = last is None or known((last, token))
                if fit is None:
                    fit = self.compatible(last, token)
                if fit:
                    out.append(token)
                    if end == n:
                        return out
                    last, at, token = token, end, longest[end]
                    continue
            token = shorter[token]
            if token < 0:
                untried[at] = 0
                token = out.pop()
                last = out[-1] if out else None
                at -= size[token]


class Pieces(dict):
    """The ids of pieces, as the bytes of 32-bit integers; those of short pieces are kept."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        found = array.array("i", self.vocab.encode_piece(data)).tobytes()
        if len(data) <= LONGEST:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = found
        return found


def ranks_of(path: str) -> dict[bytes, int]:
    """A file of lines with a token in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(i) for t, i in (line.split() for line in f if line.strip())}


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    """One for each Python worker."""
    return Pieces(Vocabulary(ranks_of(path)))


@functools.lru_cache(2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


@functools.lru_cache(2)
def spellings(path: str) -> pa.Array:
    """The bytes of each id; null where there is none."""
    ranks = ranks_of(path)
    out = [None] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return pa.array(out, pa.large_binary())


def encode(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids, the text's tokens, of each row of docs."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        known, split = pieces(ranks), splitter(pattern)
        for b in trimmed(batches):
            col = as_strings(b.column(1))
            for i, k in slices(col, SLICE_TEXT):
                each = [b"".join(map(known.__getitem__, split(t))) for t in col.slice(i, k).to_pylist()]
                at = pa.array(itertools.accumulate((len(x) // 4 for x in each), initial=0), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), pa.ListArray.from_arrays(at, np.frombuffer(b"".join(each), np.int32))], names=["doc_id", "ids"])

    return docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def runs(col: pa.ListArray, limit: int = SLICE_IDS):
    """(first row, length) of runs of about `limit` ids, never splitting a row."""
    at = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(col):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + limit, "right")))
        yield i, j - i
        i = j


def joined(col: pa.ListArray, table: pa.Array, by: bytes) -> pa.Array:
    """The entries of the table that each row's ids name, joined."""
    used = col.flatten()
    gone = pc.fill_null(pc.or_(pc.less(used, 0), pc.greater_equal(used, len(table))), True)
    found = pc.take(table, pc.if_else(gone, None, used))
    if found.null_count:
        raise ValueError(f"an id that the vocabulary lacks: {used.filter(pc.is_null(found))[0]}")
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_pylist()
    at = pa.array(itertools.accumulate(sizes, initial=0), pa.int64())
    return pc.if_else(pc.is_valid(col), pc.binary_join(pa.LargeListArray.from_arrays(at, found), pa.scalar(by, table.type)), None)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", bytes_column: str = "bytes") -> DataFrame:
    """All columns of the table, and the bytes that the ids stand for."""
    kept = [c for c in encoded.columns if c != bytes_column]
    rows = encoded.select(*numbered(kept), column(ids).cast("array<int>").alias("_ids"))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        table = spellings(ranks)
        for b in trimmed(batches):
            col = b.column(b.num_columns - 1)
            for i, k in runs(col):
                part = b.slice(i, k)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], joined(col.slice(i, k), table, b"").cast(pa.binary())], names=[*part.schema.names[:-1], "_bytes"])

    return rows.mapInArrow(run, f"{out}, _bytes binary").select(*renamed(kept), F.col("_bytes").alias(bytes_column))


def digests(encoded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes that decode() gives) of a table of doc_id and ids,
    which are decoded on the way: no second pass and no bytes leave the task."""

    def run(batches):
        import hashlib

        sha = lambda values: pa.array([hashlib.sha256(v or b"").hexdigest() for v in values.to_pylist()], pa.string())
        table = spellings(ranks)
        numbers = pa.array(map(b"%d".__mod__, range(len(table))), pa.large_binary())
        for b in trimmed(batches):
            col = b.column(1)
            for i, k in runs(col):
                part = col.slice(i, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, k), pc.list_value_length(part).cast(pa.int64()), sha(joined(part, numbers, b",")), sha(joined(part, table, b""))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", column(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digests(encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)


QUERIES = {"op12_byte_bpe": op12_byte_bpe}
ORACLE: dict[str, str] = {}

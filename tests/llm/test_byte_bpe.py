import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from shoreline.llm.byte_bpe import Splitter, Vocabulary, decode, digests, encode, op12_byte_bpe, ranks_of
from conftest import SF

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks_of(PATH), special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return Vocabulary(ranks_of(PATH))


def merged(ranks, data):
    """The merges one by one: the lowest rank first, of equal ones the leftmost."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        best = min(((ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def trained(r, n):
    """Merges learned from random bytes, as ranks."""
    parts = [bytes([b]) for b in (r.choice(b"abc") for _ in range(3000))]
    ranks = {bytes([b]): b for b in range(256)}
    while len(ranks) < 256 + n:
        count = {}
        for a, b in zip(parts, parts[1:], strict=False):
            count[a + b] = count.get(a + b, 0) + 1
        best = max(count, key=lambda k: (count[k], k))
        ranks[best] = len(ranks)
        out, k = [], 0
        while k < len(parts):
            pair = k + 1 < len(parts) and parts[k] + parts[k + 1] == best
            out.append(best if pair else parts[k])
            k += 2 if pair else 1
        parts = out
    return ranks


def test_merges_of_small_vocabularies():
    r = random.Random(5)
    for _ in range(6):
        ranks = trained(r, r.randrange(1, 120))
        v = Vocabulary(ranks)
        for _ in range(300):
            data = bytes(r.choice(b"abcd") for _ in range(r.randrange(60)))
            assert v.encode_piece(data) == ([ranks[data]] if data in ranks else merged(ranks, data))


def test_a_token_that_no_merge_gives():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"xyz": 257, b"abc": 258}
    v = Vocabulary(ranks)
    assert v.encode_piece(b"xyz") == [257]  # a whole piece
    assert v.encode_piece(b"xyzabc") == merged(ranks, b"xyzabc") == [120, 121, 122, 258]
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0})


def test_pieces_of_the_public_vocabulary(ours, theirs):
    r = random.Random(6)
    tokens = list(ours.ranks)
    for token, rank in r.sample(sorted(ours.ranks.items()), 4000):
        assert merged(ours.ranks, token) == [rank]
    for _ in range(3000):
        data = b"".join(r.choice(tokens) for _ in range(r.randrange(1, 9)))
        if data not in ours.ranks:
            assert ours.encode_piece(data) == merged(ours.ranks, data)
    for text in ("a" * 1000, "ab" * 777, "\n" * 501, "thethethe" * 300, "é" * 3000, "\U0001f600" * 500, "".join(r.choice("abcde") for _ in range(20000))):
        assert ours.encode_piece(text.encode()) == theirs._encode_single_piece(text)


def test_letters_and_numbers_of_the_library():
    """Of all characters but private ones and tags: whether it goes on with a letter, a number, a sign or a space."""
    split = Splitter(P.PATTERN)
    chars = [chr(c) for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    for first in "a1!\t":
        ranks = {bytes([b]): b for b in range(256)}
        for c in chars:
            ranks.setdefault((first + c).encode(), len(ranks))
        library = tiktoken.Encoding("pairs", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in chars if len(library.encode_ordinary(first + c)) == 1] == [c for c in chars if len(split(first + c)) == 1]


def texts():
    r = random.Random(7)
    odd = ["", None, "  two  spaces \n\n tail  ", "don't we'll I'VE 's'", "ünïcödé 日本語のテキスト 😀😀", "\x1c\x1d \x85 \xa0", "²³ ½ ٣٤ Ⅷ", "՘֋ 1\U00012550", "<|endoftext|>", "\r\n\t\v\f", "a" * 300_000]
    return odd + ["".join(r.choice("ab 1'\néß-€　\t") for _ in range(r.randrange(200))) for _ in range(300)]


def test_whole_texts(spark, theirs):
    docs = [(n, t, "x") for n, t in enumerate(texts())] + [(None, "null id", "x"), (7, "twice", "x"), (7, "twice", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, ids string").repartition(3)
    out = decode(encode(df, PATH, P.PATTERN), PATH).collect()
    assert sorted((x.doc_id or -1, x.ids, bytes(x.bytes)) for x in out) == sorted((d or -1, theirs.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in docs)


def test_digests(spark, theirs):
    docs = [(n, t) for n, t in enumerate(texts()[:20])]
    out = digests(encode(spark.createDataFrame(docs, "doc_id long, text string"), PATH, P.PATTERN), PATH).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {d: theirs.encode_ordinary(t or "") for d, t in docs}
    assert {tuple(x) for x in out} == {(d, len(ids[d]), sha(",".join(map(str, ids[d])).encode()), sha((t or "").encode())) for d, t in docs}


def test_query(spark, theirs):
    got = {x.doc_id: tuple(x)[1:] for x in op12_byte_bpe(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d, t in docs:
        ids = theirs.encode_ordinary(t)
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_decode_keeps_columns_and_refuses_unknown_ids(spark):
    df = spark.createDataFrame([(1, [72, 105], "a"), (2, None, "b"), (3, [], "c")], "key long, ids array<int>, `a.b` string")
    out = decode(df, PATH)
    assert out.columns == ["key", "ids", "a.b", "bytes"]
    by = {x.key: x for x in out.collect()}
    assert by[2].bytes is None and bytes(by[3].bytes) == b"" and by[1]["a.b"] == "a"
    with pytest.raises(Exception, match="vocabulary lacks"):
        decode(spark.createDataFrame([([50256],)], "ids array<int>"), PATH).collect()


def test_empty_and_odd_columns(spark):
    df = spark.createDataFrame([], "doc_id string, text string, `a.b` int")
    assert encode(df, PATH, P.PATTERN).columns == ["doc_id", "ids"] and encode(df, PATH, P.PATTERN).count() == 0
    named = spark.createDataFrame([("k", "some text", 1)], "doc_id string, text string, `a.b` int")
    assert encode(named, PATH, P.PATTERN).first().doc_id == "k"

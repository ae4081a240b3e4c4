import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shoreline.llm.token_store import Segment, WordEncoder, pack, read_documents, read_token, write_store

PATH = public_tokenizers.path("word_bpe_49k.json")
T = Tokenizer.from_file(PATH)
ENC = WordEncoder(PATH, most=40)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0　'sStTdDlLREVEm09²ªΣσςİßÉé<|endoftext|>.,!#é語"), st.characters(exclude_categories=["Cs"])), max_size=40), st.sampled_from(["", "<|endoftext|>", "<|startoftext|>x", "it's I'LL ΣΑΣ. don't"]))
def test_words_are_independent(a, b):
    t = a + b + a
    assert ENC.by_word and np.frombuffer(ENC.encode([t])[0], "<u4").tolist() == T.encode(t, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=3000))
def test_round_trip(ids):
    seg = Segment(pack([None, 5], np.array(ids, np.uint32), np.array([0, len(ids) // 2, len(ids)])))
    assert seg.ids().tolist() == ids and seg.doc_ids == [None, 5]
    for i in [*range(0, len(ids), 97), len(ids) - 1]:
        if i >= 0:
            assert seg[i] == ids[i]


def test_damage_is_found():
    data = bytearray(pack([1], np.arange(1000, dtype=np.uint32), np.array([0, 1000])))
    data[-5] ^= 1
    with pytest.raises(ValueError):
        Segment(bytes(data))


def test_store(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["Hello", "wörld", "it's", "12", "語", "xyzzy."]) for _ in range(r.randrange(80))), "x") for i in range(200)]
    rows += [(None, "first", "x"), (77, None, "x"), (5, "", "x"), (300, "long " * 40000, "x"), (-4, "neg", "x"), (9, rows[9][1], "x")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(5)
    path = f"file://{tmp_path}/store"
    write_store(df, path, PATH)
    want, at, every = [], 0, []
    for i, t, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = [*T.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
        every += ids
    got = sorted(map(tuple, read_documents(spark, path, ids=True).collect()), key=lambda x: x[1])
    assert got == want
    for i in (0, 1, at // 2, at - 1):
        assert read_token(spark, path, i) == every[i]
    with pytest.raises(IndexError):
        read_token(spark, path, at)


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert read_documents(spark, path).count() == 0

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from shoreline.llm import token_counts
from shoreline.llm.token_counts import PieceCounter, count_tokens, pretokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = PieceCounter(MODEL)
DIRECT = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_separable():
    assert COUNTER.separable


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n▁\t<s>/aé語  the"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_same_as_whole_texts(texts):
    data, start, end, doc = pretokens(pa.array(texts, pa.large_string()))
    pieces = COUNTER.pieces([bytes(data[a:z]).decode() for a, z in zip(start, end, strict=True)])
    assert np.bincount(doc, pieces, len(texts)).tolist() == [len(DIRECT.encode(t)) for t in texts]


def test_rows(spark):
    rows = [(1, "a b  c\n\n d </s> <unk>", 9), (1, "a b  c\n\n d </s> <unk>", 9), (2, None, 1), (None, "", 1), (3, "word " * 30000, 5)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), MODEL).collect()
    want = [(i, len((t or "").encode()), len(DIRECT.encode(t or "")), len(DIRECT.encode(t or "")) > 4096) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0


def test_many_slices_and_a_long_text(spark, monkeypatch):
    """Each distinct pre-token is counted once; slices, shards and a text without blanks give what whole texts give."""
    monkeypatch.setattr(token_counts, "SHARD_TOKENS", 1)
    rows = [(k, f"word{k % 7} same same\n x{k} " * (k % 9)) for k in range(300)] + [(1000, "y" * 200_000), (1001, "é " * 50_000)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), MODEL)
    assert {x.doc_id: x.n_tokens for x in got.collect()} == {i: len(DIRECT.encode(t)) for i, t in rows}


@pytest.mark.parametrize("separable", [True, False])
def test_models_that_are_not_separable(spark, monkeypatch, separable):
    monkeypatch.setattr(PieceCounter, "_plain", lambda self: separable)
    df = spark.createDataFrame([(1, "a b  c"), (2, None), (3, "x\n\ny")], "doc_id long, text string")
    assert {x.doc_id: x.n_tokens for x in count_tokens(df, MODEL).collect()} == {1: len(DIRECT.encode("a b  c")), 2: 0, 3: len(DIRECT.encode("x\n\ny"))}

import pytest

from shoreline.llm.near_dedup import keep_one, near_duplicates


@pytest.mark.parametrize("f", [near_duplicates, keep_one])
def test_threshold(spark, f):
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x")], "doc_id long, text string")
    for t in (0.6, 0.79, 1.1):
        with pytest.raises(ValueError):
            f(df, threshold=t)
    assert f(df, threshold=0.9).count() == (3 if f is near_duplicates else 2)

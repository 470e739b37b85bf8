"""Chunks of a very long text."""

from tessera.operators import textops


def test_chunks_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "ab" * 250_000)], "doc_id long, text string")
    got = [r.lo + len(r.body) for r in textops.chunks(df, "doc_id", "text", 1000, 200).collect()]
    assert len(got) == 625 and max(got) == 500_000
    assert textops.chunks(df, "doc_id", "text", 1000, 200, 600).count() == 600

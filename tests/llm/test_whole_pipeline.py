"""The near-duplicate stage keeps one row of each group of texts, whatever the ids."""

import random

import corpus_pipeline


def test_repeated_and_null_ids(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    a, b, c, d, e, f = (" ".join(word() for _ in range(80)) for _ in range(6))
    rows = [(1, a), (7, a), (7, b), (7, c), (7, c), (None, d), (None, d), (None, a), (None, e), (9, e), (3, f), (None, None), (8, ""), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_duplicate_stage(spark, df.repartition(3), "")
    assert out.schema == df.schema
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=str) == sorted([(1, a), (7, b), (7, c), (None, d), (9, e), (3, f), (8, "")], key=str)


def test_stage_broadcasts_nothing(spark, small):
    """What the stage keeps and links grows with the table, so none of it may be built in the driver."""
    out = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{small}/documents.parquet"), small)
    assert 0 < len(out.collect()) < 200
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()

"""The language model on odd tables."""

from pyspark.sql import functions as F

from arborflow.llm.maxent_lm import maxent_scores

DDL = "doc_id long, text string, train string, batch string, bucket string, share string, h string, word string"


def test_empty_table_and_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], DDL)
    assert maxent_scores(none, F.col("doc_id") < 10).collect() == []
    some = spark.createDataFrame([(1, "a b", *"xxxxxx"), (2, None, *"xxxxxx"), (None, "", *"xxxxxx")], DDL)
    got = {r.doc_id: r for r in maxent_scores(some, F.lit(False)).collect()}
    assert {d: r.n_tokens for d, r in got.items()} == {1: 3, 2: 1, None: 1}
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score <= 0 and not r.train for r in got.values())


def test_clashing_names_and_a_very_long_text(spark):
    rows = [(i, f"word{i % 7} and word{i % 5}", *"abcdef") for i in range(300)] + [(1000, "word1 and " * 200_000, *"abcdef")]
    df = spark.createDataFrame(rows, DDL)
    got = {r.doc_id: r for r in maxent_scores(df, F.col("doc_id") < 900).collect()}
    assert len(got) == 301 and got[1000].n_tokens == 400_001 and got[1000].n_known == 400_001
    assert all(r.score < 0 and r.base_score < 0 for r in got.values())

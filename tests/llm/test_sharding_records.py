"""Shards hold whole records, in the order of slots, whatever the records are."""

from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from arborflow.llm import sharding as S


def stored(folder, n):
    """The rows of each shard, from its files in order of their names."""
    out = []
    for k in range(n):
        rows = []
        for f in sorted(folder.glob(f"shard={k}/*.parquet")):
            rows += pq.ParquetFile(f).read().to_pylist()
        out.append(rows)
    return out


@pytest.mark.parametrize("bucket_rows,task_buckets", [(7, 2), (4096, 8)])
def test_records_come_back(spark, tmp_path, monkeypatch, bucket_rows, task_buckets):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(S, "TASK_BUCKETS", task_buckets)
    rows = [(i, f"text {i} é\n" * (i % 5), None if i % 7 == 0 else "en", "src", i) for i in range(400)]
    rows += [(9000, "same", "x", "y", 1)] * 150 + [(9001, "twice", "x", "y", 1)] * 2 + [(None, None, None, None, None)] * 3 + [(9002, "long " * 400_000, "en", "z", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    plan = S.shard_plan(df, 5, path=f"file://{tmp_path}/s").collect()
    shards = stored(tmp_path / "s", 5)
    names = df.columns
    assert Counter(tuple(r[c] for c in names) for s in shards for r in s) == Counter(rows)
    assert [[r["slot"] for r in s] for s in shards] == [list(range(len(s))) for s in shards]
    sizes = [len(s) for s in shards]
    assert max(sizes) - min(sizes) <= 1
    where = {(r["doc_id"], k, r["slot"]) for k, s in enumerate(shards) for r in s}
    assert {(r.doc_id, r.shard, r.slot) for r in plan} == where
    # copies lie in all shards, and an order is a permutation that a seed decides
    assert len({k for k, s in enumerate(shards) for r in s if r["text"] == "same"}) == 5
    other = S.shard_plan(df.repartition(3, "lang"), 5).collect()
    assert Counter(map(tuple, other)) == Counter(map(tuple, plan))
    reseeded = S.shard_plan(df, 5, seed=77).collect()
    assert Counter(map(tuple, reseeded)) != Counter(map(tuple, plan))


def test_fewer_rows_than_shards(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = S.shard_plan(df, 24).collect()
    assert sorted(r.shard for r in got) == [0, 1, 2] and all(r.slot == 0 for r in got)
    assert sorted((r.doc_id, r.size) for r in got) == [(1, 9), (2, 9), (3, 8)]


def test_uniform(spark):
    """Where a record lands says nothing about where it was."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    means = S.shard_plan(df, 10).groupBy("shard").agg(F.avg("doc_id").alias("m"), F.corr("doc_id", "slot").alias("c")).collect()
    assert all(9000 < r.m < 11_000 and abs(r.c) < 0.1 for r in means)

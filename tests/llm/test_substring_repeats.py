"""Repeats are maximal, and a passage that many documents share costs its first document's batch little."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from arborflow.llm import substring_dedup as D


def words(r, n, tag):
    return [f"{tag}{r.randrange(10**9)}" for _ in range(n)]


def test_a_repeat_with_an_earlier_part_is_one(spark):
    """Documents 1 and 2 equal in 300 words, of which 30 stand in document 0 as well."""
    r = random.Random(1)
    base = words(r, 300, "w")
    rows = [(0, " ".join(words(r, 20, "a") + base[140:170] + words(r, 20, "b"))), (1, " ".join(base)), (2, " ".join(base))]
    rows += [(3, " ".join(words(r, 7, "c") + base[:250] + words(r, 9, "d")))]
    got = {x.doc_id: x for x in D.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    repeats = lambda d: [(x.start, x.first_doc, x.first_start, x.length) for x in got[d].repeats]
    assert (0, 1, 0, 300) in repeats(2) and sum(x[1] == 1 for x in repeats(2)) == 1
    assert (140, 0, 20, 30) in repeats(2) and (140, 0, 20, 30) in repeats(1)
    assert (7, 1, 0, 250) in repeats(3) and got[3].n_removed == 250 and got[2].n_removed == 300 and got[1].n_removed == 30


def test_joined():
    x = lambda s, d, f, n: {"start": s, "first_doc": d, "first_start": f, "length": n}
    assert D.joined([x(94, 1, 94, 206), x(0, 1, 0, 216), x(10, 2, 0, 20), x(30, 2, 20, 15), x(60, 2, 50, 15), x(5, 1, 6, 20)]) == [x(0, 1, 0, 300), x(5, 1, 6, 20), x(10, 2, 0, 35), x(60, 2, 50, 15)]


def test_a_hot_passage_costs_its_batch_little():
    """20,000 documents with one passage ask the batch of the first one in a row without their names."""
    passage = " ".join(f"p{i}" for i in range(40)).encode()
    docs = pa.table({"doc_id": pa.array(range(1, 20_001), pa.int64()), "text": [passage.decode()] * 20_000, "batch": pa.array([7] * 20_000, pa.int32())})
    h, _ = D.C.windows(D.C.Texts(docs.column("text").slice(0, 1)).words()[0], 13), None
    firsts = pa.table({"batch": pa.array([7], pa.int32()), "h": [h.tobytes()], "doc": [D.np.zeros(len(h), D.np.int64).tobytes()], "at": [D.np.arange(len(h), dtype=D.np.uint32).tobytes()], "source": [D.np.full(len(h), 3, D.np.int32).tobytes()]}, schema=D.FIRST)
    asked = D.ask(13)(docs, firsts)
    there = asked.filter(pa.compute.equal(asked.column("batch"), 3))
    assert there.num_rows == 1 and there.nbytes < 1000
    own = asked.filter(pa.compute.equal(asked.column("batch"), 7))
    assert own.num_rows == 1 and len(own.column("docs")[0].as_py()) == 160_000
    back = D.extend(13)(pa.table({"doc_id": pa.array([0], pa.int64()), "text": [passage.decode()], "batch": pa.array([3], pa.int32())}), there)
    assert back.column("batch").to_pylist() == [7] and back.column("n").to_pylist() == [40]
    notes = D.extend(13)(docs.slice(0, 1), own)
    out = D.cut(13)(docs, pa.concat_tables([back, notes]))
    assert set(out.column("n_removed").to_pylist()) == {40}


def test_one_very_long_text(spark):
    r = random.Random(3)
    long = words(r, 400_000, "l")
    rows = [(1, " ".join(long)), (2, " ".join(long[1000:301_000])), (3, " ".join(long[5:25] + ["x"] + long[200_000:200_050]))]
    got = {x.doc_id: x for x in D.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_removed", F.size("repeats").alias("n")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n, got[3].n_removed) == (0, 300_000, 1, 70)

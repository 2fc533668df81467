"""Sources, streams, scans, closures, joins and products over tables of any size: against SQL, and on small hard cases."""

import glob
import json
import os
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arborflow.functions import udtfs as U
from arborflow.operators import blocks as B
from arborflow.operators import closure as K
from arborflow.operators import layers as N
from arborflow.operators import model as M
from arborflow.operators import prefixes as E
from arborflow.operators import ranges as R
from arborflow.operators import scan as S
from arborflow.plans import tables as P
from arborflow.sources import tensors as X
from arborflow.streaming import buckets
from arborflow.streaming import reorder as Z
from arborflow.streaming import serving as Y

DATA = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in NAMES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _norm(df):
    df = df[sorted(df.columns)].map(str)
    return sorted(map(tuple, df.itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(P.ORACLE))
def test_oracle(spark, duck, name):
    assert _norm(P.QUERIES[name](spark, DATA).toPandas()) == _norm(duck.sql(P.ORACLE[name]).df())


# -- tensor files


def _some(spark, n=200):
    return spark.range(n).select(F.format_string("t.%03d", "id").alias("tensor_name"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("int")).alias("stage"), F.array(F.lit(2).cast("long"), F.lit(3).cast("long")).alias("shape"), F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: (x + F.col("id")).cast("float")).alias("data")).repartition(4)


FILTERS = ["stage = 1", "stage IS NULL", "stage IS NOT NULL AND tensor_name LIKE 't.1%'", "tensor_name IN ('t.003', 't.150', 'x')", "tensor_name > 't.1' AND tensor_name <= 't.120'", "stage <=> NULL", "stage <=> 2", "NOT stage = 1", "tensor_name = 't.007' OR stage = 2", "version > 1", "size(data) = 6 AND stage < 2", "tensor_name IS NULL"]


@pytest.mark.parametrize("where", FILTERS)
def test_filters_reach_the_files(spark, tmp_path, where):
    path = f"file://{tmp_path}/t"
    X.write_tensors(_some(spark), path, file_bytes=300)
    all_ = X.read_tensors(spark, path)
    assert all_.count() == 200
    assert rows(X.read_tensors(spark, path, where), "tensor_name") == rows(all_.where(where), "tensor_name")


def test_pushed_filters_and_pruned_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    X.write_tensors(_some(spark), path, file_bytes=300)
    df = X.read_tensors(spark, path, "stage = 1 AND tensor_name < 't.05'")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    scan = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "EqualTo(stage,1)" in scan and "LessThan(tensor_name,t.05)" in scan
    files = len(glob.glob(f"{tmp_path}/t/part-*"))
    assert df.rdd.getNumPartitions() < files / 3 and files > 20
    # two filters on one frame, each with its own rows
    assert sorted(r.stage for r in df.where("tensor_name < 't.01'").union(df.where("tensor_name >= 't.04'")).collect()) == [1] * 7


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    X.write_tensors(_some(spark, 20), path, file_bytes=50)
    before = sorted(os.listdir(f"{tmp_path}/t"))
    bad = _some(spark).withColumn("data", F.when(F.col("tensor_name") == "t.150", F.lit(None)).otherwise(F.col("data")))
    with pytest.raises(Exception, match="t.150"):
        X.write_tensors(bad, path, file_bytes=50)
    with pytest.raises(Exception, match="shape"):
        X.write_tensors(_some(spark).withColumn("shape", F.array(F.lit(7).cast("long"))), path)
    assert sorted(os.listdir(f"{tmp_path}/t")) == before and X.read_tensors(spark, path).count() == 20
    # a file that no commit lists, as a lost task leaves it
    with open(f"{tmp_path}/t/part-x-0-0-0.safetensors", "wb") as f:
        f.write(b"part of a file")
    assert X.read_tensors(spark, path).count() == 20
    with pytest.raises(Exception, match="tensor files take"):
        X.write_tensors(_some(spark).withColumnRenamed("data", "data_"), path)


def test_overwrite_versions_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    none = _some(spark, 0)
    X.write_tensors(none, path)
    assert X.read_tensors(spark, path).count() == 0 and X.read_tensors(spark, path, "stage = 1").count() == 0
    X.write_tensors(_some(spark, 10), path)
    X.write_tensors(_some(spark, 10).union(_some(spark, 3)).drop("shape", "stage"), path)  # names that repeat in a task too
    df = X.read_tensors(spark, path)
    assert rows(df.groupBy("version").count(), "version") == [(2, 10), (3, 13)]
    assert rows(X.latest(df).groupBy("version").count(), "version") == [(3, 10)]
    X.write_tensors(_some(spark, 4), path, "overwrite")
    assert [r[2] for r in rows(X.read_tensors(spark, path), "tensor_name")] == [f"t.00{i}" for i in range(4)]
    kept = [json.load(open(f)) for f in glob.glob(f"{tmp_path}/t/commit-*")]
    listed = {x["file"] for c in kept for x in c["files"] if c["version"] == 4}
    assert {os.path.basename(f) for f in glob.glob(f"{tmp_path}/t/part-*")} == listed
    assert rows(X.read_tensors(spark, path).select("shape", "data"), "data")[0] == ([2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    # a folder of files that others wrote
    os.makedirs(f"{tmp_path}/plain")
    for i, f in enumerate(sorted(listed)):
        os.link(f"{tmp_path}/t/{f}", f"{tmp_path}/plain/model-{i}.safetensors")
    assert rows(X.read_tensors(spark, f"file://{tmp_path}/plain").drop("version"), "tensor_name") == rows(X.read_tensors(spark, path).drop("version"), "tensor_name")


# -- serving


def _serve(spark, points, gap, room):
    """Round robin, step by step."""
    out, of = [], {}
    for key, i, at, kind, steps in sorted(points, key=lambda p: (p[2], p[1])):
        mine = of.setdefault(key, {"sessions": [], "kinds": {}})
        n = mine["kinds"][kind] = mine["kinds"].get(kind, 0) + 1
        s = mine["sessions"]
        if not s or at - s[-1][-1][1] > gap or len(s[-1]) == room:
            s.append([])
        s[-1].append((i, at, n, steps))
    for key, mine in of.items():
        for s in mine["sessions"]:
            queue, step = [(seat, *p, p[3]) for seat, p in enumerate(s)], 0
            while queue:
                seat, i, at, n, steps, left = queue.pop(0)
                step += 1
                if left > 1:
                    queue.append((seat, i, at, n, steps, left - 1))
                else:
                    out.append((key, s[0][0], i, seat, n, steps, step))
    return sorted(out)


@pytest.mark.parametrize("slice_", [2, 64])
def test_serving_in_slices_and_restarts(spark, tmp_path, slice_):
    r = random.Random(3)
    points, t = [], 0
    for i in range(160):
        t += r.choice((1, 5, 30, 200))
        points.append((r.choice((1, 1, 1, 2, 3, None)), i, t, r.choice(("a", "b", None, "")), r.randint(1, 5)))
    want = _serve(spark, [(-5 if k is None else k, i, at, kind or "", s) for k, i, at, kind, s in points], 60, 4)
    ddl = "key long, id long, at long, kind string, steps long"
    path = str(tmp_path)
    with Y.rocksdb(spark):
        # uneven parts, and marks that move the watermark on
        cuts = [points[:7], points[7:8], points[8:90], points[90:], *[[(-9, 1000 + k, t + 10**6 * (k + 1), "", 1)] for k in range(12 if slice_ == 2 else 2)]]
        for part in cuts:
            spark.createDataFrame(part, ddl).select("key", "id", F.timestamp_seconds("at").alias("ts"), "kind", "steps").write.mode("append").parquet(f"{path}/in")
            source = spark.readStream.schema("key long, id long, ts timestamp, kind string, steps long").parquet(f"{path}/in")
            q = Y.serve_points(source, 60, 4, steps=slice_).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/c").start(f"{path}/out")
            q.awaitTermination()
    got = sorted((-5 if x.key is None else x.key, *tuple(x)[1:]) for x in spark.read.parquet(f"{path}/out").where("key IS NULL OR key > -9").collect())
    assert got == want


@pytest.mark.parametrize("name", ["serve", "reorder"])
def test_keys_of_a_stream_share_state_rows(spark, tmp_path, name):
    """the store's rows, and the calls to it, are bounded by the buckets and not by the keys."""
    path, n = str(tmp_path), 20000
    rows = spark.range(n).select(F.col("id").alias("key"), F.col("id"), F.lit(1).cast("long").alias("seq"), F.timestamp_seconds(F.lit(100)).alias("ts"), F.lit("a").alias("kind"), F.lit(1).cast("long").alias("steps"), F.lit("p").alias("payload"))
    with Y.rocksdb(spark):
        rows.write.parquet(f"{path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        stream = Y.serve_points(source.drop("seq", "payload"), 60, 4) if name == "serve" else Z.in_sequence(source.select("key", "seq", "ts", "payload"), 100)
        q = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/c").start(f"{path}/out")
        q.awaitTermination()
        # a bucket has a row of state, one of its timers, and one of the timers' index
        assert 0 < max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 3 * buckets.BUCKETS


# -- reorder buffer


def test_reorder_gaps_late_and_repeated(spark, tmp_path):
    """Parts of a stream: what is early waits, a gap is given up after the patience, what comes later has no place."""
    ddl = "key long, seq long, at long, payload string"
    parts = [
        [(1, 1, 10, "b"), (1, 3, 11, "d"), (2, 0, 12, "x"), (3, 2, 12, "late gap"), (None, 0, 12, "null key")],
        [(1, 0, 20, "a"), (1, 0, 21, "a again"), (2, 1, 22, None)],
        [(1, 2, 30, "c"), (1, 5, 31, "f")],
        [(9, 0, 200, "mark")],  # patience 100: key 3's gap and key 1's missing 4 are given up
        [(3, 0, 201, "too late"), (3, 3, 202, "goes on"), (1, 6, 203, "g")],
        [(9, 1, 900, "mark")],
    ]
    path = str(tmp_path)
    with Y.rocksdb(spark):
        for part in parts:
            spark.createDataFrame(part, ddl).select("key", "seq", F.timestamp_seconds("at").alias("ts"), "payload").write.mode("append").parquet(f"{path}/in")
            source = spark.readStream.schema("key long, seq long, ts timestamp, payload string").parquet(f"{path}/in")
            q = Z.in_sequence(source, 100).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/c").start(f"{path}/out")
            q.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(f"{path}/out").collect()]
    order = lambda r: [(x is not None, x) for x in (r[0], r[2], r[1])] + [r[4] or ""]
    assert sorted((g for g in got if g[0] != 9), key=order) == sorted(
        [
            (None, 0, 0, 0, "null key"),
            (1, 0, None, None, "a again"), (1, 0, 0, 0, "a"), (1, 1, 1, 0, "b"), (1, 2, 2, 0, "c"), (1, 3, 3, 0, "d"), (1, 5, 4, 1, "f"), (1, 6, 5, 0, "g"),
            (2, 0, 0, 0, "x"), (2, 1, 1, 0, None), (3, 0, None, None, "too late"), (3, 2, 0, 2, "late gap"), (3, 3, 1, 0, "goes on"),
        ], key=order)


# -- products in blocks


def _plain_attention(q, k, v, size):
    s = q @ k.T / np.sqrt(size)
    s[np.triu_indices(len(q), 1)] = -np.inf
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e @ v / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("group,span,fan", [(5, 2, 2), (7, 3, 2), (4096, 16, 16)])
def test_attention_over_many_blocks(spark, monkeypatch, group, span, fan):
    """One long sequence, short ones, scores that only a common maximum keeps finite; several levels of merges."""
    for name, n in (("SPAN", span), ("FAN", fan), ("TILE", 3)):
        monkeypatch.setattr(B, name, n)
    rng = np.random.default_rng(0)
    lengths = {1: 83, 2: 1, 3: 6}
    data = {key: [rng.normal(0, 1, (n, w)) for w in (4, 4, 3)] for key, n in lengths.items()}
    data[1][0][40:60] *= 900
    table = [(key, i, *[m[i].tolist() for m in d]) for key, d in data.items() for i in range(len(d[0]))]
    df = spark.createDataFrame(table, "key long, pos long, q array<double>, k array<double>, v array<double>").repartition(5)
    got = {(r.key, r.pos): r.out for r in B.block_attention(df.select("key", "pos", "q"), df.select("key", "pos", "k", "v"), 4, group).collect()}
    assert len(got) == sum(lengths.values())
    for key, d in data.items():
        want = _plain_attention(*d, 4)
        assert np.allclose([got[key, i] for i in range(len(want))], want, rtol=1e-9, atol=1e-12)


def test_attention_equals_the_join(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.floor(F.col("vec_id") / 8).alias("key"), (F.col("vec_id") % 8).alias("pos"), F.col("embedding").cast("array<double>").alias("x"))
    q, k = v.select("key", "pos", F.slice("x", 1, 24).alias("q")), v.select("key", "pos", F.slice("x", 25, 24).alias("k"), F.slice("x", 49, 16).alias("v"))
    a = {(r.key, r.pos): r.out for r in B.block_attention(q, k, 24, 4).collect()}
    b = {(r.key, r.pos): r.out for r in M.causal_attention(q, k, 24, ["key"]).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[x], b[x]) for x in a)


def test_attention_without_keys(spark):
    q = spark.createDataFrame([(1, 0, [1.0]), (1, 5, [1.0]), (2, 0, [1.0]), (None, 0, [1.0])], "key long, pos long, q array<double>")
    k = spark.createDataFrame([(1, 3, [1.0], [7.0]), (None, 0, [1.0], [8.0])], "key long, pos long, k array<double>, v array<double>")
    assert sorted(map(str, B.block_attention(q, k, 1, 2).collect())) == ["Row(key=1, pos=5, out=[7.0])", "Row(key=None, pos=0, out=[8.0])"]
    assert B.block_attention(q.where("false"), k, 1).collect() == [] == B.block_attention(q, k.where("false"), 1).collect()


@pytest.mark.parametrize("group,slice_", [(6, 2), (4096, 16)])
def test_largest_products_and_ties(spark, monkeypatch, group, slice_):
    monkeypatch.setattr(B, "TILE", 4)
    monkeypatch.setattr(B, "SPAN", 2)
    monkeypatch.setattr(B, "FAN", 2)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (70, 5)).astype(float)  # many equal products
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:30])], "id long, x array<double>")
    right = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = rows(B.largest_products(left, right, 4, group, slice_), "id", "rank")
    want = []
    for i in range(30):
        best = sorted((-float(x[i] @ y), 100 + j) for j, y in enumerate(x))[:4]
        want += [(i, r, j, -d + 0.0) for r, (d, j) in enumerate(best)]
    assert got == want
    few = rows(B.largest_products(left, right.where("id < 103"), 4, group, slice_), "id", "rank")
    assert [r[1] for r in few] == [0, 1, 2] * 30
    assert B.largest_products(left, right.where("false"), 4).collect() == [] == B.largest_products(left.where("false"), right, 4).collect()


def test_products_make_no_row_a_pair(spark):
    """What is shuffled are blocks: few rows, however many pairs."""
    plan = spark._jvm.PythonSQLUtils.explainString(P.attention_blocks(spark, DATA)._jdf.queryExecution(), "simple")
    assert "FlatMapCoGroupsInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# -- scans


@pytest.mark.parametrize("n", [1, 7])
def test_running_sums_over_partitions(spark, tmp_path, n):
    """Keys over several partitions, one in each, null keys and values, ties in the order."""
    r = random.Random(n)
    table = [(r.choice(["hot"] * 6 + ["a", "b", None]), r.choice((None, *range(40))), i, r.choice((None, 1, 5, -3))) for i in range(900)]
    df = spark.createDataFrame(table, "k string, o int, id int, x long").repartition(3)
    df.transform(lambda d: S.parts(d, ["k"], ["o", "id"], n)).write.parquet(f"{tmp_path}/p")
    parted = spark.read.parquet(f"{tmp_path}/p")
    assert parted.select("_part").distinct().count() == n and (n == 1 or parted.where("k = 'hot'").select("_part").distinct().count() > 3)
    got = {r.id: (r.total, r.place) for r in S.running_sums(parted, ["k"], ["o", "id"], {"total": F.col("x"), "place": F.lit(1)}).collect()}
    state, want = {}, {}
    for k, o, i, x in sorted(table, key=lambda t: (t[1] is not None, t[1] or 0, t[2])):
        total, place = state.get(k, (0, 0))
        want[i] = state[k] = total + (x or 0), place + 1
    assert got == want
    whole = S.running_sums(parted, [], ["o", "id"], {"total": F.col("x")})
    assert whole.count() == 900


def test_no_window_holds_a_long_key(spark, tmp_path):
    df = spark.range(20000).select(F.lit(1).alias("k"), "id")
    S.parts(df, ["k"], ["id"], 16).write.parquet(f"{tmp_path}/p")
    parted = spark.read.parquet(f"{tmp_path}/p")
    assert parted.groupBy("_part").count().agg(F.max("count")).first()[0] < 4 * 20000 / 16
    out = S.running_sums(parted, ["k"], ["id"], {"s": F.col("id")})
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "_part" in next(x for x in plan.splitlines() if "Window [" in x and "_run_s" in x or "_we0" in x)
    assert out.where("s <> id * (id + 1) / 2").count() == 0 and S.running_sums(parted.where("false"), ["k"], ["id"], {"s": F.col("id")}).collect() == []


# -- closures


def _tree(seed, n):
    r = random.Random(seed)
    return [(i, None if i % 50 == 0 else r.randrange(max(0, i - 4), i) if i % 50 != 1 else i - 1) for i in range(n)]


def test_closure_of_any_depth(spark):
    keep = P._keep(spark)
    up = dict(_tree(1, 200))
    up |= {1000 + i: 1000 + i - 1 if i else None for i in range(131)}  # a chain
    up |= {5000: 4999, 5001: 5000}  # a parent that is no node
    df = spark.createDataFrame(list(up.items()), "node long, parent long")
    want = []
    for x in up:
        at, d = x, 0
        while at in up:
            want.append((x, at, d))
            at, d = up[at], d + 1
    assert rows(K.closure(df, keep), "node", "distance") == sorted(want, key=lambda r: (r[0], r[2]))
    last = {x: (a, d) for x, a, d in sorted(want, key=lambda r: r[2])}
    assert rows(K.roots(df, keep), "node") == sorted((x, a, d) for x, (a, d) in last.items())
    assert K.closure(df.where("false"), keep).collect() == [] == K.roots(df.where("false"), keep).collect()
    for circle in ([(1, 2), (2, 3), (3, 1), (4, 1)], [(1, 1)]):
        with pytest.raises(ValueError):
            K.closure(spark.createDataFrame(circle, "node long, parent long"), keep)
        with pytest.raises(ValueError):
            K.roots(spark.createDataFrame(circle, "node long, parent long"), keep)


# -- maximal paths


@pytest.mark.parametrize("n", [1, 9])
def test_maximal_paths_over_borders(spark, tmp_path, n):
    r = random.Random(n)
    paths = {tuple(r.choice((1, 2, -3)) for _ in range(r.randrange(0, 8))) for _ in range(400)} | {(9,) * i for i in range(60)}
    df = spark.createDataFrame([(list(p), i) for i, p in enumerate(paths)], "path array<long>, id int").repartition(4)
    S.parts(df, [], ["path"], n).write.parquet(f"{tmp_path}/p")
    got = {tuple(x.path) for x in E.maximal_paths(spark.read.parquet(f"{tmp_path}/p")).collect()}
    assert got == {p for p in paths if not any(len(q) > len(p) and q[: len(p)] == p for q in paths)}


# -- ranges


def test_range_joins(spark):
    r = random.Random(7)
    span = lambda: r.choice((0, 1, 3, 30, 31, 240, 241, 1000, 5000, -1))
    a = [(i, s, s + span()) for i in range(250) for s in [r.randrange(-3000, 3000)]] + [(900, None, 5), (901, 5, None), (902, -(2**40), 2**40)]
    b = [(i, s, s + span()) for i in range(250) for s in [r.randrange(-3000, 3000)]]
    ddl = "id long, start long, end long"
    x, y = spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl)
    points = y.select(F.col("id").alias("p"), F.col("start").alias("at")).union(spark.createDataFrame([(7, None)], "p long, at long"))
    got = sorted((r.id, r.p) for r in R.points_in(x, points, 30).collect())
    assert got == sorted((i, j) for i, s, e in a if None not in (s, e) for j, t, _ in b if s <= t <= e)
    got = Counter((r.id_a, r.id_b) for r in R.overlapping(x, y, 30).collect())
    assert got == Counter((i, j) for i, s, e in a if None not in (s, e) and s <= e for j, t, u in b if t <= u and s <= u and t <= e)
    assert R.overlapping(x.where("false"), y, 30).collect() == [] == R.points_in(x, points.where("false"), 30).collect()


def test_range_join_plan(spark):
    df = P.shipped_within(spark, DATA)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_lines_of_equal_times_meet_orders_once(spark, tmp_path):
    """30,000 lines at one time and 2,000 orders around it are not 60 million pairs."""
    at = F.timestamp_seconds(F.lit(86400 * 100))
    spark.range(2000).select(F.col("id").alias("o_orderkey"), at.alias("o_orderdate"), (F.col("id") % 3).alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(30000).select(at.alias("l_shipdate"), F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = P.shipped_within(spark, str(tmp_path))
    assert {(r.n, r.quantity) for r in df.collect()} == {(30000, 60000)} and df.count() == 2000
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "HashAggregate(keys=[at#" in plan


# -- table functions


def test_table_functions(spark):
    U.register(spark)
    spark.createDataFrame([(1, "a\n\nb"), (2, ""), (3, None)], "id int, t string").createOrReplaceTempView("texts_here")
    got = rows(spark.sql("SELECT id, idx, point FROM texts_here, LATERAL arborflow_outline(t)"), "id", "idx")
    assert got == [(1, 0, "a"), (1, 1, ""), (1, 2, "b"), (2, 0, "")]
    nodes = [("x", ["x"]), ("x", ["x", "a"]), ("x", ["x", "a", "b"]), ("x", ["x", "a", "c"]), ("x", ["x", "ab"]), ("y", ["y"]), (None, ["n"]), (None, ["n", "m"])]
    spark.createDataFrame(nodes, "tree string, path array<string>").repartition(3).createOrReplaceTempView("nodes_here")
    got = spark.sql("SELECT * FROM arborflow_tree_paths(TABLE(nodes_here))")
    assert got.columns == ["tree", "leaf", "n_nodes"]
    assert sorted((r.tree or "", r.leaf, r.n_nodes) for r in got.collect()) == [("", ["n", "m"], 2), ("x", ["x", "a", "b"], 3), ("x", ["x", "a", "c"], 3), ("x", ["x", "ab"], 2), ("y", ["y"], 1)]
    with pytest.raises(Exception, match="takes TABLE"):
        spark.sql("SELECT * FROM arborflow_tree_paths(TABLE(SELECT 1 AS a, 2 AS b))").collect()


# -- layers


def _numpy_layer(x, w):
    """One sequence (places, hidden), in full."""
    n, hd = len(x), w.size
    norm = lambda a: a / np.sqrt((a * a).mean(axis=1, keepdims=True) + w.eps)
    h, out = norm(x), []
    freq = w.base ** (-2.0 * np.arange(hd // 2) / hd)
    turn = np.exp(1j * np.arange(n)[:, None] * freq)
    def rope(a):
        z = (a[:, : hd // 2] + 1j * a[:, hd // 2 :]) * turn
        return np.concatenate([z.real, z.imag], axis=1)

    for i in range(w.heads):
        g = i // (w.heads // w.kv_heads)
        q, k, v = rope(h @ w.q[i * hd : (i + 1) * hd].T), rope(h @ w.k[g * hd : (g + 1) * hd].T), h @ w.v[g * hd : (g + 1) * hd].T
        out.append(_plain_attention(q, k, v, hd))
    y = x + np.concatenate(out, axis=1) @ w.out.T
    h = norm(y)
    gate = h @ w.gate.T
    return y + (gate / (1 + np.exp(-gate)) * (h @ w.up.T)) @ w.down.T


def test_layers_stacks_and_slices(spark):
    rng = np.random.default_rng(4)
    def layer(heads, kv):
        m = lambda r, c: rng.normal(0, 0.3, (r, c))
        return N.Layer(m(heads * 4, 6), m(kv * 4, 6), m(kv * 4, 6), m(6, heads * 4), m(5, 6), m(5, 6), m(6, 5), heads, kv)

    layers = [layer(4, 2), layer(3, 1), layer(2, 2)]
    data = {0: rng.normal(0, 1, (23, 6)), 7: rng.normal(0, 1, (1, 6)), 9: rng.normal(0, 1, (5, 6))}
    table = [(key, i, r.tolist()) for key, x in data.items() for i, r in enumerate(x)]
    df = spark.createDataFrame(table, "key long, pos long, x array<double>").repartition(3)
    keep = P._keep(spark)
    want = {}
    for key, x in data.items():
        for w in layers:
            x = _numpy_layer(x, w)
        want |= {(key, i): r for i, r in enumerate(x)}
    same = lambda out: {(r.key, r.pos) for r in out} == set(want) and all(np.allclose(r.x, want[r.key, r.pos], rtol=1e-8, atol=1e-10) for r in out)
    assert same(N.stack(df, [layers[:1], layers[1:]], keep, group=8).collect())
    for n in (1, 4):  # more slices than a sequence has places, among others
        assert same(N.sliced_prefill(df, layers, n, keep, group=4).collect())
    nulls = df.union(spark.createDataFrame([(None, 0, [1.0] * 6)], df.schema))
    assert N.layer_states(nulls, layers[0]).count() == 29 and N.layer_states(df.where("false"), layers[0]).count() == 0
    head = rng.normal(0, 1, (11, 6))
    last = {key: want[key, len(x) - 1] for key, x in data.items()}
    got = {r.key: (r.pos, r.token) for r in N.next_tokens(N.stack(df, [layers], keep), head).collect()}
    assert got == {key: (len(data[key]) - 1, int((head @ (v / np.sqrt((v * v).mean() + 1e-6))).argmax())) for key, v in last.items()}
    with pytest.raises(ValueError):
        layer(3, 2)

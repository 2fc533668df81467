"""Hand-derived results, and the catalogue against its SQL twins."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arborflow.functions import text as T
from arborflow.functions import vectors as V
from arborflow.functions import tokens
from arborflow.functions.tokens import Tokenizer
from arborflow.operators import model as M
from arborflow.operators import slicing as L
from arborflow.operators import speculate as S
from arborflow.operators import state as K
from arborflow.operators import tree as B
from arborflow.operators.decoder import Acceptance, Batch, TinyDecoder, Tree, alike, decode, decode_many, decode_requests, prefill_requests
from arborflow.plans import catalogue
from arborflow.plans.catalogue import QUERIES
from arborflow.plans.oracle import ORACLE

DATA = "/root/testdata/sf0.001"
SMALL = [[0], [1], [0, 0], [0, 1], [1, 0], [0, 0, 0]]
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tree(spark):
    n = B.tree_nodes(spark, SMALL)
    assert [r.tree_index for r in n.orderBy("node_id").collect()] == [0, 1, 2, 11, 12, 11, 21]
    assert [r.depth for r in n.orderBy("node_id").collect()] == [0, 1, 1, 2, 2, 2, 3]
    got = {k: {a for x, a in rows(B.tree_ancestors(n), "node_id") if x == k} for k in range(7)}
    assert got == {0: {0}, 1: {0, 1}, 2: {0, 2}, 3: {0, 1, 3}, 4: {0, 1, 4}, 5: {0, 2, 5}, 6: {0, 1, 3, 6}}
    assert [r.nodes for r in B.tree_paths(n).orderBy("path_id").collect()] == [[0, 1, 3, 6], [0, 2, 5, -1], [0, 1, 4, -1]]


def test_candidates(spark):
    n = B.tree_nodes(spark, SMALL)
    flat = spark.createDataFrame([(1, [100 + i for i in range(51)])], "request_id long, flat array<long>")
    tokens = S.tree_candidates(flat, n)
    assert tokens.first().tokens == [100, 101, 102, 111, 112, 111, 121]
    c = S.cartesian_candidates(tokens, B.tree_paths(n)).orderBy("path_id").collect()
    assert [r.candidate for r in c] == [[100, 101, 111, 121], [100, 102, 111, 0], [100, 101, 112, 0]]


def test_accept(spark):
    c = [(1, 0, [0, 1, 3, 6], [7, 3, 5, 2], [True, False, False]), (1, 1, [0, 2, 5, -1], [7, 4, 9, 0], [False, True, True]), (1, 2, [0, 1, 4, -1], [7, 3, 8, 0], [True, False, True])]
    got = S.accept(spark.createDataFrame(c, "request_id long, path_id long, nodes array<long>, candidate array<long>, mask array<boolean>"))
    r = got.first()
    assert (r.best, r.accept_length) == (0, 1)
    m = S.accept_message(got, F.lit(4)).first()
    assert (m.n, m["select"], m.ids) == (2, [4, 5], [7, 3])


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(V.pad_path(F.array(F.lit(1), F.lit(2), F.lit(3)), 5)) == [1, 2, 3, -2, -2]
    p = F.array(*[F.lit(x) for x in (0.5, 0.3, 0.15, 0.05)])
    assert get(V.nucleus_kept(p, 0.7)) == [0, 1]
    half = F.array(F.lit(0.5), F.lit(0.5))
    assert get(V.entropy(half)) == pytest.approx(-np.log(0.50001))
    assert get(V.typical_threshold(half, 0.09, 0.3)) == pytest.approx(0.09)
    assert get(V.prefix_length(F.array(F.lit(True), F.lit(False), F.lit(True)))) == 1
    s = F.split(F.lit("1. A\n\n2. B"), "\n")
    assert get(F.transform(s, lambda x, i: T.point_prompt(i, x))) == ["1. [/INST]1. A", "2. [/INST]", "3. [/INST]2. B"]
    for bad in ({"type": "linear"}, {"type": "x", "factor": 2.0}, {"type": "linear", "factor": 1}):
        with pytest.raises(ValueError):
            V.check_rope_scaling(bad)


def test_slices_stages_state(spark):
    t = spark.range(13).select(F.lit(1).alias("request_id"), F.col("id").alias("pos"))
    assert [n for _, n in rows(L.slices(t, 5).groupBy("slice_id").count(), "slice_id")] == [3, 3, 3, 2, 2]
    b = rows(L.stage_bounds(spark.createDataFrame([(0, 8), (1, 9), (2, 9), (3, 6)], "rank int, n_layers int")).select("rank", "left", "right"), "rank")
    assert b == [(0, 0, 8), (1, 8, 17), (2, 17, 26), (3, 26, 32)]
    state = spark.range(11).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * 10).alias("value"))
    a = spark.createDataFrame([(1, 4, [4, 5, 8])], "k int, prev_len long, select array<long>")
    assert rows(K.compact(state, a, ["k"]).where("pos >= 4").select("pos", "value"), "pos") == [(4, 40), (5, 50), (6, 80)]
    q = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "request_id int, branch_id int")
    assert [b for _, b in rows(K.round_robin(q, 7).select("step", "branch_id"), "step")] == [0, 1, 2, 0, 1, 2, 0]


@pytest.mark.parametrize("model", [TinyDecoder(), TinyDecoder(layers=5, stages=(2, 2, 1))], ids=["one stage", "three stages"])
@pytest.mark.parametrize("choices", [SMALL, B.TREES[B.DEFAULT]], ids=["small", "default"])
def test_decode_is_greedy(model, choices):
    """Speculation, cached rows, slices and stages change the number of steps and not the tokens."""
    tree = Tree.of(choices)
    ids, steps = decode(model, [1, 2, 3], tree, 7)
    plain = [1, 2, 3]
    while len(plain) < 3 + len(ids):
        plain.append(int(model.logits(np.array(plain))[0][-1].argmax()))
    assert plain[3:] == ids and steps == 7 <= len(ids)
    front = model.cache()
    model.prefill([1, 2], front)
    assert decode(model, [3], tree, 7, cache=model.cache(front))[0] == ids and front.length == 2
    assert decode(model, [1, 2, 3], tree, 7, eos=ids[0])[1] == 1


def test_stages_must_hold_all_layers():
    with pytest.raises(ValueError):
        TinyDecoder(layers=4, stages=(2, 1))


@pytest.mark.parametrize("how", [Acceptance(0.0), Acceptance(0.7), Acceptance(0.7, "nucleus", False, top_p=1e-9)], ids=["greedy", "typical", "nucleus"])
def test_acceptance_agrees_with_the_columns(spark, how):
    """Acceptance of the loop and of evaluate_posterior on equal scores; a nucleus of one token draws the argmax."""
    rng = np.random.default_rng(1)
    tree, nodes = Tree.of(SMALL), B.tree_nodes(spark, SMALL)
    for case in range(4):
        base = rng.normal(0, 1.5, (len(tree.index), 64))
        tokens = rng.integers(0, 64, len(tree.index))
        for a, b in ((0, 1), (1, 3), (3, 6))[: case + 1]:  # a chain that is accepted
            tokens[b] = base[a].argmax()
        path, n = how.best(base, tokens, tree.paths, np.random.default_rng(0))
        flat = spark.createDataFrame([(1, tokens.tolist())], "request_id long, tokens array<long>")
        logits = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(base)], "request_id long, node_id long, logits array<double>")
        got = S.evaluate_posterior(S.cartesian_candidates(flat, B.tree_paths(nodes)), logits, how.temperature, how.sampling, how.fast, how.top_p).first()
        assert (path, n) == (got.best, got.accept_length)


def test_draws_follow_the_kept_tokens():
    rng = np.random.default_rng(0)
    logits = np.log(np.tile([0.5, 0.3, 0.15, 0.05], (20000, 1)))
    nucleus = np.bincount(Acceptance(1.0, "nucleus", top_p=0.7).draw(logits, rng), minlength=4) / 20000
    assert abs(nucleus - [0.625, 0.375, 0, 0]).max() < 0.02
    typical = np.bincount(Acceptance(1.0, "typical", threshold=0.2, alpha=1.0).draw(logits, rng), minlength=4) / 20000
    assert abs(typical - [0.625, 0.375, 0, 0]).max() < 0.02


def test_shared_prefix_and_sampled_requests(spark):
    rows = [(1, 0, [4], [1, 2, 3]), (1, 1, [5, 6], [1, 2, 3]), (2, 0, [7], None), (3, 0, [], [9])] + [(4, b, [b % 60], []) for b in range(120)]
    r = spark.createDataFrame(rows, "request_id long, branch_id long, ids array<long>, front array<long>")
    got = {(x.request_id, x.branch_id): x for x in decode_requests(r, SMALL, 100, shared="front").collect()}
    model, tree = TinyDecoder(), Tree.of(SMALL)
    assert got[1, 1].ids == decode(model, [1, 2, 3, 5, 6], tree, 50)[0] and got[2, 0].ids == decode(model, [7], tree, 100)[0]
    assert got[3, 0].ids == decode(model, [9, 0], tree, 100)[0] and len(got) == len(rows)
    assert sum(x.n_steps for k, x in got.items() if k[0] == 4) == 100 and got[4, 119].ids == []
    how = Acceptance(0.7, "nucleus", False)
    one, two = (sorted(map(tuple, decode_requests(r.repartition(n), SMALL, 20, how=how, shared="front").collect())) for n in (1, 7))
    assert one == two


def test_stream(spark, tmp_path):
    from arborflow.streaming.queue import queue_places

    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = queue_places(source).writeStream.format("memory").queryName("places").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    assert q.awaitTermination(120)
    got = spark.table("places").groupBy("branch_id").agg(F.count("*").alias("n"), F.max("place").alias("m")).where("n <> m + 1").count()
    assert got == 0 and spark.table("places").count() == events.count()


def test_prefill_in_slices(spark):
    rows = [(1, 0, list(range(13))), (1, 1, [5]), (2, 0, []), (3, 0, None)]
    r = spark.createDataFrame(rows, "request_id long, branch_id long, ids array<long>")
    got = {(x.request_id, x.branch_id): x for x in prefill_requests(r, 5).collect()}
    model = TinyDecoder()
    for i, b, ids in rows[:2]:
        base, heads = model.logits(np.array(ids))
        assert (got[i, b].n, got[i, b].token) == (len(ids), base[-1].argmax())
        assert got[i, b].heads == np.argsort(-heads[:, -1], axis=1, kind="stable")[:, :10].tolist()
    assert (got[2, 0].n, got[2, 0].token, got[2, 0].heads) == (0, None, None) == (got[3, 0].n, got[3, 0].token, got[3, 0].heads)


def test_cache():
    c = TinyDecoder().cache(room=1)
    k = np.arange(2 * 6 * 8.0).reshape(2, 6, 8)
    for i in range(2):
        c.write(i, k, -k)
    assert c.length == 0
    c.keep(np.array([0, 2, 5]))
    assert c.seen == 3 and np.array_equal(c.valid(1)[0], k[:, [0, 2, 5]]) and np.array_equal(c.valid(0)[1], -k[:, [0, 2, 5]])
    c.reset()
    assert c.length == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizer(spark, name):
    path = f"/opt/tokenizers/{name}"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    t = Tokenizer(spark, path, start=1)
    texts = ["Plain words.", "", None, "naïve <|endoftext|> 東京", "x" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", t.encode(F.col("text")).alias("ids"), t.encode_parts(F.col("text"), F.lit("2. more")).alias("parts"))
    got = df.select("i", "ids", "parts", t.decode(F.col("ids"), skip=(1,)).alias("back")).orderBy("i").collect()
    assert [r.back for r in got] == texts
    more = spark.range(1).select(t.encode(F.lit("2. more")).alias("ids")).first().ids
    assert [r.parts for r in got if r.ids] == [r.ids + more[1:] for r in got if r.ids] and got[1].ids == [1] and got[2].ids is None
    with pytest.raises(ValueError):
        Tokenizer(spark, "/tmp/none.txt")


def test_pieces_of_texts_and_ids():
    """what is encoded or decoded at once is bounded by bytes, whatever rows a batch has."""
    texts = pa.array(["a" * 40, None, "", "b" * 200, *["c" * 30] * 7, None])
    got = [p.to_pylist() for (p,) in tokens._pieces(texts, most=100)]
    assert sum(got, []) == texts.to_pylist() and max(sum(len(t or "") for t in p) for p in got if len(p) > 1) <= 100
    lists = tokens._lists([np.arange(5), None, np.arange(0), np.arange(300)])
    assert lists.to_pylist() == [[0, 1, 2, 3, 4], None, [], list(range(300))]
    assert [len(p) for (p,) in tokens._pieces(lists, most=100)] == [3, 1] and list(tokens._pieces(texts[:0], most=100)) == []


def test_shared_first_parts(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files here")
    t = Tokenizer(spark, path, start=1)
    rows = [(i, None if i == 5 else "the shared part " * 50, None if i == 7 else f"point {i}") for i in range(9)] + [(9, "other", ""), (10, "", "x")]
    df = spark.createDataFrame(rows, "i int, a string, b string").coalesce(1)
    got = df.select("i", t.encode_parts(F.col("a"), F.col("b")).alias("p"), t.encode(F.col("a")).alias("x"), t.encode(F.col("b")).alias("y")).orderBy("i").collect()
    assert [r.p for r in got] == [None if r.x is None or r.y is None else r.x + r.y[1:] for r in got] and got[5].p is None is got[7].p


@pytest.mark.parametrize("how", [Acceptance(), Acceptance(0.7)], ids=["greedy", "typical"])
def test_sequences_side_by_side(how):
    """many sequences at once take what each takes alone."""
    rng, tree = np.random.default_rng(4), Tree.of(B.TREES[B.DEFAULT])
    ids = [rng.integers(1, 14, n).tolist() for n in (1, 2, 5, 5, 40, 41, 90, 300, 7, 7)]
    most, model = [9, 3, 0, 9, 9, 9, 3, 9, 9, 1], TinyDecoder(stages=(1, 1))
    for eos, places in ((None, 1 << 15), (5, 1 << 15), (None, 400)):
        want = [decode(model, x, tree, n, eos, how=how) if n else ([], 0) for x, n in zip(ids, most)]
        assert decode_many(model, ids, tree, most, eos, how=how, places=places) == want
    assert alike(model, how) and not alike(model, Acceptance(0.7, fast=False))
    few = Batch(model, tree, ids, 400)
    few.SCORES = 1000
    whole = Batch(model, tree, ids, 400)
    assert np.allclose(few.prefill(ids), whole.prefill(ids)) and np.allclose(few.keys, whole.keys)


@pytest.mark.parametrize("name", ["kv_append", "beam_reorder", "shared_prefix_union"])
def test_partitions_of_lines_grow_with_them(spark, name, monkeypatch):
    """F7, F8, F10: orders' lines are dealt once, by order, over partitions of PART_ROWS rows."""
    monkeypatch.setattr(catalogue, "PART_ROWS", 50)
    df = QUERIES[name](spark, DATA)
    n = -(-spark.read.parquet(f"{DATA}/lineitem.parquet").count() // 50)
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    by_order = [x for x in plan.splitlines() if "Exchange hashpartitioning(request_id" in x]
    assert "hashpartitioning(beam" not in plan
    assert by_order and all(f", {n}), REPARTITION_BY_NUM" in x for x in by_order)


def test_embedding_of_frequent_and_rare_ids(spark, monkeypatch):
    """tokens of a frequent id stay where they are; all others meet their vectors, too."""
    monkeypatch.setattr(M, "FREQUENT", 2)
    words = [(i, t) for i, t in enumerate([4] * 50 + [5] * 30 + [6] * 3 + [7, 8, None, 99])]
    tokens_, table = spark.createDataFrame(words, "i int, token_id long"), spark.createDataFrame([(k, k * 10) for k in (1, 4, 5, 6, 7, 8)], "token_id long, x int")
    df = M.embedded(tokens_, table)
    assert sorted((r.i, r.token_id, r.x) for r in df.collect()) == [(i, t, t * 10) for i, t in words if t in (4, 5, 6, 7, 8)]
    few = M.embedded(tokens_.where("token_id < 6"), table)
    plan = spark._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "simple")
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


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


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    assert _norm(QUERIES[name](spark, DATA).toPandas()) == _norm(duck.sql(ORACLE[name]).df())


def test_decode_loop_takes_every_turn_and_word(spark, tmp_path):
    from arborflow.plans.catalogue import QUERIES

    rows = [(1, t, "user", " ".join("x" * (1 + (i * i + 5 * t) % 13) for i in range(9 + t))) for t in range(4)] + [(2, 0, "user", "one"), (3, 5, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.request_id, r.branch_id): r for r in QUERIES["decode_loop"](spark, str(tmp_path)).collect()}
    assert {k: r.n_steps for k, r in got.items()} == {(1, 0): 25, (1, 1): 25, (1, 2): 25, (1, 3): 25, (2, 0): 100, (3, 5): 100}
    model = TinyDecoder()
    for c, t, _, text in rows:
        ids = [len(w) % 64 for w in (text or "").split(" ")]
        start = len(ids)
        while len(ids) - start < len(got[c, t].ids):
            ids.append(int(model.logits(np.array(ids))[0][-1].argmax()))
        assert ids[start:] == got[c, t].ids

"""Queries of the mechanisms that hold tables of any size: sources, state, scans, closures, joins and products, each with
its SQL.  All of them read the given tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import udtfs as U
from ..functions import vectors as V
from ..operators import blocks as B
from ..operators import closure as K
from ..operators import layers as N
from ..operators import model as M
from ..operators import prefixes as E
from ..operators import ranges as R
from ..operators import scan as S
from ..operators import slicing as L
from ..operators import speculate as G
from ..operators import tree as T
from ..sources import tensors as X
from ..streaming import reorder as Z
from ..streaming import serving as Y
from .catalogue import STAGES, TREE, _candidates, _folder, _node_logits, _read, _scores
from .oracle import CAND, ENTROPY, SOFT, STEP, _soft, _uniform


# -- tensor files


def _tensors(spark, d):
    return _read(spark, d, "embeddings").select(F.concat(F.lit("t."), F.col("vec_id").cast("string")).alias("tensor_name"), "label", F.col("embedding").alias("data"))


def _sizes(tensors: DataFrame, *columns) -> DataFrame:
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return tensors.select(*columns, F.size("data").cast("long").alias("n"), F.round(total, 4).alias("total"))


def tensor_scan(spark, d):
    """Embeddings written as tensor files by label, and a part read back by filters that reach the files."""
    path = _folder(spark, "tensors")
    X.write_tensors(_tensors(spark, d).withColumnRenamed("label", "stage"), path)
    some = X.read_tensors(spark, path, "stage IN (1, 3, 5) AND tensor_name >= 't.2' AND tensor_name < 't.7'")
    return _sizes(some, "tensor_name", "stage")


def tensor_checkpoint(spark, d):
    """A base folder of two commits and a head folder under its prefix; of a name written twice the later one."""
    base, head = _folder(spark, "base"), _folder(spark, "head")
    t = _tensors(spark, d)
    X.write_tensors(t.where("label < 6").drop("label"), base)
    X.write_tensors(t.where("label >= 4").select("tensor_name", F.transform("data", lambda x: x * 2).alias("data")), base)
    X.write_tensors(t.where("label = 3").drop("label"), head, "overwrite")
    return _sizes(X.latest(X.read_tensors(spark, base)), "tensor_name", "version").union(_sizes(L.with_prefix(X.read_tensors(spark, head), "medusa_head."), "tensor_name", "version"))


def tensor_stages(spark, d):
    """The model's layers split over stages, each stage's tensors written as its own files, and what one stage needs read."""
    v = _read(spark, d, "embeddings")
    name = F.when(F.col("label") == 8, F.concat(F.lit("model.embed_tokens."), "vec_id")).when(F.col("label") == 9, F.concat(F.lit("lm_head."), "vec_id"))
    name = F.coalesce(name, F.concat(F.lit("model.layers."), F.col("vec_id") % 32, F.lit(".w"), "vec_id"))
    stages = spark.createDataFrame(STAGES, "rank long, n_layers long")
    split = L.pruned(L.staged(v.select(name.alias("tensor_name"), F.col("embedding").alias("data")), stages), len(STAGES))
    path = _folder(spark, "stages")
    X.write_tensors(split.select(F.col("rank").cast("int").alias("stage"), F.col("stage_name").alias("tensor_name"), "data"), path, "overwrite")
    return _sizes(X.read_tensors(spark, path, "stage = 0").union(X.read_tensors(spark, path, "stage = 3")), "stage", "tensor_name")


# -- streams


def _replay(spark: SparkSession, rows: DataFrame, name: str, parts: list, closing: DataFrame, stream) -> DataFrame:
    """rows fed to a stream part by part and then the closing rows; the stream starts anew from its checkpoint for each.
    parts: conditions.  Its sink, read back."""
    path = _folder(spark, name)
    with Y.rocksdb(spark):
        for part in [*(rows.where(p) for p in parts), closing]:
            part.write.mode("append").parquet(f"{path}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
            run = stream(source).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start(f"{path}/out")
            run.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def serve_events(spark, d):
    """Events as points of their users' queues, replayed in four parts by time; sessions of at most 16 points that come
    within 6 hours, served in turn."""
    e = _read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), (1 + F.col("event_id") % 4).alias("steps"))
    cuts = e.agg(F.percentile_approx(F.unix_micros("ts"), [0.25, 0.5, 0.75])).first()[0] or [0, 0, 0]
    at = F.unix_micros("ts")
    parts = [at <= cuts[0], (at > cuts[0]) & (at <= cuts[1]), (at > cuts[1]) & (at <= cuts[2]), at > cuts[2]]
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"), F.lit("end").alias("kind"), F.lit(1).cast("long").alias("steps"))
    return _replay(spark, e, "serving", parts, last, lambda s: Y.serve_points(s, 6 * 3600, 16))


def reorder_lines(spark, d):
    """Lines of orders numbered by their sender, dealt over four parts of a stream at random, some lost; they leave in
    sequence, with the numbers that never came."""
    line = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = _read(spark, d, "lineitem").withColumn("seq", (line - 1).cast("long")).where("l_suppkey % 17 <> 3")
    turn = F.pmod(F.xxhash64("l_orderkey", "seq"), F.lit(4 * 3600)).cast("long")
    rows = rows.select(F.col("l_orderkey").alias("key"), "seq", F.timestamp_seconds(turn + 86400).alias("ts"), F.col("l_partkey").cast("string").alias("payload"))
    parts = [F.floor(F.unix_seconds("ts") / 3600) == 24 + i for i in range(4)]
    end = spark.range(1).select(F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("seq"), F.timestamp_seconds(F.lit(30 * 86400)).alias("ts"), F.lit("").alias("payload"))
    out = _replay(spark, rows, "reorder", parts, end, lambda s: Z.in_sequence(s, 86400))
    return out.where("key >= 0").select(F.col("key").alias("l_orderkey"), "seq", "place", "skipped", F.col("payload").cast("long").alias("l_partkey"))


# -- products in blocks


def attention_blocks(spark, d):
    """All embeddings as one sequence: each attends to all before it."""
    v = _read(spark, d, "embeddings").select(F.lit(0).cast("long").alias("key"), F.col("vec_id").alias("pos"), V.doubles(F.col("embedding")).alias("x"))
    part = lambda at, n, name: F.slice("x", at, n).alias(name)
    out = B.block_attention(v.select("key", "pos", part(1, 24, "q")), v.select("key", "pos", part(25, 24, "k"), part(49, 16, "v")), 24)
    return out.select("pos", F.posexplode("out").alias("i", "x")).select("pos", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def product_blocks(spark, d):
    """The five largest entries of each row of the embeddings times their transpose, in integers of a 1024th."""
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("double")).alias("x"))
    return B.largest_products(v, v, 5).select(F.col("id").alias("vec_id"), "rank", "other", F.col("dot").cast("long").alias("dot"))


# -- scans


def _keep(spark):
    """Writes a table to the shared folder, and reads it."""

    def f(df: DataFrame) -> DataFrame:
        path = _folder(spark, "kept")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return f


def running_total(spark, d):
    """Running quantity and number of all lines as one key."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    rows = _read(spark, d, "lineitem").select(*order)
    parted = _keep(spark)(S.parts(rows, [], order))
    out = S.running_sums(parted, [], order, {"quantity": F.col("l_quantity").cast("long"), "place": F.lit(1)})
    return out.select(*order, "quantity", "place")


def running_by_user(spark, d):
    """Running cents and number of each user's events, users of any size."""
    rows = _read(spark, d, "events").select("user_id", "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))
    parted = _keep(spark)(S.parts(rows, ["user_id"], ["ts", "event_id"]))
    return S.running_sums(parted, ["user_id"], ["ts", "event_id"], {"total": F.col("cents"), "place": F.lit(1)}).select("user_id", "event_id", "total", "place")


# -- closures and paths


def _url_parts():
    """Hosts' labels from the right, then the path's names."""
    plain = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    host, rest = F.substring_index(plain, "/", 1), F.regexp_extract(plain, "/(.*)$", 1)
    return F.concat(F.reverse(F.split(host, r"\.")), F.filter(F.split(rest, "/"), lambda x: x != ""))


def _url_nodes(spark, d):
    """(path) of every beginning of a page's address, each once."""
    paths = _read(spark, d, "pages").where("url IS NOT NULL").select(_url_parts().alias("p"))
    return paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda n: F.slice("p", F.lit(1), n))).alias("path")).distinct()


def url_closure(spark, d):
    """The tree of the pages' addresses: each node with all its ancestors."""
    text = lambda c: F.array_join(c, "/")
    up = F.expr("CASE WHEN size(path) > 1 THEN slice(path, 1, size(path) - 1) END")
    parents = _url_nodes(spark, d).select(text("path").alias("node"), text(up).alias("parent"))
    return K.closure(parents, _keep(spark))


def event_roots(spark, d):
    """Events as chains, each below the one before it of its user: how deep, and below which first event."""
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return K.roots(_read(spark, d, "events").select(F.col("event_id").alias("node"), before.alias("parent")), _keep(spark))


def maximal_token_paths(spark, d):
    """Documents' words, and those of their first lines, as paths of token ids: the paths that no other one continues."""
    ids = lambda t: F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), lambda w: (F.crc32(w.cast("binary")) % 50000).cast("int"))
    docs = _read(spark, d, "documents")
    paths = docs.select("doc_id", ids(F.col("text")).alias("path")).union(docs.select("doc_id", ids(F.substring_index("text", "\n", 1))))
    each = paths.groupBy("path").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_same"))
    parted = _keep(spark)(S.parts(each, [], ["path"]))
    return E.maximal_paths(parted).select("doc_id", "n_same", F.size("path").cast("long").alias("n"))


# -- ranges


def shipped_within(spark, d):
    """Of each order: the lines, of any order, shipped within its interval of 6 to 48 hours.  Lines shipped at the same time
    are added up first, so an order meets times and not lines."""
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    o = _read(spark, d, "orders").select("o_orderkey", seconds("o_orderdate").alias("start"), (seconds("o_orderdate") + 21600 * (1 + F.col("o_custkey") % 8)).alias("end"))
    points = _read(spark, d, "lineitem").select(seconds("l_shipdate").alias("at"), F.col("l_quantity").cast("long").alias("quantity"))
    times = points.groupBy("at").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"))
    pairs = R.points_in(o, times, 21600)
    return pairs.groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.sum("quantity").alias("quantity"))


def overlapping_events(spark, d):
    """Errors and purchases at the same time: an event lasts as many seconds as its value."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    e = _read(spark, d, "events").select(F.col("event_id").alias("id"), at.alias("start"), (at + F.floor(F.col("value") * 1000)).alias("end"), "event_type")
    return R.overlapping(e.where("event_type = 'error'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), 60000)


# -- table functions


def outline_lateral(spark, d):
    """Points of every text by a table function, from SQL."""
    U.register(spark)
    _read(spark, d, "documents").select("doc_id", "text").createOrReplaceTempView("arborflow_texts")
    return spark.sql("SELECT doc_id, idx, point FROM arborflow_texts, LATERAL arborflow_outline(text)")


def tree_leaves(spark, d):
    """The addresses' trees, a host's last two labels each: paths from the root to each leaf, by a table function over
    partitions."""
    U.register(spark)
    _url_nodes(spark, d).where("size(path) >= 2").select(F.array_join(F.slice("path", 1, 2), "/").alias("tree"), "path").createOrReplaceTempView("arborflow_nodes")
    return spark.sql("SELECT tree, array_join(leaf, '/') AS leaf, n_nodes FROM arborflow_tree_paths(TABLE(arborflow_nodes))")


# -- draws, masks and look-ups


def candidates_sampled(spark, d):
    """Candidates whose base token is drawn, once from the typical set and once from the nucleus."""
    nodes, v = T.tree_nodes(spark, TREE), _scores(spark, d)
    out = []
    for how in ("typical", "nucleus"):
        base = G.base_token(F.transform("logits", lambda x: x * 10), 0.7, how, u=G.hashed_uniform("request_id", F.lit(how)))
        tokens = G.tree_candidates(G.flat_candidates(v, base), nodes)
        c = G.cartesian_candidates(tokens, T.tree_paths(nodes))
        out.append(c.select(F.lit(how).alias("sampling"), "request_id", "path_id", V.joined(F.col("candidate")).alias("candidate")))
    return out[0].union(out[1])


def accept_typical_draws(spark, d):
    """Acceptance of the tokens that are drawn from the typical set at their places."""
    nodes, c = _candidates(spark, d)
    logits = _node_logits(spark, d, c.select("request_id").distinct(), nodes)
    return G.evaluate_posterior(c, logits, sampling="typical", fast=False).select("request_id", "best", "accept_length")


def _turn_words(spark, d):
    """(conv_id, turn, ids): the words of each turn of a conversation, a word's length as its id."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _read(spark, d, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.length(w)).alias("ids"))


def pad_mask(spark, d):
    """The mask of each place of each turn, words of up to three letters being pads."""
    rows = _turn_words(spark, d).select("conv_id", "turn", F.transform("ids", lambda x: F.when(x > 3, 1).otherwise(0)).alias("m"))
    rows = rows.select("conv_id", "turn", F.posexplode(M.causal_pad_mask(F.col("m"))).alias("pos", "row"))
    return rows.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.array_join(F.col("row").cast("array<string>"), "").alias("visible"))


def embedding_lookup(spark, d):
    """The embedding vector of each word of each turn, in 1024ths; ids without a vector have no row."""
    words = _turn_words(spark, d).select("conv_id", "turn", F.posexplode("ids").alias("pos", "id")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.col("id").cast("long").alias("token_id"))
    table = _read(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("x"))
    return M.embedded(words, table).select("conv_id", "turn", "pos", "token_id", V.joined(F.col("x")).alias("x"))


# -- layers


def _plain_weights(rows, columns, turn):
    """Fixed weights, as the catalogue's."""
    return ((np.arange(rows)[:, None] * 7 + np.arange(columns)[None, :] * 3 + turn) % 11 - 5) / 64.0


def _layer(turn, hidden=64, heads=2, kv_heads=1, size=8, inner=16):
    w = lambda r, c, k: _plain_weights(r, c, turn + k)
    return N.Layer(w(heads * size, hidden, 0), w(kv_heads * size, hidden, 1), w(kv_heads * size, hidden, 2), w(hidden, heads * size, 3), w(inner, hidden, 4), w(inner, hidden, 5), w(hidden, inner, 6), heads, kv_heads)


def _states(spark, d):
    """Embeddings as hidden states of sequences of 20 places."""
    return _read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("key"), (F.col("vec_id") % 20).alias("pos"), V.doubles(F.col("embedding")).alias("x"))


def _rounded(states):
    out = states.select("key", "pos", F.posexplode("x").alias("i", "v"))
    return out.select("key", "pos", F.col("i").cast("long").alias("i"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


def decoder_layer(spark, d):
    """One layer: norm, projections, rotary positions, grouped heads, causal attention, gated MLP, residuals."""
    return _rounded(N.layer_states(_states(spark, d), _layer(0)))


def decoder_stages(spark, d):
    """Four layers in two stages, the first stage's states written for the second, and the head's token after the last
    place of each sequence."""
    stages = [[_layer(0), _layer(1)], [_layer(2), _layer(3)]]
    return N.next_tokens(N.stack(_states(spark, d), stages, _keep(spark)), _plain_weights(32, 64, 5))


def sliced_prefill(spark, d):
    """Two layers over sequences in three slices, each seeing the caches of those before it."""
    return _rounded(N.sliced_prefill(_states(spark, d), [_layer(0), _layer(1)], 3, _keep(spark)))


def pooled_scores(spark, d):
    """A score head on the last word before the first pad (words of twelve letters) of each turn, the last word if it has no
    pad: four sums of the word's embedding, in 1024ths, times fixed weights."""
    place = M.last_nonpad(F.col("ids"), 12)
    rows = _turn_words(spark, d).where("size(ids) > 0").select("conv_id", "turn", "ids", F.when(place < 0, F.size("ids") - 1).otherwise(place).cast("long").alias("pos"))
    rows = rows.select("conv_id", "turn", "pos", F.get("ids", F.col("pos").cast("int")).cast("long").alias("token_id"))
    table = _read(spark, d, "embeddings").select(F.col("vec_id").alias("token_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("x"))
    def score(r):
        weighted = F.transform("x", lambda v, j: v * ((j * 3 + r * 7) % 11 - 5))
        return F.aggregate(weighted, F.lit(0).cast("long"), lambda a, v: a + v).alias(f"score_{r}")

    return M.embedded(rows, table).select("conv_id", "turn", "pos", *[score(r) for r in range(4)])


FUNCTIONS = (pooled_scores, decoder_layer, decoder_stages, sliced_prefill, candidates_sampled, accept_typical_draws, pad_mask, embedding_lookup, tensor_scan, tensor_checkpoint, tensor_stages, serve_events, reorder_lines, attention_blocks, product_blocks, running_total, running_by_user, url_closure, event_roots, maximal_token_paths, shipped_within, overlapping_events, outline_lateral, tree_leaves)
QUERIES = {f.__name__: f for f in FUNCTIONS}

_N = "CAST(len(embedding) AS BIGINT) AS n"
_TOTAL = "round(list_sum(list_transform(embedding, lambda x: CAST({} AS DOUBLE))), 4) AS total"

_URLS = r"""p AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS t FROM pages WHERE url IS NOT NULL),
q AS (SELECT list_reverse(string_split(split_part(t, '/', 1), '.')) || list_filter(string_split(substr(t, length(split_part(t, '/', 1)) + 2), '/'), lambda x: x <> '') AS p FROM p),
u AS (SELECT DISTINCT unnest(list_transform(range(1, len(p) + 1), lambda i: p[1:i])) AS path FROM q)"""

#: The drawn base token of each request by both ways, and the catalogue's candidates with it in the argmax's place.
_BASES = f"""{_soft(10)}, h AS (SELECT vec_id, p, {ENTROPY} AS h FROM s WHERE vec_id % 6 = 0),
x AS (SELECT vec_id // 6 AS request_id, least(0.09, exp(-h) * 0.3) AS th, unnest(range(64)) AS i, unnest(p) AS p FROM h),
y AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY request_id ORDER BY p DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x),
weights AS (SELECT request_id, i, 'nucleus' AS sampling, CASE WHEN before <= 0.8 THEN p ELSE 0 END AS a FROM y UNION ALL SELECT request_id, i, 'typical', CASE WHEN p < th THEN 0 ELSE p END FROM y),
z AS (SELECT request_id, sampling, {_uniform("request_id || ',' || sampling")} AS u, sum(a) OVER (PARTITION BY request_id, sampling ORDER BY i ROWS UNBOUNDED PRECEDING) AS run, sum(a) OVER (PARTITION BY request_id, sampling) AS total FROM weights),
base AS (SELECT request_id, sampling, CAST(least(count(*) FILTER (run <= u * total), 63) AS BIGINT) AS token FROM z GROUP BY ALL)"""

_TURNS = r"""t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM conversations)"""

def _layers_sql(n: int) -> str:
    """Tables x0 (key, pos, x) to xn: states after each layer."""
    w = lambda i, j, turn: f"((({i}) * 7 + ({j}) * 3 + {turn}) % 11 - 5) / 64.0"
    linear = lambda rows, v, m, turn: f"list_transform(range({rows}), lambda r: list_sum(list_transform(range({m}), lambda c: {v}[c + 1] * {w('r', 'c', turn)})))"
    normed = "list_transform({0}, lambda e: e / sqrt(list_sum(list_transform({0}, lambda f: f * f)) / 64 + 1e-6))"
    def rope(v, at):  # of the 8 places from `at` on
        angle = "pos * pow(10000.0, -2.0 * (i % 4) / 8)"
        return f"list_transform(range(8), lambda i: {v}[i + {at + 1}] * cos({angle}) + (CASE WHEN i < 4 THEN -{v}[i + {at + 5}] ELSE {v}[i + {at - 3}] END) * sin({angle}))"

    steps = ["x0 AS MATERIALIZED (SELECT vec_id // 20 AS key, vec_id % 20 AS pos, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"]
    for t in range(n):
        steps += [
            f"h{t} AS MATERIALIZED (SELECT key, pos, x, {normed.format('x')} AS h FROM x{t})",
            f"p{t} AS MATERIALIZED (SELECT key, pos, x, {linear(16, 'h', 64, t)} AS q, {linear(8, 'h', 64, t + 1)} AS k, {linear(8, 'h', 64, t + 2)} AS v FROM h{t})",
            f"r{t} AS MATERIALIZED (SELECT key, pos, x, [{rope('q', 0)}, {rope('q', 8)}] AS q, {rope('k', 0)} AS k, v FROM p{t})",
            f"e{t} AS MATERIALIZED (SELECT a.key, a.pos, head, b.v, exp(list_sum(list_transform(range(8), lambda i: a.q[head + 1][i + 1] * b.k[i + 1])) / sqrt(8.0)) AS e FROM r{t} a JOIN r{t} b ON a.key = b.key AND b.pos <= a.pos, range(2) z(head))",
            f"o{t} AS MATERIALIZED (SELECT key, pos, list(o ORDER BY head, i) AS a FROM (SELECT key, pos, head, i, sum(e * u) / sum(e) AS o FROM (SELECT key, pos, head, e, unnest(v) AS u, unnest(range(8)) AS i FROM e{t}) GROUP BY ALL) GROUP BY key, pos)",
            f"y{t} AS MATERIALIZED (SELECT key, pos, list_transform(range(64), lambda d: x[d + 1] + m[d + 1]) AS y FROM (SELECT key, pos, x, {linear(64, 'a', 16, t + 3)} AS m FROM x{t} JOIN o{t} USING (key, pos)))",
            f"n{t} AS MATERIALIZED (SELECT key, pos, y, {normed.format('y')} AS h FROM y{t})",
            f"g{t} AS MATERIALIZED (SELECT key, pos, y, {linear(16, 'h', 64, t + 4)} AS a, {linear(16, 'h', 64, t + 5)} AS b FROM n{t})",
            f"m{t} AS MATERIALIZED (SELECT key, pos, y, list_transform(range(16), lambda i: a[i + 1] / (1 + exp(-a[i + 1])) * b[i + 1]) AS m FROM g{t})",
            f"x{t + 1} AS MATERIALIZED (SELECT key, pos, list_transform(range(64), lambda d: y[d + 1] + z[d + 1]) AS x FROM (SELECT key, pos, y, {linear(64, 'm', 16, t + 6)} AS z FROM m{t}))",
        ]
    return "WITH " + ",\n".join(steps)


_ROUNDED = "SELECT key, pos, unnest(range(64)) AS i, round(unnest(x), 5) + CAST(0 AS DOUBLE) AS v FROM {}"

ORACLE = {
    "decoder_layer": f"{_layers_sql(1)} {_ROUNDED.format('x1')}",
    "sliced_prefill": f"{_layers_sql(2)} {_ROUNDED.format('x2')}",
    "decoder_stages": f"""{_layers_sql(4)},
l AS (SELECT key, pos, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)) / 64 + 1e-6)) AS h FROM x4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) = 1),
g AS (SELECT key, pos, list_transform(range(32), lambda r: round(list_sum(list_transform(range(64), lambda c: h[c + 1] * ((r * 7 + c * 3 + 5) % 11 - 5) / 64.0)), 9)) AS z FROM l)
SELECT key, pos, list_position(z, list_max(z)) - 1 AS token FROM g""",
    "candidates_sampled": CAND.replace("v AS (", f"{_BASES},\nv AS (", 1).replace("g AS (SELECT request_id, flatten(heads) AS flat FROM f)", "g AS (SELECT sampling, f.request_id, [token] || flatten(heads)[2:] AS flat FROM f JOIN base USING (request_id))").replace("k AS (SELECT request_id, list(flat[tree_index + 1] ORDER BY node_id) AS tokens FROM g, n GROUP BY request_id)", "k AS (SELECT sampling, request_id, list(flat[tree_index + 1] ORDER BY node_id) AS tokens FROM g, n GROUP BY ALL)").replace("c AS (SELECT request_id, path_id", "c AS (SELECT sampling, request_id, path_id") + " SELECT sampling, request_id, path_id, array_to_string(cand, ',') AS candidate FROM c",
    "accept_typical_draws": CAND + STEP + f""",
q AS (SELECT request_id, path_id, i, tok, {SOFT.format(s=1)} AS e, {_uniform("request_id || ',' || path_id || ',' || i || ',0'")} AS u FROM j),
s AS (SELECT request_id, path_id, i, tok, u, list_transform(e, lambda x: x / list_sum(e)) AS p FROM q),
o AS (SELECT *, least(0.09, exp(-1 * ({ENTROPY})) * 0.3) AS th FROM s),
x AS (SELECT request_id, path_id, i, tok, u, unnest(range(64)) AS k, unnest(list_transform(p, lambda x: CASE WHEN x < th THEN 0 ELSE x END)) AS p FROM o),
runs AS (SELECT request_id, path_id, i, tok, u, sum(p) OVER (PARTITION BY request_id, path_id, i ORDER BY k ROWS UNBOUNDED PRECEDING) AS run, sum(p) OVER (PARTITION BY request_id, path_id, i) AS total FROM x),
m AS (SELECT request_id, path_id, i, least(count(*) FILTER (run <= u * total), 63) = any_value(tok) AS ok FROM runs GROUP BY ALL),
r AS (SELECT request_id, path_id, coalesce(min(i) FILTER (NOT ok), max(i) + 1) AS acc FROM m GROUP BY ALL)
SELECT request_id, path_id AS best, CAST(acc AS BIGINT) AS accept_length FROM r QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY acc DESC, path_id) = 1""",
    "pooled_scores": f"""WITH {_TURNS}, p AS (SELECT conv_id, turn, ids, CASE WHEN list_position(ids, 12) IS NULL THEN len(ids) - 1 WHEN list_position(ids, 12) = 1 THEN len(ids) - 1 ELSE list_position(ids, 12) - 2 END AS pos FROM t WHERE len(ids) > 0),
e AS (SELECT conv_id, turn, pos, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1024) AS BIGINT)) AS x FROM p JOIN embeddings ON vec_id = ids[pos + 1])
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, {", ".join(f"CAST(list_sum(list_transform(range(64), lambda j: x[j + 1] * (({r} * 7 + j * 3) % 11 - 5))) AS BIGINT) AS score_{r}" for r in range(4))} FROM e""",
    "pad_mask": f"""WITH {_TURNS}
SELECT conv_id, turn, CAST(i AS BIGINT) AS pos, array_to_string(list_transform(range(len(ids)), lambda j: CASE WHEN j <= i AND ids[j + 1] > 3 THEN '1' ELSE '0' END), '') AS visible FROM (SELECT *, unnest(range(len(ids))) AS i FROM t)""",
    "embedding_lookup": f"""WITH {_TURNS}, x AS (SELECT conv_id, turn, unnest(range(len(ids))) AS pos, unnest(ids) AS token_id FROM t)
SELECT conv_id, turn, pos, token_id, array_to_string(list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 1024) AS BIGINT)), ',') AS x FROM x JOIN embeddings ON vec_id = token_id""",
    "tensor_scan": f"SELECT 't.' || vec_id AS tensor_name, label AS stage, {_N}, {_TOTAL.format('x')} FROM embeddings WHERE label IN (1, 3, 5) AND 't.' || vec_id >= 't.2' AND 't.' || vec_id < 't.7'",
    "tensor_checkpoint": f"""
SELECT 't.' || vec_id AS tensor_name, CASE WHEN label >= 4 THEN 2 ELSE 1 END AS version, {_N}, CASE WHEN label >= 4 THEN {_TOTAL.format('x * 2').removesuffix(' AS total')} ELSE {_TOTAL.format('x').removesuffix(' AS total')} END AS total FROM embeddings
UNION ALL SELECT 'medusa_head.t.' || vec_id, 1, {_N}, {_TOTAL.format('x')} FROM embeddings WHERE label = 3""",
    "tensor_stages": f"""
SELECT CASE WHEN label = 9 THEN 3 WHEN label = 8 OR vec_id % 32 < 8 THEN 0 ELSE 3 END AS stage,
  CASE WHEN label = 8 THEN 'model.embed_tokens.' || vec_id WHEN label = 9 THEN 'lm_head.' || vec_id ELSE 'model.layers.' || (vec_id % 32 - CASE WHEN vec_id % 32 < 8 THEN 0 ELSE 26 END) || '.w' || vec_id END AS tensor_name, {_N}, {_TOTAL.format('x')}
FROM embeddings WHERE label >= 8 OR vec_id % 32 < 8 OR vec_id % 32 >= 26""",
    "serve_events": """
WITH e AS (SELECT user_id AS key, event_id AS id, epoch_ms(ts) AS t, event_type AS kind, 1 + event_id % 4 AS steps FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY t, id) AS nth_of_kind, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, id) > 21600000 THEN 1 ELSE 0 END AS cut FROM e),
r AS (SELECT *, sum(cut) OVER (PARTITION BY key ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY t, id) - 1 AS place FROM r),
q AS (SELECT *, place // 16 AS part, place % 16 AS seat FROM s)
SELECT a.key, min(b.id) FILTER (b.seat = 0) AS session, a.id, a.seat, a.nth_of_kind, a.steps,
  CAST(sum(CASE WHEN b.seat <= a.seat THEN least(b.steps, a.steps) ELSE least(b.steps, a.steps - 1) END) AS BIGINT) AS finish_step
FROM q a JOIN q b ON a.key = b.key AND a.run = b.run AND a.part = b.part GROUP BY ALL""",
    "reorder_lines": """
WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS seq FROM lineitem)
SELECT l_orderkey, seq, row_number() OVER w - 1 AS place, seq - coalesce(lag(seq) OVER w, -1) - 1 AS skipped, l_partkey FROM l WHERE l_suppkey % 17 <> 3 WINDOW w AS (PARTITION BY l_orderkey ORDER BY seq)""",
    "attention_blocks": """
WITH v AS (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
s AS (SELECT a.pos, b.x[49:64] AS v, exp(list_sum(list_transform(range(24), lambda i: a.x[i + 1] * b.x[i + 25])) / sqrt(24.0)) AS e FROM v a JOIN v b ON b.pos <= a.pos),
u AS (SELECT pos, e, unnest(range(16)) AS i, unnest(v) AS x FROM s)
SELECT pos, i, round(sum(e * x) / sum(e), 6) AS x FROM u GROUP BY pos, i""",
    "product_blocks": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS x FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS other, CAST(list_sum(list_transform(range(64), lambda i: a.x[i + 1] * b.x[i + 1])) AS BIGINT) AS dot FROM v a, v b)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, other) - 1 AS rank, other, dot FROM p QUALIFY rank < 5""",
    "running_total": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS quantity, count(*) OVER w AS place
FROM lineitem WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING)""",
    "running_by_user": """
SELECT user_id, event_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS total, count(*) OVER w AS place
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
    "url_closure": f"""
WITH RECURSIVE {_URLS}, n AS (SELECT array_to_string(path, '/') AS node, CASE WHEN len(path) > 1 THEN array_to_string(path[1:len(path) - 1], '/') END AS parent FROM u),
c AS (SELECT node, node AS ancestor, 0 AS distance FROM n UNION ALL SELECT c.node, n.parent, distance + 1 FROM c JOIN n ON n.node = c.ancestor WHERE n.parent IS NOT NULL)
SELECT node, ancestor, CAST(distance AS BIGINT) AS distance FROM c""",
    "event_roots": """
SELECT event_id AS node, first_value(event_id) OVER w AS root, row_number() OVER w - 1 AS depth FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "maximal_token_paths": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS path FROM documents UNION ALL SELECT doc_id, regexp_extract_all(coalesce(split_part(text, chr(10), 1), ''), '[^\x20\x09-\x0D]+') FROM documents),
e AS (SELECT path, min(doc_id) AS doc_id, count(*) AS n_same FROM w GROUP BY path)
SELECT doc_id, n_same, CAST(len(path) AS BIGINT) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE len(x.path) > len(e.path) AND (len(e.path) = 0 OR x.path[1] = e.path[1]) AND x.path[1:len(e.path)] = e.path)""",
    "shipped_within": """
WITH o AS (SELECT o_orderkey, epoch(o_orderdate) AS a, epoch(o_orderdate) + 21600 * (1 + o_custkey % 8) AS b FROM orders),
l AS (SELECT epoch(l_shipdate) AS t, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(sum(n) AS BIGINT) AS n, CAST(sum(q) AS BIGINT) AS quantity FROM o JOIN l ON t >= a AND t <= b GROUP BY o_orderkey""",
    "overlapping_events": """
WITH e AS (SELECT event_id, event_type, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(value * 1000) AS BIGINT) AS b FROM events)
SELECT x.event_id AS id_a, y.event_id AS id_b FROM e x JOIN e y ON x.a <= y.b AND y.a <= x.b WHERE x.event_type = 'error' AND y.event_type = 'purchase' AND x.a <= x.b AND y.a <= y.b""",
    "outline_lateral": "SELECT doc_id, unnest(range(len(s))) AS idx, unnest(s) AS point FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)",
    "tree_leaves": f"""
WITH {_URLS}, n AS (SELECT path, path[1:2] AS tree FROM u WHERE len(path) >= 2)
SELECT array_to_string(tree, '/') AS tree, array_to_string(path, '/') AS leaf, CAST(len(path) - 1 AS BIGINT) AS n_nodes FROM n WHERE NOT EXISTS (SELECT 1 FROM n x WHERE len(x.path) = len(n.path) + 1 AND x.path[1:len(n.path)] = n.path)""",
}

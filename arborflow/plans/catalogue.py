"""Queries over the test tables, one or more for each operator, and their SQL twins.

Stand-ins: an embedding is a vector of logits over 64 tokens; vector v belongs to request v div 6, head v mod 6 (0: the
base model); node k of request r reads vector (r + 31 k) modulo the number of vectors; a word's token id is its length.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import Tokenizer
from ..functions import vectors as V
from ..operators import model as M
from ..operators import slicing as L
from ..operators import speculate as S
from ..operators import state as K
from ..operators import tree as B
from ..operators.decoder import Acceptance, decode_requests, prefill_requests
from ..sources.checkpoints import outputs, prompts, read_checkpoint, read_config, read_index, read_stage, tensor_bytes, write_stages
from ..streaming.queue import queue_places as queue

TREE = B.TREES[B.DEFAULT]
TREE_SQL = "SELECT unnest(CAST(" + str([[]] + TREE) + " AS BIGINT[][])) AS path"
_own: list[str] = []
STAGES = [(0, 8), (1, 9), (2, 9), (3, 6)]


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("logits"))


def _scores(spark, d):
    v = _vectors(spark, d).select(F.floor(F.col("vec_id") / 6).alias("request_id"), (F.col("vec_id") % 6).alias("head"), "logits")
    full = v.groupBy("request_id").agg(F.count("*").alias("n")).where("n = 6").select("request_id")
    return v.join(full, "request_id", "left_semi")


def _node_logits(spark, d, requests, nodes):
    n = _read(spark, d, "embeddings").agg(F.count("*").alias("n"))
    at = requests.crossJoin(F.broadcast(nodes.select("node_id"))).crossJoin(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("request_id") + 31 * F.col("node_id"), F.col("n")))  # a tree's nodes; one row
    return at.join(_vectors(spark, d), "vec_id").select("request_id", "node_id", "logits")


def _words(spark, d):
    """(request_id, pos, token_id) of the words of each document."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return _read(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.posexplode(words).alias("pos", "word")).select("request_id", F.col("pos").cast("long").alias("pos"), F.length("word").cast("long").alias("token_id"))


def _ids(spark, d):
    """(request_id, ids): the token ids of the words of each document that has any."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    ids = F.transform(words, lambda w: F.length(w).cast("long"))
    return _read(spark, d, "documents").select(F.col("doc_id").alias("request_id"), ids.alias("ids")).where("size(ids) > 0")


def _manifest(spark):
    layers = spark.range(32).crossJoin(F.broadcast(spark.createDataFrame([("self_attn.q_proj",), ("mlp.up_proj",)], "part string")))
    names = layers.select(F.concat(F.lit("model.layers."), F.col("id").cast("string"), F.lit("."), "part", F.lit(".weight")).alias("tensor_name"))
    return names.union(spark.createDataFrame([("model.embed_tokens.weight",), ("model.norm.weight",), ("lm_head.weight",)], "tensor_name string"))


def _folder(spark, name):
    """A new folder's name below the shared one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not top and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not top and not _own:  # all in one process, as in tests: a folder that goes at exit
        _own.append(tempfile.mkdtemp(prefix="arborflow-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"{(top or 'file://' + _own[0]).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _tokenizer(spark):
    return Tokenizer(spark, spark.conf.get("spark.arborflow.tokenizer", "/opt/tokenizers/byte_bpe_50k.json"), start=50256)


def skeleton_prompt(spark, d):
    c = _read(spark, d, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", T.skeleton_prompt(F.col("text")).alias("prompt"))


def outline_points(spark, d):
    docs = _read(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "point")).select("doc_id", F.col("idx").cast("long").alias("idx"), "point")


def point_prompts(spark, d):
    return outline_points(spark, d).select("doc_id", "idx", T.point_prompt(F.col("idx"), F.col("point")).alias("prompt"))


def shared_prefix(spark, d):
    c = _read(spark, d, "conversations")
    q = c.where("turn = 0").select("conv_id", F.col("text").alias("q"))
    return q.join(c.where("turn = 1").select("conv_id", F.col("text").alias("s")), "conv_id").select("conv_id", T.shared_prefix(F.col("q"), F.col("s")).alias("prompt"))


def skeleton_normalised(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.normalised_skeleton(F.regexp_replace("text", "\n", "\n  ")).alias("skeleton"))


def tree_dispatch(spark, d):
    return spark.createDataFrame([("vicuna-7b-v1.3",), ("vicuna_13b",), ("vicuna-33b",), ("zephyr-7b",), ("other",), ("vicuna-1b",)], "model string").select("model", T.tree_name(F.col("model")).alias("tree"))


def slice_sequences(spark, d):
    cut = _ids(spark, d).select("request_id", F.inline(L.array_slices(F.col("ids"), 5)))
    return cut.select("request_id", "slice_id", F.size("ids").cast("long").alias("n"), "first", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"))


def stage_range_join(spark, d):
    return L.staged(_manifest(spark), spark.createDataFrame(STAGES, "rank long, n_layers long")).select("rank", "tensor_name", "stage_name")


def layer_split(spark, d):
    return _manifest(spark).select("tensor_name", F.coalesce(L.layer_of(F.col("tensor_name")), F.lit(-1)).alias("layer"))


def manifest_last_wins(spark, d):
    o = _read(spark, d, "orders")
    m = o.select(F.concat(F.lit("t."), (F.col("o_custkey") % 1000).cast("string")).alias("tensor_name"), F.concat(F.lit("file-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("file"))
    return L.last_wins(m.where("tensor_name < 't.5'"), m.where("tensor_name LIKE '%7%'"))


def tree_nodes(spark, d):
    n = B.tree_nodes(spark, TREE)
    return n.select("node_id", F.coalesce("parent_id", F.lit(-1)).alias("parent_id"), "depth", "tree_index", V.joined(F.col("path")).alias("path"))


def tree_ancestors(spark, d):
    return B.tree_ancestors(B.tree_nodes(spark, TREE))


def tree_paths(spark, d):
    return B.tree_paths(B.tree_nodes(spark, TREE)).select("path_id", V.joined(F.col("nodes")).alias("nodes"))


def depth_histogram(spark, d):
    return B.depth_histogram(B.tree_nodes(spark, TREE))


def tree_mask_semijoin(spark, d):
    n = B.tree_nodes(spark, TREE)
    return M.tree_visible(n, B.tree_ancestors(n))


def topk_per_head(spark, d):
    v = _vectors(spark, d)
    return v.select("vec_id", F.posexplode(V.top_k(F.col("logits"), 10)).alias("r", "token")).select("vec_id", F.col("r").cast("long").alias("r"), "token")


def argmax_token(spark, d):
    return _vectors(spark, d).select("vec_id", V.argmax(F.col("logits")).alias("token"))


def softmax(spark, d):
    v = _vectors(spark, d).select("vec_id", F.posexplode(V.softmax(F.col("logits"), 0.7)).alias("i", "p"))
    return v.select("vec_id", F.col("i").cast("long").alias("i"), F.round("p", 6).alias("p"))


def entropy_threshold(spark, d):
    p = _vectors(spark, d).select("vec_id", V.softmax(F.col("logits"), 0.7).alias("p"))
    return p.select("vec_id", F.round(V.entropy(F.col("p")), 6).alias("entropy"), F.round(V.typical_threshold(F.col("p"), 0.09, 0.3), 6).alias("threshold"))


def typical_mask(spark, d):
    p = _vectors(spark, d).select("vec_id", V.softmax(F.transform("logits", lambda x: x * 10), 0.7).alias("p"))
    pairs = F.transform("p", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = V.let(V.typical_threshold(F.col("p"), 0.09, 0.3), lambda t: F.filter(pairs, lambda s: s["x"] >= t))
    return p.select("vec_id", V.joined(F.transform(kept, lambda s: s["i"])).alias("kept"))


def nucleus_mask(spark, d):
    p = _vectors(spark, d).select("vec_id", V.softmax(F.transform("logits", lambda x: x * 10), 0.7).alias("p"))
    return p.select("vec_id", V.joined(F.array_sort(V.nucleus_kept(F.col("p"), 0.8))).alias("kept"))


def sample_token(spark, d):
    u = S.hashed_uniform(F.col("vec_id"), F.lit(1))
    return _vectors(spark, d).select("vec_id", S.nucleus_token(F.col("logits"), 0.7, 0.8, u).alias("nucleus"), S.typical_token(F.col("logits"), 0.7, 0.09, 0.3, u).alias("typical"))


def _candidates(spark, d):
    nodes = B.tree_nodes(spark, TREE)
    tokens = S.tree_candidates(S.flat_candidates(_scores(spark, d)), nodes)
    return nodes, S.cartesian_candidates(tokens, B.tree_paths(nodes))


def candidates_cart(spark, d):
    _, c = _candidates(spark, d)
    return c.select("request_id", "path_id", V.joined(F.col("candidate")).alias("candidate"))


def _accepted(spark, d, kind):
    nodes, c = _candidates(spark, d)
    logits = _node_logits(spark, d, c.select("request_id").distinct(), nodes)
    return S.evaluate_posterior(c, logits, temperature=0.0 if kind == "greedy" else 0.7, sampling=kind)


def accept_greedy(spark, d):
    return _accepted(spark, d, "greedy").select("request_id", "best", "accept_length", V.joined(F.col("candidate")).alias("candidate"))


def accept_typical(spark, d):
    return _accepted(spark, d, "typical").select("request_id", "best", "accept_length", V.joined(F.col("candidate")).alias("candidate"))


def accept_nucleus(spark, d):
    return _accepted(spark, d, "nucleus").select("request_id", "best", "accept_length")


def accept_message(spark, d):
    m = S.accept_message(_accepted(spark, d, "greedy"), F.col("request_id"))
    return m.select("request_id", "n", V.joined(F.col("select")).alias("select"), V.joined(F.col("ids")).alias("ids"))


#: Rows that a partition of a sorted table is to have, about: with several sorts in a stage some 100 MB of a task.
PART_ROWS = 250_000


def _kv(spark, d):
    """The lines of orders in their order, dealt by order over as many partitions as keep a task's sorts small: what
    follows groups, joins and sorts by order in these."""
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), "l_linenumber", F.col("l_partkey").alias("value"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART_ROWS))  # a count of Parquet reads footers alone
    line = F.row_number().over(Window.partitionBy("request_id").orderBy("l_linenumber", "value"))
    return rows.repartition(n, "request_id").select("request_id", line.cast("long").alias("line"), "value")


def kv_append(spark, d):
    w = _kv(spark, d)
    old = w.where("line <= 2").select("request_id", (F.col("line") - 1).alias("pos"), "value")
    return K.append(old, w.where("line > 2").select("request_id", F.col("line").alias("i"), "value"), ["request_id"])


def kv_compact(spark, d):
    w = _kv(spark, d).select("request_id", (F.col("line") - 1).alias("pos"), "value")
    a = w.where("pos = 3").select("request_id", F.lit(1).cast("long").alias("prev_len"), F.array(F.lit(1), F.lit(3)).cast("array<bigint>").alias("select"))
    return K.compact(w, a, ["request_id"])


def shared_prefix_union(spark, d):
    w = _kv(spark, d)
    shared = w.where("line <= 2").select("request_id", (F.col("line") - 1).alias("pos"), "value")
    branch = w.where("line > 2").select("request_id", (F.col("line") % 2).alias("branch_id"), F.floor((F.col("line") - 3) / 2).alias("pos"), "value")
    return K.with_shared_prefix(shared, branch, branch.select("request_id", "branch_id").distinct())


def round_robin(spark, d):
    b = _kv(spark, d).select("request_id", F.col("line").alias("branch_id"))
    return K.round_robin(b, 10)


def beam_reorder(spark, d):
    w = _kv(spark, d).select((F.col("line") - 1).alias("beam"), "request_id", "value")
    beams = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "beam long, source long")
    return K.reorder(w, beams)


def eos_stop(spark, d):
    return _ids(spark, d).select("request_id", K.stop_at(F.col("ids"), F.lit(5), 11).alias("stops"), F.size(F.slice("ids", F.lit(3), F.size("ids"))).cast("long").alias("n_trimmed"))


def causal_attention(spark, d):
    v = _vectors(spark, d)
    q = v.select(F.floor(F.col("vec_id") / 8).alias("request_id"), (F.col("vec_id") % 8).alias("pos"), F.slice("logits", 1, 24).alias("q"))
    k = v.select(F.floor(F.col("vec_id") / 8).alias("request_id"), (F.col("vec_id") % 8).alias("pos"), F.slice("logits", 25, 24).alias("k"), F.slice("logits", 49, 16).alias("v"))
    out = M.causal_attention(q, k, 24, ["request_id"]).select("request_id", "pos", F.posexplode("out").alias("i", "x"))
    return out.select("request_id", "pos", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def gqa_repeat(spark, d):
    kv = _vectors(spark, d).select((F.col("vec_id") % 8).alias("head"), F.floor(F.col("vec_id") / 8).alias("pos"), F.col("vec_id").alias("v"))
    return M.repeated_heads(kv, 4).select("head", "kv_head", "pos", "v")


def _elements(df, c):
    out = df.select("vec_id", F.posexplode(c).alias("i", "x"))
    return out.select("vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def rmsnorm(spark, d):
    return _elements(_vectors(spark, d), V.rms_norm(F.col("logits")))


def rope(spark, d):
    return _elements(_vectors(spark, d), V.rope(F.col("logits"), F.col("vec_id") % 17, 64))


def silu(spark, d):
    return _elements(_vectors(spark, d), F.transform("logits", V.silu))


def cross_entropy(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", F.round(M.cross_entropy(V.doubles(F.col("embedding")), F.col("label")), 6).alias("loss"))


def shifted_loss(spark, d):
    e = _read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("request_id"), (F.col("vec_id") % 10).alias("pos"), V.doubles(F.col("embedding")).alias("logits"), "label")
    return M.shifted_cross_entropy(e, "request_id").select("request_id", F.round("loss", 6).alias("loss"))


def mse(spark, d):
    e = _read(spark, d, "embeddings")
    return e.groupBy("label").agg(F.round(F.avg(M.mean_square(V.doubles(F.col("embedding")), F.col("label").cast("double"))), 6).alias("loss"))


def bce_logits(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", F.get("embedding", 0).cast("double").alias("x"), (F.col("label") % 2).cast("double").alias("y"))
    return e.select("vec_id", F.round(M.bce_with_logits(F.col("x"), F.col("y")), 6).alias("loss"))


def last_nonpad_pool(spark, d):
    return _ids(spark, d).select("request_id", M.last_nonpad(F.col("ids"), 12).alias("pos"))


def unpad(spark, d):
    kept = _ids(spark, d).select("request_id", M.unpadded(F.col("ids"), F.transform("ids", lambda x: F.when(x > 3, 1).otherwise(0))).alias("kept"))
    return kept.select("request_id", F.size("kept").cast("long").alias("n"), V.joined(F.col("kept")).alias("kept"))


def padded_causal_visible(spark, d):
    return M.padded_visible(_words(spark, d).select("request_id", "pos", F.when(F.col("token_id") > 3, 1).otherwise(0).alias("mask")), "request_id")


def sliced_linear(spark, d):
    weights = [[((i * 7 + j * 3) % 11 - 5) / 8 for j in range(64)] for i in range(4)]
    return _elements(_vectors(spark, d), M.sliced_linear(F.col("logits"), weights, 4))


def rope_linear(spark, d):
    return _elements(_vectors(spark, d), V.rope(F.col("logits"), F.col("vec_id") % 17, 64, factor=4.0))


def rope_ntk(spark, d):
    return _elements(_vectors(spark, d), V.rope(F.col("logits"), F.col("vec_id") % 17, 64, factor=2.0, max_length=2048, length=4096))


def loss_by_problem_type(spark, d):
    e = _read(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("x"), "label")
    bits = F.transform("x", lambda x, i: ((F.col("label") + i) % 2).cast("double"))
    kinds = {M.problem_type(1, False): F.col("label").cast("double"), M.problem_type(10, True): F.col("label"), M.problem_type(10, False): bits}
    return e.select("vec_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.round(M.loss(k, F.col("x"), y), 6).alias("loss")) for k, y in kinds.items()])))


def stage_checkpoint(spark, d):
    """Stage tables written, and the third stage read back."""
    path = _folder(spark, "stages")
    write_stages(_manifest(spark).withColumn("file", F.lit("f")), spark.createDataFrame(STAGES, "rank long, n_layers long"), path)
    return read_stage(spark, path, 2).select("tensor_name", "stage_name")


def prompt_source(spark, d):
    return prompts(_read(spark, d, "conversations"))


def position_ids_from_mask(spark, d):
    w = _ids(spark, d).select("request_id", F.transform("ids", lambda x: F.when(x > 3, 1).otherwise(0)).alias("mask"))
    return w.select("request_id", F.inline(M.position_rows(F.col("mask"))))


def _weights(rows, columns, turn=0):
    return [[((i * 7 + j * 3 + turn) % 11 - 5) / 8 for j in range(columns)] for i in range(rows)]


def gated_layer(spark, d):
    return _elements(_vectors(spark, d), M.gated(F.col("logits"), _weights(8, 64), _weights(8, 64, 4), _weights(4, 8)))


def residual_head(spark, d):
    """A head: a residual block of 64 elements and a linear map to 4."""
    return _elements(_vectors(spark, d), V.let(M.residual(F.col("logits"), _weights(64, 64), 0.5), lambda x: M.linear(x, _weights(4, 64, 2))))


def cumulative_lengths(spark, d):
    lengths = _ids(spark, d).select(F.floor(F.col("request_id") / 100).alias("batch"), "request_id", F.size(F.filter("ids", lambda x: x > 3)).alias("length"))
    return M.cumulative_lengths(lengths, "batch", "request_id")


def token_embedding(spark, d):
    """The embedding rows of each document's tokens, added up."""
    table = _vectors(spark, d).select(F.col("vec_id").alias("token_id"), V.total(F.col("logits")).alias("x"))
    return M.embedded(_words(spark, d), table).groupBy("request_id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("x"))


def generation_inputs(spark, d):
    r = _ids(spark, d).withColumn("mask", F.transform("ids", lambda x: F.when(x > 3, 1).otherwise(0)))
    return r.select("request_id", F.inline(M.next_inputs(F.col("ids"), F.col("mask"), True)))


def last_position(spark, d):
    return _words(spark, d).groupBy("request_id").agg(F.max_by("token_id", "pos").alias("token_id"))


def continuation(spark, d):
    return _ids(spark, d).select("request_id", V.joined(K.continuation(F.col("ids"), F.lit(5))).alias("ids"))


def pad_path(spark, d):
    return B.tree_nodes(spark, TREE).select("node_id", V.joined(V.pad_path(F.col("path"), 6)).alias("path"))


def update_inputs(spark, d):
    nodes, c = _candidates(spark, d)
    requests = c.select("request_id").distinct()
    logits = _node_logits(spark, d, requests, nodes)
    old = requests.select("request_id", F.array("request_id", F.col("request_id") + 1).alias("ids"), F.lit(7).cast("long").alias("new_token"))
    out = S.updated(old, S.evaluate_posterior(c, logits, temperature=0.0), logits)
    return out.select("request_id", V.joined(F.col("ids")).alias("ids"), "new_token", V.argmax(F.col("logits")).alias("next"))


def kv_allocate(spark, d):
    return K.allocate(_read(spark, d, "orders").select(F.col("o_orderkey").alias("request_id")), 2, 2048)


def kv_valid(spark, d):
    """The rows before each key's length, which leaves its last row out."""
    w = _kv(spark, d).select("request_id", (F.col("line") - 1).alias("pos"), "value")
    return K.valid(w, K.lengths(w, ["request_id"]).withColumn("length", F.col("length") - 1), ["request_id"])


def kv_reset(spark, d):
    w = _kv(spark, d).select("request_id", (F.col("line") - 1).alias("pos"), "value")
    return K.reset(w, w.where("pos = 3").select("request_id"), ["request_id"])


def role_pruning(spark, d):
    stages = spark.createDataFrame(STAGES, "rank long, n_layers long")
    return L.pruned(L.staged(_manifest(spark), stages), len(STAGES)).select("rank", "tensor_name")


def queue_places(spark, d):
    """All events as one stream, run until it has taken what is there; its sink read back."""
    events, path = _read(spark, d, "events"), _folder(spark, "queue")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parque[t]")  # a pattern, as a path of its own would have to be a folder
    run = queue(stream).writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start(f"{path}/places")
    run.awaitTermination()
    return spark.read.parquet(f"{path}/places")


def config_source(spark, d):
    """A configuration written as JSON, and read."""
    path = _folder(spark, "config")
    text = '{\n "hidden_size": 4096,\n "stages": [8, 8, 8, 8],\n "temperature": 0.7,\n "sampling": "typical"\n}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return read_config(spark, path).select("hidden_size", F.array_join(F.col("stages").cast("array<string>"), ",").alias("stages"), "temperature", "sampling")


def index_source(spark, d):
    """A checkpoint's index written as JSON, and read as a manifest."""
    path = _folder(spark, "index")
    entry = F.map_from_entries(F.array_sort(F.collect_list(F.struct("tensor_name", F.concat(F.lit("part-"), F.length("tensor_name").cast("string"))))))
    _manifest(spark).agg(F.to_json(F.struct(entry.alias("weight_map"))).alias("value")).write.text(path)
    return read_index(spark, path)


def checkpoint_union(spark, d):
    """Tensors of two base folders' files and of a head under its prefix."""
    path = _folder(spark, "checkpoint")
    v = _read(spark, d, "embeddings").select(F.concat(F.lit("t."), F.col("vec_id").cast("string")).alias("tensor_name"), F.size("embedding").alias("n"), "label")
    v.where("label < 5").select("tensor_name", "n").write.parquet(f"{path}/base")
    v.where("label >= 5").select("tensor_name", "n").write.mode("append").parquet(f"{path}/base")
    v.where("label = 3").select("tensor_name", (F.col("n") + 1).alias("n")).write.parquet(f"{path}/head")
    return read_checkpoint(spark, f"{path}/base", f"{path}/head").select("tensor_name", F.col("n").cast("long").alias("n"))


def mask_dump(spark, d):
    """The tree's mask written, and read back."""
    path = _folder(spark, "mask")
    tree_mask_semijoin(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def memory_figures(spark, d):
    e = _read(spark, d, "embeddings").select(F.size("embedding").cast("long").alias("n_elements"), F.lit(4).cast("long").alias("element_size"))
    return tensor_bytes(e)


def answer_output(spark, d):
    """Each conversation's turns, one line a turn."""
    c = _read(spark, d, "conversations")
    return outputs(c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("branch_id"), F.concat("role", F.lit(": ")).alias("point"), F.coalesce("text", F.lit("")).alias("continuation")))


def stage_files(spark, d):
    s = spark.createDataFrame(STAGES, "rank long, n_layers long")
    return s.select("rank", T.stage_file(T.model_type(F.lit("models/vicuna_7b-v1")), F.lit(len(STAGES)), F.col("rank")).alias("path"))


def encode_decode(spark, d):
    """Every text as token ids and back."""
    t = _tokenizer(spark)
    return _read(spark, d, "documents").select("doc_id", t.decode(t.encode(F.col("text")), skip=(t.start,)).alias("decoded"))


def encode_parts(spark, d):
    """Prompts of points as ids of the shared part and ids of the point, and back to text."""
    c, t = _read(spark, d, "conversations"), _tokenizer(spark)
    points = c.where("turn = 1").select("conv_id", F.posexplode(F.split("text", "\n")).alias("idx", "line")).select("conv_id", F.col("idx").cast("long").alias("idx"), T.point_prompt(F.col("idx"), F.col("line")).alias("point"))
    rows = shared_prefix(spark, d).join(points, "conv_id").select("conv_id", "idx", t.encode_parts(F.col("prompt"), F.col("point")).alias("ids"))
    return rows.select("conv_id", "idx", F.size(F.filter("ids", lambda x: x == t.start)).cast("long").alias("n_start"), t.decode(F.col("ids"), skip=(t.start,)).alias("prompt"))


def _turns(spark, d):
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return _read(spark, d, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("branch_id"), F.transform(words, lambda w: F.length(w) % 64).alias("ids"))


def prefill(spark, d):
    return prefill_requests(_turns(spark, d))


def decode_typical(spark, d):
    """The decoding loop as it is shipped: temperature 0.7, typical acceptance by the threshold."""
    return decode_requests(_turns(spark, d), TREE, how=Acceptance(0.7))


def decode_loop(spark, d):
    return decode_requests(_turns(spark, d), TREE)


FUNCTIONS = (skeleton_prompt, outline_points, point_prompts, shared_prefix, skeleton_normalised, tree_dispatch, slice_sequences, stage_range_join, layer_split, manifest_last_wins, tree_nodes, tree_ancestors, tree_paths, depth_histogram, tree_mask_semijoin, topk_per_head, argmax_token, softmax, entropy_threshold, typical_mask, nucleus_mask, sample_token, candidates_cart, accept_greedy, accept_typical, accept_nucleus, accept_message, kv_append, kv_compact, shared_prefix_union, round_robin, beam_reorder, eos_stop, causal_attention, gqa_repeat, rmsnorm, rope, silu, cross_entropy, shifted_loss, mse, bce_logits, last_nonpad_pool, position_ids_from_mask, unpad, padded_causal_visible, sliced_linear, rope_linear, rope_ntk, loss_by_problem_type, stage_checkpoint, prompt_source, gated_layer, residual_head, cumulative_lengths, token_embedding, generation_inputs, last_position, continuation, pad_path, update_inputs, kv_allocate, kv_valid, kv_reset, role_pruning, queue_places, config_source, index_source, checkpoint_union, mask_dump, memory_figures, answer_output, stage_files, encode_decode, encode_parts, prefill, decode_typical, decode_loop)
QUERIES = {f.__name__: f for f in FUNCTIONS}

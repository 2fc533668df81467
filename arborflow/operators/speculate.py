"""Speculative decoding: candidates through a tree, acceptance and the message to the other stages.

Trees have at most a few hundred nodes, a bound of their format, so they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .tree import TOP_K


def base_token(logits: Column, temperature: float = 0.0, sampling: str = "typical", fast: bool = False, top_p: float = 0.8, threshold: float = 0.09, alpha: float = 0.3, u: Column | None = None) -> Column:
    """The base model's token: the argmax at temperature 0 or if fast, else drawn at u from the nucleus or the typical set."""
    if temperature == 0 or fast:
        return V.argmax(logits)
    if sampling == "typical":
        return typical_token(logits, temperature, threshold, alpha, u)
    if sampling == "nucleus":
        return nucleus_token(logits, temperature, top_p, u)
    raise ValueError(f"sampling must be typical or nucleus, not {sampling}")


def flat_candidates(scores: DataFrame, base: Column | None = None) -> DataFrame:
    """scores: (request_id, head, logits), head 0 the base model.  flat: the base's token (by default its argmax), then each
    head's top 10."""
    base = V.argmax(F.col("logits")) if base is None else base
    top = F.when(F.col("head") == 0, F.array(base)).otherwise(V.top_k(F.col("logits"), TOP_K))
    picked = scores.select("request_id", "head", top.alias("top"))
    rows = picked.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("head", "top"))).alias("heads"))  # a row a head
    return rows.select("request_id", F.flatten(F.transform("heads", lambda s: s["top"])).alias("flat"))


def tree_candidates(flat: DataFrame, nodes: DataFrame) -> DataFrame:
    """(request_id, tokens): the token of each tree node, in node order."""
    index = nodes.agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "tree_index"))), lambda s: s["tree_index"]).alias("at"))
    return flat.crossJoin(F.broadcast(index)).select("request_id", F.transform("at", lambda i: F.get("flat", i.cast("int"))).alias("tokens"))  # one row


def cartesian_candidates(tokens: DataFrame, paths: DataFrame) -> DataFrame:
    """(request_id, path_id, nodes, candidate): the tokens of each path; a pad reads 0."""
    pick = F.transform("nodes", lambda n: F.when(n < 0, F.lit(0).cast("long")).otherwise(F.get("tokens", n.cast("int"))))
    return tokens.crossJoin(F.broadcast(paths)).select("request_id", "path_id", "nodes", pick.alias("candidate"))  # paths are the tree's leaves


def _steps(candidates: DataFrame, node_values: DataFrame) -> DataFrame:
    """candidates with values: node_values' column ``value`` by node, collected over a tree's nodes."""
    by_node = node_values.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda s: s["value"]).alias("values"))
    return candidates.join(by_node, "request_id")


def _at(node: Column) -> Column:
    """The row of values that a path's node reads; a pad reads the last node's."""
    return F.when(node < 0, F.size("values") - 1).otherwise(node.cast("int"))


def _positions() -> Column:
    return F.sequence(F.lit(0), F.size("candidate") - 2)


def accept(judged: DataFrame, strict_pad: bool = False, by_likelihood: bool = False) -> DataFrame:
    """judged: (request_id, path_id, nodes, candidate, mask[, logp]).  The path with the longest accepted prefix; ties
    go to the larger likelihood of that prefix if asked for, then to the smaller path_id; path 0 if none is accepted.
    A pad may be accepted as token 0, unless strict_pad."""
    mask = F.zip_with("mask", F.slice("nodes", 2, F.size("nodes") - 1), lambda m, n: m & (n >= 0)) if strict_pad else F.col("mask")
    rows = judged.withColumn("n", V.prefix_length(mask))
    like = V.total(F.transform(F.expr("slice(logp, 1, cast(n AS int))"), lambda x: x)) if by_likelihood else F.lit(0.0)
    rows = rows.withColumn("like", F.when(F.col("n") > 0, like).otherwise(0.0))
    best = F.max_by(F.struct("path_id", "n", "nodes", "candidate"), F.struct("n", "like", (-F.col("path_id")).alias("p")))
    out = rows.groupBy("request_id").agg(best.alias("b"))
    return out.select("request_id", F.col("b.path_id").alias("best"), F.col("b.n").alias("accept_length"), F.col("b.nodes").alias("nodes"), F.col("b.candidate").alias("candidate"))


def judge_greedy(candidates: DataFrame, node_logits: DataFrame) -> DataFrame:
    """A token is accepted if it is the argmax of its parent's logits.  node_logits: (request_id, node_id, logits)."""
    rows = _steps(candidates, node_logits.select("request_id", "node_id", V.argmax(F.col("logits")).alias("value")))
    hit = F.transform(_positions(), lambda i: F.get("candidate", i + 1) == F.get("values", _at(F.get("nodes", i))))
    return rows.select("request_id", "path_id", "nodes", "candidate", hit.alias("mask"))


def judge_typical(candidates: DataFrame, node_logits: DataFrame, temperature: float = 0.7, threshold: float = 0.09, alpha: float = 0.3) -> DataFrame:
    """A token is accepted if its probability is above min(threshold, alpha * exp(-entropy)) of its parent's."""
    p = node_logits.select("request_id", "node_id", V.softmax(F.col("logits"), temperature).alias("p"))
    value = p.select("request_id", "node_id", F.struct("p", V.typical_threshold(F.col("p"), threshold, alpha).alias("t")).alias("value"))
    rows = _steps(candidates, value)
    got = F.transform(_positions(), lambda i: F.struct(F.get(F.get("values", _at(F.get("nodes", i)))["p"], F.get("candidate", i + 1).cast("int")).alias("p"), F.get("values", _at(F.get("nodes", i)))["t"].alias("t")))
    rows = rows.select("request_id", "path_id", "nodes", "candidate", got.alias("got"))
    return rows.select("request_id", "path_id", "nodes", "candidate", F.transform("got", lambda s: s["p"] > s["t"]).alias("mask"), F.transform("got", lambda s: F.ln(s["p"])).alias("logp"))


def drawn(p: Column, u: Column) -> Column:
    """Index drawn from weights p by inverse cumulative sums at u in [0, 1)."""
    def at(goal):
        step = lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.when(a["sum"] + x <= goal, a["n"] + 1).otherwise(a["n"]).alias("n"))
        return F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), step, lambda a: a["n"])

    return F.least(V.let(u * V.total(p), at), F.size(p) - 1).cast("long")


def hashed_uniform(*key: Column) -> Column:
    """In [0, 1), decided by the key: a retried task draws the same.  The first 32 bits of an MD5, so SQL can draw it too."""
    digest = F.md5(F.concat_ws(",", *[k.cast("string") if not isinstance(k, str) else F.col(k).cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def nucleus_weights(logits: Column, temperature: float, top_p: float) -> Column:
    """Probabilities of the nucleus, in place; 0 elsewhere."""
    if top_p >= 1:
        return V.softmax(logits, temperature)
    rest = lambda p: V.let(V.nucleus_last(p, top_p), lambda last: F.transform(p, lambda x, i: F.when(F.struct((-x).alias("x"), i.cast("long").alias("i")) <= last, x).otherwise(0.0)))
    return V.let(V.softmax(logits, temperature), rest)


def typical_weights(logits: Column, temperature: float, threshold: float, alpha: float) -> Column:
    """Probabilities that reach the typical threshold (ties stay), in place; 0 elsewhere."""
    rest = lambda p: V.let(V.typical_threshold(p, threshold, alpha), lambda t: F.transform(p, lambda x: F.when(x < t, 0.0).otherwise(x)))
    return V.let(V.softmax(logits, temperature), rest)


def nucleus_token(logits: Column, temperature: float, top_p: float, u: Column) -> Column:
    """A token drawn from the nucleus."""
    return V.let(nucleus_weights(logits, temperature, top_p), lambda w: drawn(w, u))


def typical_token(logits: Column, temperature: float, threshold: float, alpha: float, u: Column) -> Column:
    """A token drawn from those that reach the typical threshold."""
    return V.let(typical_weights(logits, temperature, threshold, alpha), lambda w: drawn(w, u))


def judge_sampled(candidates: DataFrame, node_logits: DataFrame, sampling: str = "nucleus", temperature: float = 0.7, top_p: float = 0.8, threshold: float = 0.09, alpha: float = 0.3, seed: int = 0) -> DataFrame:
    """A token is accepted if it is the one drawn at its place in the path (nucleus, or typical)."""
    weights = nucleus_weights(F.col("logits"), temperature, top_p) if sampling == "nucleus" else typical_weights(F.col("logits"), temperature, threshold, alpha)
    rows = _steps(candidates, node_logits.select("request_id", "node_id", weights.alias("value")))
    def hit(i):
        u = hashed_uniform("request_id", "path_id", i, F.lit(seed))
        return V.let(F.get("values", _at(F.get("nodes", i))), lambda w: drawn(w, u)) == F.get("candidate", i + 1)

    return rows.select("request_id", "path_id", "nodes", "candidate", F.transform(_positions(), hit).alias("mask"))


def evaluate_posterior(candidates: DataFrame, node_logits: DataFrame, temperature: float = 0.7, sampling: str = "typical", fast: bool = True, top_p: float = 0.8, threshold: float = 0.09, alpha: float = 0.3, seed: int = 0) -> DataFrame:
    """The accepted path of each request: greedy at temperature 0, else typical (fast: by the threshold alone, ties by
    likelihood; otherwise by draws) or nucleus."""
    if temperature == 0:
        return accept(judge_greedy(candidates, node_logits))
    if sampling == "typical" and fast:
        return accept(judge_typical(candidates, node_logits, temperature, threshold, alpha), by_likelihood=True)
    if sampling in ("typical", "nucleus"):
        return accept(judge_sampled(candidates, node_logits, sampling, temperature, top_p, threshold, alpha, seed))
    raise ValueError(f"sampling must be typical or nucleus, not {sampling}")


def accept_message(accepted: DataFrame, previous: Column) -> DataFrame:
    """n, select (cache rows to keep) and ids (accepted tokens): accept_length + 1 of each."""
    n = F.col("accept_length") + 1
    first = lambda c: F.expr(f"slice({c}, 1, cast(accept_length + 1 AS int))")
    return accepted.select("request_id", "best", n.alias("n"), F.transform(first("nodes"), lambda x: x + previous).alias("select"), first("candidate").alias("ids"))


def updated(requests: DataFrame, accepted: DataFrame, node_logits: DataFrame) -> DataFrame:
    """requests: (request_id, ids, new_token) after a step: ids with the accepted tokens behind them, the counter of new
    tokens, and as logits those of the last accepted node, from which the next step goes on; a pad reads the last
    node's."""
    last = node_logits.groupBy("request_id").agg(F.max("node_id").alias("last"))
    node = F.get("nodes", F.col("accept_length").cast("int"))
    rows = accepted.join(last, "request_id").withColumn("node_id", F.when(node < 0, F.col("last")).otherwise(node))
    rows = requests.join(rows, "request_id").join(node_logits, ["request_id", "node_id"])
    taken = F.expr("slice(candidate, 1, cast(accept_length + 1 AS int))")
    return rows.select("request_id", F.concat("ids", taken).alias("ids"), (F.col("new_token") + F.col("accept_length") + 1).alias("new_token"), "logits")

"""Attention as joins, position ids, losses and pooling, for short sequences; long ones are taken in blocks (blocks.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def dot(a: Column, b: Column) -> Column:
    return V.total(F.zip_with(a, b, lambda x, y: x * y))


def causal_attention(q: DataFrame, k: DataFrame, size: int, key: list[str]) -> DataFrame:
    """(key, pos, out) for q: (key, pos, q) and k: (key, pos, k, v): softmax of q.k / sqrt(size) over earlier places
    and its own, times v.  A place's pairs meet in one row, so sequences are short; blocks.block_attention() takes long ones."""
    pairs = q.join(k.withColumnRenamed("pos", "k_pos"), key).where("k_pos <= pos")
    seen = F.struct((dot(F.col("q"), F.col("k")) / F.sqrt(F.lit(float(size)))).alias("s"), "v")
    rows = pairs.groupBy(*key, "pos").agg(F.collect_list(seen).alias("seen"))
    weighted = F.transform("seen", lambda x: F.struct(F.exp(x["s"] - F.array_max(F.col("seen.s"))).alias("e"), x["v"].alias("v")))
    rows = rows.select(*key, "pos", weighted.alias("w"))
    none = F.transform(F.get("w", 0)["v"], lambda _: F.lit(0.0))
    total = F.aggregate("w", none, lambda a, x: F.zip_with(a, x["v"], lambda m, n: m + x["e"] * n))
    return rows.select(*key, "pos", V.let(V.total(F.col("w.e")), lambda t: F.transform(total, lambda x: x / t)).alias("out"))


def tree_visible(nodes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(node_id, anc_id) pairs of nodes that a node attends to: a semi-join on the closure."""
    pairs = nodes.select("node_id").crossJoin(F.broadcast(nodes.select(F.col("node_id").alias("anc_id"))))  # a tree's nodes
    return pairs.join(ancestors, ["node_id", "anc_id"], "left_semi")


def repeated_heads(kv: DataFrame, n_rep: int) -> DataFrame:
    """Each key-value head once for each of its n_rep query heads, as head."""
    turn = F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1)))
    return kv.withColumnRenamed("head", "kv_head").withColumn("_r", turn).withColumn("head", F.col("kv_head") * n_rep + F.col("_r")).drop("_r")


def position_ids(mask: DataFrame, key: str) -> DataFrame:
    """(key, pos, position_id): the running count of unmasked places less one; 1 where masked."""
    run = F.sum("mask").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return mask.select(key, "pos", F.when(F.col("mask") == 0, 1).otherwise(run - 1).cast("long").alias("position_id"))


def position_rows(mask: Column) -> Column:
    """position_ids() of a whole mask of 0 and 1, as an array of (pos, position_id): the n-th unmasked place has n, from 0,
    and masked ones have 1.  No window and no exchange."""
    at = F.sequence(F.lit(0), F.size(mask) - 1)
    some = lambda keep: F.filter(at, lambda i: (F.get(mask, i) != 0) == F.lit(keep))
    row = lambda p, n: F.struct(p.cast("long").alias("pos"), n.cast("long").alias("position_id"))
    rows = F.concat(F.transform(some(True), lambda p, n: row(p, n)), F.transform(some(False), lambda p: row(p, F.lit(1))))
    return F.when(F.size(mask) > 0, rows).otherwise(F.slice(rows, 1, 0))


def unpadded(ids: Column, mask: Column) -> Column:
    """ids without the places where mask is 0."""
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), mask.alias("m")), lambda s: s["m"] != 0), lambda s: s["i"])


def padded_visible(mask: DataFrame, key: str) -> DataFrame:
    """(key, pos, visible): how many places each place attends to under the causal and the pad mask: unmasked ones up to
    itself."""
    run = F.sum("mask").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return mask.select(key, "pos", run.cast("long").alias("visible"))


def causal_pad_mask(mask: Column) -> Column:
    """For each place the places that it attends to under the causal and the pad mask, as an array of arrays of 0 and 1: a
    place sees unmasked ones up to itself.  Quadratic in the length, as a mask is."""
    return F.transform(mask, lambda _, i: F.transform(mask, lambda m, j: F.when((j <= i) & (m != 0), 1).otherwise(0)))


def sliced_linear(v: Column, weights: list[list[float]], n_slices: int) -> Column:
    """weights v, as sums over n_slices slices of the inputs, each with its own columns of the weights."""
    width = -(-len(weights[0]) // n_slices)
    part = lambda w, k: dot(F.slice(v, k * width + 1, width), F.array(*[F.lit(float(x)) for x in w[k * width : (k + 1) * width]]))
    return F.array(*[V.total(F.array(*[part(w, k) for k in range(n_slices)])) for w in weights])


def last_nonpad(ids: Column, pad: int) -> Column:
    """0-based place before the first pad; -1 (the last place) if there is none."""
    at = F.array_position(ids, F.lit(pad))
    return F.when(at == 0, F.lit(-1)).otherwise(at - 2).cast("long")


def cross_entropy(logits: Column, label: Column) -> Column:
    return -F.ln(F.get(V.softmax(logits), label.cast("int")))


def bce_with_logits(x: Column, y: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * y + F.ln(1 + F.exp(-F.abs(x)))


def shifted_cross_entropy(tokens: DataFrame, key: str) -> DataFrame:
    """The mean loss of each sequence of (key, pos, logits, label): place n predicts the label of n + 1."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = tokens.withColumn("next", F.lead("label").over(w)).where("next IS NOT NULL")
    return rows.groupBy(key).agg(F.avg(cross_entropy(F.col("logits"), F.col("next"))).alias("loss"))


def mean_square(x: Column, y: Column) -> Column:
    """Mean over the elements of an array x of the squared distance to y."""
    return V.total(F.transform(x, lambda a: (a - y) * (a - y))) / F.size(x)


def loss(kind: str, logits: Column, label: Column) -> Column:
    """The loss of a row by problem type; label: a number, a class, or an array of 0 and 1 as long as logits."""
    if kind == "regression":
        return mean_square(logits, label)
    if kind == "single_label_classification":
        return cross_entropy(logits, label)
    if kind == "multi_label_classification":
        return V.total(F.zip_with(logits, label, bce_with_logits)) / F.size(logits)
    raise ValueError(f"unknown problem type {kind}")


def problem_type(n_labels: int, integral: bool) -> str:
    if n_labels == 1:
        return "regression"
    return "single_label_classification" if integral else "multi_label_classification"


def linear(v: Column, weights: list[list[float]]) -> Column:
    """weights v, for a small matrix of constants."""
    return F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in w])) for w in weights])


def gated(v: Column, gate: list[list[float]], up: list[list[float]], down: list[list[float]]) -> Column:
    """down(silu(gate v) * up v)."""
    return V.let(F.zip_with(F.transform(linear(v, gate), V.silu), linear(v, up), lambda a, b: a * b), lambda x: linear(x, down))


def residual(v: Column, weights: list[list[float]], bias: float = 0.0) -> Column:
    """v + silu(weights v + bias), for a square matrix."""
    return F.zip_with(v, F.transform(linear(v, weights), lambda x: V.silu(x + F.lit(float(bias)))), lambda a, b: a + b)


def cumulative_lengths(lengths: DataFrame, batch: str, row: str) -> DataFrame:
    """(batch, row, first, length): where each row's tokens begin among the batch's, pads left out.  A batch is a unit
    of computation, so its rows fit a task."""
    w = Window.partitionBy(batch).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    return lengths.select(batch, row, (F.sum("length").over(w) - F.col("length")).cast("long").alias("first"), F.col("length").cast("long").alias("length"))


#: Ids whose vectors are sent to all tasks.
FREQUENT = 1024


def embedded(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """tokens (..., token_id) with the vector of table (token_id, vector); ids that it lacks go.

    The vectors of the FREQUENT ids that most tokens have go to all tasks, so tokens of one id need not meet in one; tokens
    of other ids, of each less than one in FREQUENT of all, meet their vectors by a shuffle."""
    counts = tokens.where("token_id IS NOT NULL").groupBy("token_id").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "token_id").limit(FREQUENT + 1).collect()
    ids = [r.token_id for r in top[:FREQUENT]]
    near = tokens.join(F.broadcast(table.where(F.col("token_id").isin(ids))), "token_id")
    if len(top) <= FREQUENT:
        return near
    return near.unionByName(tokens.where(~F.col("token_id").isin(ids)).hint("merge").join(table, "token_id"))


def next_inputs(ids: Column, mask: Column, cached: bool) -> Column:
    """What a generation step reads: all ids, or the last one if what precedes it is cached, each with its position id
    (the running count of unmasked places less one, 1 where masked)."""
    run = F.transform(mask, lambda m, i: F.when(m == 0, 1).otherwise(F.aggregate(F.slice(mask, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x) - 1).cast("long"))
    rows = lambda x, p: F.struct(x.alias("token_id"), p.cast("long").alias("position_id"))
    if cached:
        count = F.aggregate(mask, F.lit(0), lambda a, x: a + x) - 1
        return F.filter(F.array(rows(F.element_at(ids, -1), F.when(F.element_at(mask, -1) == 0, 1).otherwise(count))), lambda s: s["token_id"].isNotNull())
    return F.zip_with(ids, run, rows)

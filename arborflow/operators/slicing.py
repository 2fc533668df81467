"""Slices of sequences, ranges of layers, and tables of named tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slices(tokens: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """tokens with slice_id (0-based): n nearly equal runs, the first ones longer by one.  Computed from the length
    rather than by ntile(), which would need a sort: size = length div n, remainder to the first."""
    length = tokens.groupBy(key).agg(F.count("*").alias("_len"))
    rows = tokens.join(length, key)
    q, r = F.floor(F.col("_len") / n), F.col("_len") % n
    big = r * (q + 1)
    at = F.when(F.col("pos") < big, F.floor(F.col("pos") / (q + 1))).otherwise(r + F.floor((F.col("pos") - big) / F.greatest(q, F.lit(1))))
    return rows.withColumn("slice_id", at.cast("long")).drop("_len")


def array_slices(ids: Column, n: int) -> Column:
    """The array cut into n nearly equal runs, the first ones longer by one; empty ones are left out.  No exchange."""
    q, r = F.floor(F.size(ids) / n).cast("int"), (F.size(ids) % n).cast("int")
    cut = lambda i: F.struct(i.cast("long").alias("slice_id"), (i * q + F.least(i, r)).cast("long").alias("first"), F.slice(ids, i * q + F.least(i, r) + 1, q + (i < r).cast("int")).alias("ids"))
    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cut), lambda s: F.size(s["ids"]) > 0)


def stage_bounds(stages: DataFrame) -> DataFrame:
    """stages (rank, n_layers) with left and right, the range of layers; one row a stage."""
    total = F.sum("n_layers").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return stages.withColumn("right", total).withColumn("left", F.col("right") - F.col("n_layers"))


def check_stages(stages: DataFrame, n_layers: int) -> None:
    got = stages.agg(F.sum("n_layers")).first()[0]
    if got != n_layers:
        raise ValueError(f"the stages have {got} layers; the model has {n_layers}")


def layer_of(name: Column) -> Column:
    return F.try_to_number(F.regexp_extract(name, r"layers\.(\d+)\.", 1), F.lit("999999")).cast("long")


def staged(manifest: DataFrame, stages: DataFrame) -> DataFrame:
    """Each stage's tensors: layers in its range, renumbered from 0, and all that belong to no layer."""
    bounds = F.broadcast(stage_bounds(stages))  # one row a stage
    rows = manifest.withColumn("layer", layer_of(F.col("tensor_name")))
    rows = rows.join(bounds, F.col("layer").isNull() | ((F.col("layer") >= F.col("left")) & (F.col("layer") < F.col("right"))))
    new = F.when(F.col("layer").isNull(), F.col("tensor_name")).otherwise(F.regexp_replace("tensor_name", F.lit(r"layers\.\d+\."), F.concat(F.lit("layers."), (F.col("layer") - F.col("left")).cast("string"), F.lit("."))))
    return rows.select("rank", "tensor_name", new.alias("stage_name"), *[c for c in manifest.columns if c != "tensor_name"])


def last_wins(*manifests: DataFrame) -> DataFrame:
    """The union of (tensor_name, file, ...); of a repeated name the last manifest's row stays, there the last file's."""
    rows = None
    for i, m in enumerate(manifests):
        m = m.withColumn("_turn", F.lit(i))
        rows = m if rows is None else rows.unionByName(m)
    cols = [c for c in manifests[0].columns if c != "tensor_name"]
    return rows.groupBy("tensor_name").agg(F.max_by(F.struct(*cols), F.struct("_turn", "file")).alias("_r")).select("tensor_name", "_r.*")


def with_prefix(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.withColumn("tensor_name", F.concat(F.lit(prefix), "tensor_name"))


def pruned(stages: DataFrame, n_stages: int) -> DataFrame:
    """A stage's tensors that its role needs: the embedding on the first stage, norm and all heads on the last, layers
    on their own."""
    name, rank = F.col("tensor_name"), F.col("rank")
    first, last = name.contains("embed_tokens"), name.rlike(r"^(model\.norm|lm_head|medusa_head)\.")
    return stages.where((~first | (rank == 0)) & (~last | (rank == n_stages - 1)))

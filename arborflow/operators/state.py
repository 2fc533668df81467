"""Keyed cache state: rows (key..., pos, value) of which a prefix is valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(state: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new's rows (key, i, value) written behind the state's, in the order of i."""
    length = state.groupBy(*key).agg((F.max("pos") + 1).alias("_len"))
    rows = new.join(length, key, "left").withColumn("pos", (F.coalesce("_len", F.lit(0)) + F.row_number().over(Window.partitionBy(*key).orderBy("i")) - 1).cast("long"))
    return state.unionByName(rows.select(*state.columns))


def compact(state: DataFrame, accepts: DataFrame, key: list[str]) -> DataFrame:
    """accepts: (key, prev_len, select).  Rows at select move to prev_len, prev_len + 1, ...; others from prev_len on go.
    Keys without an accept stay as they are."""
    rows = state.join(accepts, key, "left")
    at = F.array_position("select", F.col("pos"))
    pos = F.when(F.col("prev_len").isNull() | (F.col("pos") < F.col("prev_len")), F.col("pos")).when(at > 0, F.col("prev_len") + at - 1)
    return rows.withColumn("pos", pos).where("pos IS NOT NULL").select(*state.columns)


def with_shared_prefix(shared: DataFrame, branches: DataFrame, names: DataFrame) -> DataFrame:
    """The request's shared rows in front of each branch's own; names: (request_id, branch_id)."""
    length = shared.groupBy("request_id").agg((F.max("pos") + 1).alias("_len"))
    front = shared.join(names, "request_id").select("request_id", "branch_id", "pos", "value")
    back = branches.join(length, "request_id", "left").withColumn("pos", F.col("pos") + F.coalesce("_len", F.lit(0)))
    return front.unionByName(back.select("request_id", "branch_id", "pos", "value"))


def valid(state: DataFrame, lengths: DataFrame, key: list[str]) -> DataFrame:
    """Rows before each key's length."""
    return state.join(lengths, key).where(F.col("pos") < F.col("length")).select(*state.columns)


def reset(state: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return state.join(keys, key, "left_anti")


def reorder(state: DataFrame, beams: DataFrame, key: str = "beam") -> DataFrame:
    """beams: (beam, source), a row a beam, sent to all tasks, as a shuffle by beam would leave a task for each; each beam
    takes the rows of its source."""
    taken = beams.select(F.col(key).alias("_new"), F.col("source").alias(key))
    rest = [c for c in state.columns if c != key]
    return state.join(F.broadcast(taken), key).select(F.col("_new").alias(key), *rest)


def round_robin(branches: DataFrame, steps: int, key: str = "request_id") -> DataFrame:
    """(request, step, branch): step s serves branch s modulo the request's number of branches, in FIFO order."""
    seated = branches.withColumn("seat", F.row_number().over(Window.partitionBy(key).orderBy("branch_id")) - 1)
    count = branches.groupBy(key).agg(F.count("*").alias("n"))
    turn = F.explode(F.sequence(F.col("seat").cast("long"), F.lit(steps - 1).cast("long"), F.col("n")))
    return seated.join(count, key).where(F.col("seat") < steps).select(key, turn.alias("step"), "branch_id")


def stop_at(ids: Column, start: Column, eos: int) -> Column:
    """Whether eos is among the ids from start (0-based) on."""
    return F.array_contains(F.slice(ids, start + 1, F.size(ids)), F.lit(eos))


def allocate(keys: DataFrame, n_layers: int, room: int) -> DataFrame:
    """Empty state: (key..., layer, kind, length, room) for keys and values of each layer."""
    layers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_layers - 1).cast("long")))
    rows = keys.select("*", layers.alias("layer")).select("*", F.explode(F.array(F.lit("key"), F.lit("value"))).alias("kind"))
    return rows.select("*", F.lit(0).cast("long").alias("length"), F.lit(room).cast("long").alias("room"))


def lengths(state: DataFrame, key: list[str]) -> DataFrame:
    return state.groupBy(*key).agg((F.max("pos") + 1).alias("length"))


def continuation(ids: Column, start: Column) -> Column:
    """ids from start (0-based) on."""
    return F.slice(ids, start + 1, F.greatest(F.size(ids), F.lit(0)))

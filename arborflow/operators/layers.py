"""Decoder layers over tables of hidden states (key, pos, x): norms, projections, rotary positions, grouped heads, causal
attention in blocks, gated MLP, and stacks of them in stages and slices.

Dense maps run in numpy over Arrow batches, as a layer's weights are a few matrices that travel with the task (LIMIT bytes a
layer at most); attention runs in blocks, so sequences may have any length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import GROUP, block_attention

#: Bytes of a layer's weights that may travel with a task.
LIMIT = 256 << 20
STATES = "key long, pos long, x array<double>"


@dataclass(frozen=True)
class Layer:
    """Weights (outputs by inputs) of a layer, its heads, and settings."""

    q: np.ndarray
    k: np.ndarray
    v: np.ndarray
    out: np.ndarray
    gate: np.ndarray
    up: np.ndarray
    down: np.ndarray
    heads: int
    kv_heads: int
    eps: float = 1e-6
    base: float = 10000.0

    def __post_init__(self):
        mats = (self.q, self.k, self.v, self.out, self.gate, self.up, self.down)
        if sum(m.nbytes for m in mats) > LIMIT:
            raise ValueError(f"a layer's weights take at most {LIMIT} bytes here")
        if self.heads % self.kv_heads or len(self.q) % self.heads or len(self.k) != len(self.q) // self.heads * self.kv_heads or self.k.shape != self.v.shape:
            raise ValueError("heads do not fit the projections")

    @property
    def size(self) -> int:
        return len(self.q) // self.heads


def norm(x: np.ndarray, eps: float) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=1, keepdims=True) + eps)


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def rotated(x: np.ndarray, pos: np.ndarray, base: float) -> np.ndarray:
    """Heads x (rows, heads, size) turned by their positions."""
    size = x.shape[2]
    angle = pos[:, None] * base ** (-2.0 * np.arange(size // 2) / size)
    cos, sin = (np.tile(f(angle), 2)[:, None, :] for f in (np.cos, np.sin))
    half = np.concatenate([-x[:, :, size // 2 :], x[:, :, : size // 2]], axis=2)
    return x * cos + half * sin


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _projected(layer: Layer, names: str):
    """Rows (key, pos, x) as rows (key, head, pos, vectors) of each query head: q, or k and v of its group's head."""

    def f(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, h = batch.column("pos").to_numpy(), norm(_matrix(batch.column("x")), layer.eps)
            shaped = lambda w: (h @ w.T).reshape(len(h), -1, layer.size)  # noqa: B023, E731
            if names == "q":
                parts = [rotated(shaped(layer.q), pos, layer.base)]
            else:
                rep = layer.heads // layer.kv_heads
                parts = [np.repeat(x, rep, axis=1) for x in (rotated(shaped(layer.k), pos, layer.base), shaped(layer.v))]
            for head in range(layer.heads):
                yield pa.record_batch([batch.column("key"), pa.array(np.full(len(h), head)), batch.column("pos"), *(_lists(p[:, head]) for p in parts)], ["key", "head", "pos", *names])

    return f


def _finished(layer: Layer):
    """Rows (key, pos, x, a), a the heads' outputs side by side, as the layer's states."""

    def f(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _matrix(batch.column("x")) + _matrix(batch.column("a")) @ layer.out.T
            h = norm(y, layer.eps)
            z = y + (silu(h @ layer.gate.T) * (h @ layer.up.T)) @ layer.down.T
            yield pa.record_batch([batch.column("key"), batch.column("pos"), _lists(z)], ["key", "pos", "x"])

    return f


def keys_values(x: DataFrame, layer: Layer) -> DataFrame:
    """(key, head, pos, k, v) of states: what a cache holds."""
    return x.mapInArrow(_projected(layer, "kv"), "key long, head long, pos long, k array<double>, v array<double>")


def layer_states(x: DataFrame, layer: Layer, cache: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """States (key, pos, x) after a layer.  cache: keys_values() of earlier places, which x's places see as well.  Null keys
    are no sequences."""
    x = x.where("key IS NOT NULL")
    q = x.mapInArrow(_projected(layer, "q"), "key long, head long, pos long, q array<double>")
    kv = keys_values(x, layer)
    kv = kv if cache is None else cache.unionByName(kv)
    name = (F.col("key") * layer.heads + F.col("head")).alias("key")
    out = block_attention(q.select(name, "pos", "q"), kv.select(name, "pos", "k", "v"), layer.size, group)
    heads = out.select(F.floor(F.col("key") / layer.heads).alias("key"), (F.col("key") % layer.heads).alias("head"), "pos", "out")
    one = heads.groupBy("key", "pos").agg(F.array_sort(F.collect_list(F.struct("head", "out"))).alias("h"))
    joined = x.join(one.select("key", "pos", F.flatten(F.transform("h", lambda s: s["out"])).alias("a")), ["key", "pos"])
    return joined.select("key", "pos", F.col("x").cast("array<double>").alias("x"), "a").mapInArrow(_finished(layer), STATES)


def stack(x: DataFrame, stages: list[list[Layer]], keep: Callable[[DataFrame], DataFrame], group: int = GROUP) -> DataFrame:
    """States after all layers of all stages.  keep writes a stage's states and reads them, as the next stage does."""
    for layers in stages:
        for layer in layers:
            x = layer_states(x, layer, group=group)
        x = keep(x)
    return x


def sliced_prefill(x: DataFrame, layers: list[Layer], n_slices: int, keep: Callable[[DataFrame], DataFrame], group: int = GROUP) -> DataFrame:
    """States after layers, sequence by sequence in n_slices near-equal slices of places, each seeing the caches that those
    before it have left: the same as all at once."""
    n = F.col("n")
    # the first n % n_slices slices have a place more
    most, more = F.floor(n / n_slices), n % n_slices
    cut = F.when(F.col("i") < more * (most + 1), F.floor(F.col("i") / (most + 1))).otherwise(more + F.floor((F.col("i") - more * (most + 1)) / F.greatest(most, F.lit(1))))
    lengths = x.groupBy("key").agg((F.max("pos") + 1).alias("n"))
    x = keep(x.join(lengths, "key").withColumn("i", F.col("pos")).select("key", "pos", "x", cut.cast("int").alias("slice")))
    caches: list[DataFrame | None] = [None] * len(layers)
    done = None
    for s in range(n_slices):
        state = x.where(F.col("slice") == s).select("key", "pos", "x")
        for i, layer in enumerate(layers):
            own = keys_values(state, layer)
            after = keep(layer_states(state, layer, caches[i], group))
            caches[i] = keep(own if caches[i] is None else caches[i].unionByName(own))
            state = after
        done = state if done is None else done.union(state)
    return done


def next_tokens(x: DataFrame, head: np.ndarray, eps: float = 1e-6) -> DataFrame:
    """(key, pos, token): the argmax of the head's logits at the last place of each sequence, the lowest of equal ones."""

    def f(batches):
        for batch in batches:
            if batch.num_rows:
                token = (norm(_matrix(batch.column("x")), eps) @ head.T).argmax(axis=1)
                yield pa.record_batch([batch.column("key"), batch.column("pos"), pa.array(token)], ["key", "pos", "token"])

    last = x.groupBy("key").agg(F.max(F.struct("pos", "x")).alias("r")).select("key", "r.pos", "r.x")
    return last.mapInArrow(f, "key long, pos long, token long")

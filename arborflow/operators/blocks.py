"""Products of two tables of vectors, block by block: attention by mergeable partial results, and the largest entries of a
matrix product.

Rows are packed into blocks of GROUP vectors.  A *cell* is a block of the left table with up to SPAN blocks of the right
one; it makes one partial result a left row.  Partial results of a left block are merged FAN at a time, level by level,
as their merge is associative, so no task holds more than FAN of them.  What moves are blocks: a right block goes to the
cells of the left blocks it meets, and no pair of rows is ever a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP, SPAN, FAN = 4096, 16, 16
#: Left rows and right rows of a product that is held at once.
TILE = 1024


def _matrix(column, width: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _packed(names: list[str], n_ids: int):
    """A block's rows as a row: ids (int64) and the vectors (float64), the rows in the order of ids."""

    def f(table: pa.Table) -> pa.Table:
        ids = np.stack([table.column(c).to_numpy() for c in table.column_names[2 : 2 + n_ids]], axis=1).astype(np.int64)
        order = np.lexsort(ids.T[::-1])
        out = {"key": table.column("key")[:1].combine_chunks(), "block": table.column("block")[:1].combine_chunks(), "ids": pa.array([ids[order].tobytes()], pa.binary())}
        for c in names:
            column = table.column(c)
            width = len(column[0].values)
            out[c] = pa.array([_matrix(column, width)[order].tobytes()], pa.binary())
        return pa.table(out)

    return f


def _blocks(rows: DataFrame, names: list[str], ids: list[str]) -> DataFrame:
    """rows: (key, block, ids..., vectors...) with vectors of one width."""
    ddl = "key long, block long, ids binary, " + ", ".join(f"{c} binary" for c in names)
    return rows.select("key", "block", *ids, *names).groupBy("key", "block").applyInArrow(_packed(names, len(ids)), ddl)


def _cells(left: DataFrame, right: DataFrame, causal: bool, pair, ddl: str) -> DataFrame:
    """pair(left block, right blocks) for each cell: rows (key, block, chunk, ...)."""
    last_right = right.groupBy("key").agg(F.max("block").alias("last"))
    last_left = left.groupBy("key").agg(F.max("block").alias("last"))
    zero = F.lit(0).cast("long")
    chunks = F.explode(F.sequence(zero, F.floor((F.least("block", "last") if causal else F.col("last")) / SPAN))).alias("chunk")
    to = F.explode(F.sequence(F.col("block") if causal else zero, F.col("last"))).alias("to")
    a = left.join(last_right.withColumnRenamed("key", "_key"), F.expr("key <=> _key"))
    b = right.join(last_left.withColumnRenamed("key", "_key"), F.expr("key <=> _key"))
    a = a.select(*left.columns, chunks)
    # right blocks behind the last left one meet none of them
    b = b.where("block <= last").select(*right.columns, to) if causal else b.select(*right.columns, to)
    b = b.withColumn("chunk", F.floor(F.col("block") / SPAN)).withColumnRenamed("block", "from")
    return a.groupBy("key", "block", "chunk").cogroup(b.groupBy("key", "to", "chunk")).applyInArrow(pair, f"key long, block long, chunk long, {ddl}")


def _merged(partial: DataFrame, merge, n_chunks: int, ddl: str) -> DataFrame:
    while n_chunks > 1:
        up = partial.withColumn("chunk", F.floor(F.col("chunk") / FAN))
        partial = up.groupBy("key", "block", "chunk").applyInArrow(merge, f"key long, block long, chunk long, {ddl}")
        n_chunks = -(-n_chunks // FAN)
    return partial


def _chunks(right: DataFrame) -> int:
    return (right.agg(F.max("block")).first()[0] or 0) // SPAN + 1


def _row(table: pa.Table, **columns) -> pa.Table:
    head = {c: table.column(c)[:1].combine_chunks() for c in ("key", "block", "chunk")}
    return pa.table(head | {c: pa.array([v.tobytes()], pa.binary()) for c, v in columns.items()})


# -- attention

_PARTIAL = "ids binary, top binary, total binary, weighted binary"


def _fold(state, top, total, weighted):
    """Softmax sums under a common maximum; the operation is associative."""
    if state is None:
        return top, total, weighted
    both = np.maximum(state[0], top)
    # a row without anything visible has -inf on both sides
    a, b = (np.exp(np.where(np.isneginf(x), -np.inf, x - np.where(np.isneginf(both), 0.0, both))) for x in (state[0], top))
    return both, state[1] * a + total * b, state[2] * a[:, None] + weighted * b[:, None]


def _attend(scale: float):
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("ids", "top", "total", "weighted")}})
        pos = np.frombuffer(left.column("ids")[0].as_buffer(), np.int64)
        q = np.frombuffer(left.column("q")[0].as_buffer()).reshape(len(pos), -1)
        parts = []
        for at in range(0, len(pos), TILE):
            state, rows, p = None, q[at : at + TILE] / scale, pos[at : at + TILE]
            for i in range(right.num_rows):
                k_pos = np.frombuffer(right.column("ids")[i].as_buffer(), np.int64)
                k = np.frombuffer(right.column("k")[i].as_buffer()).reshape(len(k_pos), -1)
                v = np.frombuffer(right.column("v")[i].as_buffer()).reshape(len(k_pos), -1)
                for j in range(0, len(k_pos), TILE):
                    s = rows @ k[j : j + TILE].T
                    s[k_pos[None, j : j + TILE] > p[:, None]] = -np.inf
                    top = s.max(axis=1)
                    e = np.exp(s - np.where(np.isneginf(top), 0.0, top)[:, None])
                    state = _fold(state, top, e.sum(axis=1), e @ v[j : j + TILE])
            parts.append(state)
        top, total, weighted = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _row(left, ids=pos, top=top, total=total, weighted=weighted)

    return pair


def _unpack(table: pa.Table, i: int):
    top = np.frombuffer(table.column("top")[i].as_buffer())
    return top, np.frombuffer(table.column("total")[i].as_buffer()), np.frombuffer(table.column("weighted")[i].as_buffer()).reshape(len(top), -1)


def _attended(table: pa.Table) -> pa.Table:
    state = None
    for i in range(table.num_rows):
        state = _fold(state, *_unpack(table, i))
    return _row(table, ids=np.frombuffer(table.column("ids")[0].as_buffer(), np.int64), top=state[0], total=state[1], weighted=state[2])


def _outputs(batches):
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for i in range(batch.num_rows):
            pos = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
            _, total, weighted = _unpack(table, i)
            seen = total > 0  # a place sees nothing if its sequence has no key up to it
            out = weighted[seen] / total[seen, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.record_batch([pa.array([batch.column("key")[i].as_py()] * len(out), pa.int64()), pa.array(pos[seen]), lists], ["key", "pos", "out"])


def block_attention(q: DataFrame, k: DataFrame, size: int, group: int = GROUP) -> DataFrame:
    """(key, pos, out) for q: (key, pos, q) and k: (key, pos, k, v): softmax of q.k / sqrt(size) over places up to its own,
    times v.  Sequences may have any length.  A sequence without keys, and places before its first one, have no row."""
    block = F.floor(F.col("pos") / group).cast("long").alias("block")
    left = _blocks(q.select(F.col("key").cast("long").alias("key"), block, F.col("pos").cast("long").alias("pos"), "q"), ["q"], ["pos"])
    right = _blocks(k.select(F.col("key").cast("long").alias("key"), block, F.col("pos").cast("long").alias("pos"), "k", "v"), ["k", "v"], ["pos"])
    partial = _cells(left, right, True, _attend(float(np.sqrt(size))), _PARTIAL)
    return _merged(partial, _attended, _chunks(right), _PARTIAL).mapInArrow(_outputs, "key long, pos long, out array<double>")


# -- the largest entries of a product

_TOPS = "ids binary, others binary, dots binary"


def _largest(others: np.ndarray, dots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest entries of each row, equal ones by their id."""
    order = np.lexsort((others, -dots), axis=1)[:, :n]
    return np.take_along_axis(others, order, 1), np.take_along_axis(dots, order, 1)


def _candidates(names: np.ndarray, s: np.ndarray, least: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n largest entries of each row of s, equal ones by their column's name; entries below least, the n-th found so far,
    are left out.  Rows with fewer are filled up with -inf."""
    many = s.shape[1] > n
    if many and (least is None or np.count_nonzero(s >= least[:, None]) > 4 * n * len(s)):  # else few are left anyway
        nth = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        least = nth if least is None else np.maximum(least, nth)
    row, column = np.nonzero(s >= least[:, None]) if least is not None else np.divmod(np.arange(s.size), max(s.shape[1], 1))
    order = np.lexsort((names[column], -s[row, column], row))
    row, column = row[order], column[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, column, rank = row[rank < n], column[rank < n], rank[rank < n]
    others, dots = np.full((len(s), n), -1, np.int64), np.full((len(s), n), -np.inf)
    others[row, rank], dots[row, rank] = names[column], s[row, column]
    return others, dots


def _multiply(n: int, slice_: int):
    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), **{c: pa.array([], pa.binary()) for c in ("ids", "others", "dots")}})
        ids = np.frombuffer(left.column("ids")[0].as_buffer(), np.int64)
        x = np.frombuffer(left.column("x")[0].as_buffer()).reshape(len(ids), -1)
        parts = []
        for at in range(0, len(ids), TILE):
            others, dots = np.zeros((len(ids[at : at + TILE]), 0), np.int64), np.zeros((len(ids[at : at + TILE]), 0))
            for i in range(right.num_rows):
                names = np.frombuffer(right.column("ids")[i].as_buffer(), np.int64)
                y = np.frombuffer(right.column("x")[i].as_buffer()).reshape(len(names), -1)
                for j in range(0, len(names), TILE):
                    s = sum(x[at : at + TILE, a : a + slice_] @ y[j : j + TILE, a : a + slice_].T for a in range(0, x.shape[1], slice_))
                    some, s = _candidates(names[j : j + TILE], s, dots[:, -1] if dots.shape[1] == n else None, n)
                    others, dots = _largest(np.concatenate([others, some], axis=1), np.concatenate([dots, s], axis=1), n)
            parts.append((others, dots))
        # rows of blocks with fewer than n entries are filled up
        fill = lambda a, v: np.pad(a, ((0, 0), (0, n - a.shape[1])), constant_values=v)
        return _row(left, ids=ids, others=np.concatenate([fill(o, -1) for o, _ in parts]), dots=np.concatenate([fill(d, -np.inf) for _, d in parts]))

    return pair


def _topped(n: int):
    def merge(table: pa.Table) -> pa.Table:
        others = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, n) for x in table.column("others")], axis=1)
        dots = np.concatenate([np.frombuffer(x.as_buffer()).reshape(-1, n) for x in table.column("dots")], axis=1)
        others, dots = _largest(others, dots, n)
        return _row(table, ids=np.frombuffer(table.column("ids")[0].as_buffer(), np.int64), others=others, dots=dots)

    return merge


def _entries(n: int):
    def f(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
                others = np.frombuffer(batch.column("others")[i].as_buffer(), np.int64)
                dots = np.frombuffer(batch.column("dots")[i].as_buffer())
                there = ~np.isneginf(dots)
                rank = np.tile(np.arange(n, dtype=np.int64), len(ids))
                yield pa.record_batch([pa.array(np.repeat(ids, n)[there]), pa.array(rank[there]), pa.array(others[there]), pa.array(dots[there])], ["id", "rank", "other", "dot"])

    return f


def largest_products(left: DataFrame, right: DataFrame, n: int, group: int = GROUP, slice_: int = 16) -> DataFrame:
    """(id, rank, other, dot): of each row of left (id, x) its n largest products with rows of right (id, x), equal ones by
    the smaller id.  Products are sums over slices of `slice_` inner columns."""
    def packed(t):
        many = F.lit(max(1, -(-t.count() // group)))
        return _blocks(t.select(F.lit(0).cast("long").alias("key"), F.pmod(F.xxhash64("id"), many).cast("long").alias("block"), F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), ["x"], ["id"])

    a, b = packed(left), packed(right)
    partial = _cells(a, b, False, _multiply(n, slice_), _TOPS)
    return _merged(partial, _topped(n), _chunks(b), _TOPS).mapInArrow(_entries(n), "id long, rank long, other long, dot double")

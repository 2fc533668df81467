"""Ancestors in parent tables of any depth, by pointer doubling: after round r the pairs up to distance 2^r are known, and a
table of jumps leads 2^r steps up.  Each round joins once, and makes pairs that no other round makes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(parents: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, ancestor, distance): each node of (node, parent) with all its ancestors, itself at distance 0.  A node has one
    row; a null parent, or one that is no node, is a root's.  keep writes a table and reads it again, which a round's joins
    need.  A circle is an error."""
    edges = keep(parents.select("node", "parent").where("node IS NOT NULL"))
    known = edges.select(F.col("node").alias("parent"))
    jumps = keep(edges.join(known, "parent", "left_semi").select("node", F.col("parent").alias("ancestor")))
    pairs = keep(jumps.select("node", "ancestor", F.lit(1).cast("long").alias("distance")))
    out, step, new = edges.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")).union(pairs), 1, pairs
    while jumps.head(1):
        if new.where("node = ancestor").head(1):
            raise ValueError("the parents go round in a circle")
        up = jumps.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("further"))
        # all pairs up to distance `step` so far, moved up by `step`: distances step + 1 to 2 step
        new = keep(pairs.join(up, "ancestor").select("node", F.col("further").alias("ancestor"), (F.col("distance") + step).alias("distance")))
        jumps = keep(jumps.join(up, "ancestor").select("node", F.col("further").alias("ancestor")))
        out, pairs, step = out.union(new), pairs.union(new), 2 * step
    return out


def roots(parents: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root, depth) of each node of (node, parent): pairs of the last ancestor only, doubled until none moves.  As many
    rows as nodes at any depth."""
    edges = keep(parents.select("node", "parent").where("node IS NOT NULL"))
    known = edges.select(F.col("node").alias("parent"))
    inner = edges.join(known, "parent", "left_semi").select("node", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth"))
    at = keep(inner.union(edges.join(inner.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"))))
    nodes, step = edges.count(), 1
    while True:
        up = at.where("depth > 0").select(F.col("node").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        now = keep(at.join(up, "root", "left").select("node", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if not now.join(up, "root", "left_semi").head(1):
            return now
        if step > nodes:
            raise ValueError("the parents go round in a circle")
        at, step = now, 2 * step

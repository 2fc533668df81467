"""Connected components of an edge list by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import saved


#: A key with more rows than this, and than the HUBS-th part of all rows, is a hub; there are at most HUBS of them.
HUB_ROWS, HUBS = 2048, 4096


def hub_join(rows: DataFrame, each: DataFrame, key: str, total: int) -> DataFrame:
    """rows, of which there are total, joined to each, a row a key with n, the number of rows with the key.  Hubs are
    broadcast (at most HUBS rows), so their rows stay where they are."""
    limit = max(HUB_ROWS, total // HUBS)
    if total <= limit:
        return rows.join(each.drop("n"), key)
    hubs = F.broadcast(each.where(F.col("n") > limit).drop("n"))
    rest = rows.join(hubs.select(key), key, "left_anti").join(each.where(F.col("n") <= limit).drop("n"), key)
    return rows.join(hubs, key).unionByName(rest)


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """large: links each node's larger neighbours to the least node around it; else its smaller ones and itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "a"))
    out = hub_join(both, least, "a", 2 * total if large else total)
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of edges can reach.  The edges are written to the shared
    folder after each round; rounds grow with the logarithm of a component's length."""
    edges = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.greatest("a", "b"), F.least("a", "b")).cast("decimal(38,0)")).alias("h")).first()
    was = mark(edges)
    while was.n:
        # a large star makes a link of each at most, and none more
        edges = saved(_star(_star(edges, True, was.n), False, was.n))
        now = mark(edges)
        if now == was:
            break
        was = now
    links = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component"))
    roots = links.select(F.col("component").alias("node"), "component")
    return links.union(roots).groupBy("node").agg(F.min("component").alias("component"))

"""Maximal paths: those that are no beginning of another one, by a range sort and a look at the next path.

In the order of paths, all that begin with a path follow it at once.  So a path is covered if the next one begins with it; at
the end of a partition the next one is the first path of the next partition that has any."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def maximal_paths(parted: DataFrame) -> DataFrame:
    """The rows whose path, an array column, is no beginning of another one.  parted: scan.parts(rows, [], ["path"]) from a
    table, one row a path, none null.  An empty path is covered by any other.  What goes over a border is a path a
    partition."""
    # within a partition: the next path; the last one's is null.  A partition's rows are a window of their own, which is
    # sorted and read one after the other
    next_ = F.lead("path").over(Window.partitionBy("_part").orderBy("path"))
    columns = [c for c in parted.columns if c != "_part"]
    rest = [c for c in columns if c != "path"]
    looked = parted.withColumn("_next", next_)
    inner = looked.where(F.col("_next").isNotNull() & ~_begins(F.col("_next"), F.col("path")))
    # the last path of each partition, and the first one of each
    ends = parted.groupBy("_part").agg(F.min("path").alias("first"), F.max(F.struct("path", *rest)).alias("last"))
    after = Window.orderBy("_part")  # a row a partition
    border = ends.withColumn("_next", F.lead("first").over(after)).select("last.*", "_next")
    outer = border.where(F.col("_next").isNull() | ~_begins(F.col("_next"), F.col("path")))
    return inner.select(*columns).union(outer.select(*columns))


def _begins(path, head):
    return F.slice(path, F.lit(1), F.size(head)) == head

"""Joins of intervals with points and with intervals, neither side small.

Time is cut into bins of several widths, each FACTOR times the last.  An interval goes into the narrowest bins that are as
wide as it is, so into two at most, whatever its length; a point goes into one bin of each width that some interval
has.  Bins are joined by equality, and bounds are checked.  A bin with very many rows is a skewed key, which adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FACTOR = 8


def _level(length: Column, base: int) -> Column:
    """0 for lengths up to base, then one more for each FACTOR."""
    return F.when(length <= base, 0).otherwise(F.ceil(F.log(float(FACTOR), length / base) - 1e-9)).cast("int")


def _width(level: Column, base: int) -> Column:
    return (F.pow(F.lit(float(FACTOR)), level) * base).cast("long")


def points_in(intervals: DataFrame, points: DataFrame, base: int) -> DataFrame:
    """intervals (start, end, ...) joined to points (at, ...) where start <= at <= end, all integers: each pair once.  base:
    the narrowest bins' width, about a short interval's length.  Intervals that end before they start, and nulls, meet
    nothing.  The other columns' names must differ."""
    some = intervals.where("start <= end").withColumn("_level", _level(F.col("end") - F.col("start"), base))
    # a level more or less by rounding is no matter: a bin no narrower than the interval is what counts
    some = some.withColumn("_level", F.when(_width(F.col("_level"), base) < F.col("end") - F.col("start"), F.col("_level") + 1).otherwise(F.col("_level")))
    levels = [r[0] for r in some.select("_level").distinct().collect()]  # 22 at most in 64 bits
    width = _width(F.col("_level"), base)
    first, last = F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")
    left = some.withColumn("_bin", F.explode(F.sequence(first, last)))
    each = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level")
    right = points.where("at IS NOT NULL").select("*", each).withColumn("_bin", F.floor(F.col("at") / width).cast("long"))
    # neither side is sent whole to all tasks
    both = left.hint("merge").join(right, ["_level", "_bin"]).where("at >= start AND at <= end")
    return both.drop("_level", "_bin")


def overlapping(a: DataFrame, b: DataFrame, base: int) -> DataFrame:
    """(id_a, id_b) of the rows of a and b (id, start, end) whose intervals have a point in common, each pair once: either
    b starts in a, or a starts in b behind b's start."""
    x = points_in(a.withColumnRenamed("id", "id_a"), b.where("start <= end").select(F.col("id").alias("id_b"), F.col("start").alias("at")), base)
    y = points_in(b.withColumnRenamed("id", "id_b"), a.where("start <= end").select(F.col("id").alias("id_a"), F.col("start").alias("at")), base)
    return x.select("id_a", "id_b").union(y.where("at > start").select("id_a", "id_b"))

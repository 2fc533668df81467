"""Running sums over keys of any length, in two passes.

Rows are sorted over partitions by key and order, so a long key is cut over many.  Pass one adds up each key's part of a
partition; the parts before it are a key's *carry* into a partition, a number for each partition that a key reaches into from
an earlier one.  Pass two runs within a partition's part of a key, and adds the carry.  No window is larger than a
partition, however many rows a key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parts(rows: DataFrame, key: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """rows with _part, the range of (key, order) that they are in: ranges of about as many rows, by a sample of bounds.
    The sample is drawn anew at each use, so take the result from a table, or use it once."""
    columns = [F.col(c).asc_nulls_first() for c in [*key, *order]]
    ranged = rows.repartitionByRange(n, *columns) if n else rows.repartitionByRange(*columns)
    return ranged.withColumn("_part", F.spark_partition_id())


def running_sums(parted: DataFrame, key: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """parted (of parts(), from a table) with the running sums over each key, its own row included; rows of equal order
    come in any order.  Sums of integers are exact, those of doubles depend on how rows are added."""
    keys = [F.col(c) for c in key]
    totals = parted.groupBy("_part", *keys).agg(*[F.sum(x).alias(f"_{name}") for name, x in sums.items()])
    # of the parts of a key all but the first get a carry: a row a partition at most
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    many = Window.partitionBy(*(keys or [F.lit(0)]))
    if keys:
        spread = parted.groupBy("_part").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last"))
        # only a partition's first and last key can reach over a border
        ends = spread.select("_part", F.explode(F.array_distinct(F.array("first", "last"))).alias("k")).select("_part", *[F.col("k")[c].alias(c) for c in key])
        on = [F.expr(f"a._part = b._part AND {' AND '.join(f'a.`{c}` <=> b.`{c}`' for c in key)}")]
        totals = totals.alias("a").join(F.broadcast(ends.alias("b")), on, "left_semi")
    carry = totals.withColumn("_n", F.count("*").over(many)).select("_part", "_n", *keys, *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    carry = F.broadcast(carry.where("_n > 1").drop("_n").alias("c"))  # two rows a partition at most
    within = Window.partitionBy("_part", *keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    run = parted.withColumns({f"_run_{name}": F.coalesce(F.sum(x).over(within), F.lit(0)) for name, x in sums.items()})
    on = F.expr(" AND ".join(["r._part = c._part", *(f"r.`{c}` <=> c.`{c}`" for c in key)]))
    out = run.alias("r").join(carry, on, "left")
    names = [c for c in parted.columns if c != "_part"]
    return out.select(*[F.col(f"r.`{c}`") for c in names], *[(F.col(f"r._run_{name}") + F.coalesce(F.col(f"c._{name}"), F.lit(0))).alias(name) for name in sums])

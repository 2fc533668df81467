"""Sharding by a two-pass external shuffle.

The first pass scatters whole records by a seeded hash into buckets that fit in memory; the second shuffles each bucket with
Spark's shuffle(), an inside-out Fisher-Yates.  The buckets one behind the other are the order of all records; shards are
equal stretches of it, so their counts differ by one row at most and their slots have no gaps (the law ``rows``), and a task
writes its buckets to a shard or two.  ``write_shards`` writes them as they come; records move once.

Equal records would meet in one bucket.  So digests are counted first: records of which there are more than ``SAME`` (and
than the COMMON-th part of all) leave the stream, and as many copies of one of them are scattered by their number.  What is
broadcast is their digests, COMMON at most.  Offsets of buckets are prefix sums in two levels.  Reruns agree if input and
seed do: the numbers of buckets and tasks follow the records.

A null text has 0 bytes and crc32 0.  Nulls in any column are values like others; an empty table gives no rows.  Columns of
any name pass through, but shard and slot, which raise an error.  Maps are told apart by their entries in order of keys.
Records are told apart by 128 bits only where they are common or stand next to each other in a bucket before it is shuffled;
two different ones with equal digests both stay, unless both are common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .tables import new_path, saved

#: Rows and bytes of a bucket on average, and buckets that a task shuffles.
BUCKET_ROWS, BUCKET_BYTES, TASK_BUCKETS = 4096, 8 << 20, 8
#: Equal records up to which they may meet in a bucket, and different records of which there may be more.
SAME, COMMON = 64, 1 << 16
SEED = 10


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)) + 8).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def digested(df: DataFrame) -> DataFrame:
    """(row, h1, h2): the rows of df as structs, and 128 bits of digest."""
    # which columns are null goes in as well, as hashes pass over nulls
    cols = [F.array_sort(F.map_entries(f"`{f.name}`")) if isinstance(f.dataType, MapType) else F.col(f"`{f.name}`") for f in df.schema]
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns])
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.xxhash64(nulls, *cols).alias("h1"), F.xxhash64(*cols, nulls, F.lit(1)).alias("h2"))


def _offsets(sums: DataFrame) -> DataFrame:
    """(bucket, first): the records in earlier buckets, by (task, bucket), from sums (task, bucket, rows)."""
    sums = sums.withColumn("group", F.floor(F.col("task") / 128))
    tops = sums.groupBy("group").agg(F.sum("rows").alias("top")).withColumn("base", F.coalesce(F.sum("top").over(Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("top")
    inner = Window.partitionBy("group").orderBy("task", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    return sums.join(tops, "group").select("bucket", (F.col("base") + F.coalesce(F.sum("rows").over(inner), F.lit(0))).alias("first"))


def sharded(df: DataFrame, n_shards: int, seed: int = SEED) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (from 0 within a shard).  Its partitions are in the order of shard and
    slot, and so are the rows in each."""
    if {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError("the table has a column shard or slot already")
    rows = digested(df)
    counted = saved(rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(_bytes_of_row(df)).alias("bytes")), "keys")
    total, size = counted.agg(F.sum("n"), F.sum(F.col("n") * F.col("bytes"))).first()
    total = total or 0
    n_buckets = max(1, math.ceil(total / BUCKET_ROWS), math.ceil((size or 0) / BUCKET_BYTES))
    tasks = max(1, math.ceil(n_buckets / TASK_BUCKETS))
    bucket = lambda k: F.pmod(F.xxhash64("h1", "h2", k, F.lit(seed)), F.lit(n_buckets)).alias("bucket")
    # the partition that repartition() sends a bucket to, so that the order of buckets is that of partitions
    task = F.pmod(F.hash("bucket"), F.lit(tasks)).alias("task")
    one, number = F.lit(0).cast("long"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")
    limit = max(SAME, total // COMMON)
    common = counted.where(F.col("n") > limit)
    each = counted.where(F.col("n") <= limit).select(bucket(one), "n")
    scattered = rows.select("row", "h1", "h2", one.alias("k"))
    if common.head(1):
        names = F.broadcast(common.select("h1", "h2"))
        first = rows.join(names, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.any_value("row").alias("row"))
        copies = first.join(F.broadcast(common.select("h1", "h2", "n")), ["h1", "h2"]).select("row", "h1", "h2", number)
        scattered = scattered.join(names, ["h1", "h2"], "left_anti").unionByName(copies)
        each = each.union(common.select("h1", "h2", number).select(bucket(F.col("k")), F.lit(1)))
    sums = each.groupBy("bucket").agg(F.sum("n").alias("rows")).select(task, "bucket", "rows")
    offsets = F.broadcast(saved(_offsets(sums), "offsets"))  # a row a bucket of some megabytes
    held = scattered.select(bucket(F.col("k")), F.struct(F.xxhash64("h1", "h2", "k", F.lit(seed + 1)).alias("h"), "h1", "h2", "k", "row").alias("x"))
    held = held.repartition(tasks, "bucket").groupBy("bucket").agg(_in_order(F.collect_list("x")).alias("all"))
    # shuffle() draws on from row to row of a task, so tasks of a fixed number meet their buckets in order; nothing is
    # exchanged after it
    mixed = held.sortWithinPartitions("bucket").select("bucket", F.shuffle("all", seed).alias("all"))
    mixed = mixed.select("bucket", F.posexplode("all").alias("at", "x")).join(offsets, "bucket").select("x.row", (F.col("first") + F.col("at")).alias("place"))
    base, more = divmod(total, n_shards)
    edge = more * (base + 1)  # the first `more` shards have a row more
    shard = F.when(F.col("place") < edge, F.floor(F.col("place") / (base + 1))).otherwise(more + F.floor((F.col("place") - edge) / max(base, 1)))
    start = F.least(F.col("shard"), F.lit(more)) * (base + 1) + F.greatest(F.col("shard") - more, F.lit(0)) * base
    out = mixed.withColumn("shard", shard.cast("int")).select("row", "shard", (F.col("place") - start).cast("long").alias("slot"))
    return out.select("row.*", "shard", "slot")


def _bytes_of_row(df: DataFrame) -> Column:
    """Bytes of the strings of a row of df, as digested() makes it a struct, about."""
    sizes = [F.coalesce(F.octet_length(F.col("row")[f.name]), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    return sum(sizes, F.lit(8 * len(df.columns))).cast("long")


def _in_order(records: Column) -> Column:
    """Records by their hashes: an order that does not depend on how they came, and takes rows that have none (maps)."""
    by = lambda x: F.struct(x["h"], x["h1"], x["h2"], x["k"])
    return F.array_sort(records, lambda a, b: F.when(by(a) < by(b), -1).when(by(a) > by(b), 1).otherwise(0))


def write_shards(out: DataFrame, path: str) -> None:
    """Writes the rows of sharded() as folders shard=0, shard=1, ...; a shard's files in order of their names, and the rows
    in a file, are in the order of slot."""
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """What write_shards wrote, with the columns of like."""
    return spark.read.schema(like.schema).parquet(path).select(*[F.col(f"`{c}`") for c in like.columns])


def shard_plan(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", seed: int = SEED, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of docs, from the shards of whole rows that are written below
    path and read again."""
    out = sharded(docs, n_shards, seed)
    path = path or new_path(docs.sparkSession, "shards")
    write_shards(out, path)
    back, t = read_shards(docs.sparkSession, path, out), F.col(text)
    return back.select(F.col(key).alias("doc_id"), size_of(t).alias("size"), crc_of(t).alias("text_crc32"), "shard", "slot")

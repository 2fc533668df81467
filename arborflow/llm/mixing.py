"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots, each a block of equally many words, as many as the targets add up to.  Slot j belongs to the
source in whose share of the cumulative targets the golden-ratio point frac((j + 1) * phi) falls; a source's r-th slot
takes its r-th block.  The blocks come from the source's documents, shuffled by a seeded hash and strung together
(``MAX_EPOCHS`` times over, as a target may be that many times the source).  So the schedule alone decides how many
words of each source are taken, and in which order; golden-ratio points fill every share to within a few blocks of its
target at any length.  Where a source at its limit gets a slot more than it has blocks, the slot stays empty.

Slots find their source by an equi-join on cells of the unit interval that a source's share touches, then its bounds.
Positions within a source are prefix sums in two levels (hash buckets of a source, then rows of a bucket), and so are
ranks of slots, so a source with any share of all rows is dealt over many tasks.  Tables of a row a source are broadcast
up to ``FEW_SOURCES`` rows and joined by shuffle beyond; their order and prefix sums take one task, a row a source.

A null text has size 0 and takes nothing; a null source is a source of its own, last in order.  Repeated rows are
separate documents unless they agree in id, source and text; such rows share their words equally.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD
from .tables import saved

WEIGHTS, TOTAL, MAX_EPOCHS = (3.0, 1.0, 2.0), 1.5, 2
#: Rows of a hash bucket of a source, slots of a chunk, slots aimed at on small inputs, and most words of a block.
BUCKET_ROWS, CHUNK, SLOTS, BLOCK_WORDS = 512, 8192, 1 << 18, 1 << 20
#: Cells of the unit interval, and rows up to which a table of sources is broadcast.
CELLS, FEW_SOURCES = 4096, 10_000
PHI = (math.sqrt(5) - 1) / 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(source_sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, n_rows and target: total times all sizes shared by weight, none above most times its own
    size.  One row a source.  Sources with the smallest size per weight reach their limit first; the share per weight
    of the others is what the limits leave, at the first source that it does not overfill."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    listed = source_sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before, rest, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(float(most)) * F.col("source_size")
    level = (F.lit(float(total)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    out = listed.withColumn("_level", F.when(level * F.col("weight") <= full, level))
    out = out.withColumn("_level", F.first("_level", ignorenulls=True).over(everything))
    return out.withColumn("target", F.least(full, F.coalesce(F.col("_level") * F.col("weight"), full))).drop("_level", "weight")


def _running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before it in its group, buckets first, then order."""
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(w), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(sums, [*group, bucket]).withColumn(name, F.col("_before") + F.coalesce(F.sum(value).over(inner), F.lit(0))).drop("_before")


def shares(targeted: DataFrame) -> DataFrame:
    """targeted with sid, its place in the order of sources, and lo and hi, its share of the unit interval."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lo = F.coalesce(F.sum("target").over(before), F.lit(0.0)) / F.greatest(F.sum("target").over(everything), F.lit(1e-9))
    out = targeted.withColumn("sid", (F.row_number().over(order) - 1).cast("long")).withColumn("lo", lo)
    rest = F.sum("target").over(order.rowsBetween(1, Window.unboundedFollowing))
    # up to 1, whatever the rounding, for the last source with a target
    return out.withColumn("hi", F.when(F.coalesce(rest, F.lit(0.0)) > 0, F.lead("lo").over(order)).when(F.col("target") > 0, 1.0).otherwise(F.col("lo")))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int, seed: float = 0.0) -> DataFrame:
    """slot, sid and block for sources of (sid, lo, hi): a source's r-th slot takes its block r, counted from 0."""
    u = F.pmod((F.col("id") + 1) * F.lit(PHI) + F.lit(seed), F.lit(1.0))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), u.alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS).cast("long"))
    last = F.least(F.lit(CELLS - 1), F.floor(F.col("hi") * CELLS)).cast("long")
    cells = sources.where("lo < hi").select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS).cast("long"), last)).alias("cell"))
    dealt = points.join(cells, "cell").where("u >= lo AND u < hi").select("slot", "sid").withColumn("chunk", F.floor(F.col("slot") / CHUNK).cast("long"))
    return _running(dealt, ["sid"], "chunk", ["slot"], F.lit(1).cast("long"), "block").select("slot", "sid", "block")


class Mix:
    """A plan of documents, targets, the schedule and the pieces of documents that it takes."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MAX_EPOCHS, seed: int = 8, key: str = "doc_id", text: str = "text", source: str = "source"):
        spark = docs.sparkSession
        sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), self.hash_of(F.col(text), seed).alias("h"))
        sized = saved(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("copies")), "sized")
        per_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n_rows"))
        n_buckets = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS)).cast("long")
        self.targets = saved(shares(targets(per_source, weights, total, most)).withColumn("n_buckets", n_buckets), "sources")
        n, whole = self.targets.agg(F.count("*"), F.sum("target")).first()
        whole = math.floor(whole or 0)
        self.block = min(max(1, -(-whole // SLOTS)), BLOCK_WORDS)
        self.n_slots = round(whole / self.block)
        few = self.targets.select(F.col("source").alias("_source"), "sid", "source_size", "target", "n_buckets")
        named = sized.join(F.broadcast(few) if n <= FEW_SOURCES else few, F.expr("source <=> _source")).drop("_source")
        named = named.withColumn("shuffle", F.xxhash64("doc_id", "h", F.lit(seed))).withColumn("bucket", F.pmod(F.xxhash64("shuffle"), F.col("n_buckets")))
        words = F.col("size") * F.col("copies")
        self.placed = saved(_running(named, ["sid"], "bucket", ["shuffle", "doc_id", "size", "h"], words, "start").drop("shuffle", "bucket", "n_buckets"), "placed")
        b = F.lit(self.block)
        runs = self.placed.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("epoch")).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
        runs = runs.withColumn("to", F.col("from") + words)
        runs = runs.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / b).cast("long"), F.floor((F.col("to") - 1) / b).cast("long"))))
        runs = runs.withColumn("words", F.least("to", (F.col("block") + 1) * b) - F.greatest("from", F.col("block") * b))
        self.slots = schedule(spark, self.targets.select("sid", "lo", "hi"), self.n_slots)
        self.pieces = runs.join(self.slots, ["sid", "block"]).select("slot", "sid", "block", "epoch", "doc_id", "h", "size", "copies", "from", "words")

    @staticmethod
    def hash_of(text: Column, seed: int = 8) -> Column:
        return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")), F.lit(seed))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target and taken for each row of docs; equal rows share what is taken of them."""
        got = self.pieces.groupBy("sid", "doc_id", "h", "size").agg(F.sum("words").alias("words")).toDF("sid2", "doc_id2", "h2", "size2", "words")
        same = F.expr("sid = sid2 AND doc_id <=> doc_id2 AND h = h2 AND size = size2")
        out = self.placed.join(got, same, "left").withColumn("words", F.coalesce("words", F.lit(0)).cast("long"))
        copy = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("k"))
        share = F.floor(F.col("words") * F.col("k") / F.col("copies")) - F.floor(F.col("words") * (F.col("k") - 1) / F.col("copies"))
        return copy.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))

    def whole(self) -> DataFrame:
        """doc_id, h, size, sid and slot, the first of each run through a document of which at least half the words are
        taken; a document without words has one slot, by its hash."""
        each = self.pieces.groupBy("sid", "doc_id", "h", "size", "copies", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
        taken = each.where("2 * words >= size * copies").select("doc_id", "h", "size", "sid", "slot")
        empty = self.placed.where("size = 0").select("doc_id", "h", "size", "sid", F.pmod("h", F.lit(max(1, self.n_slots))).alias("slot"))
        return taken.unionByName(empty)


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: int = MAX_EPOCHS, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs mixed in whole documents, with the columns of docs, in the order of the schedule's slots: a row of docs comes
    once for each time (of ``most``) that the mix runs through at least half of its words; documents without words come
    once.  Columns of any name pass through as they are."""
    mix = Mix(docs, weights, total, most, key=key, text=text, source=source)
    n = mix.targets.count()
    names = mix.targets.select(F.col("source").alias("_source"), F.col("sid").alias("_sid"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("_id"), F.col(source).alias("_from"), Mix.hash_of(F.col(text)).alias("_h"))
    rows = rows.join(F.broadcast(names) if n <= FEW_SOURCES else names, F.expr("_from <=> _source"))
    out = rows.join(mix.whole(), F.expr("_id <=> doc_id AND _h = h AND _sid = sid")).select("row", "slot", "_id")
    return out.repartitionByRange("slot", "_id").sortWithinPartitions("slot", "_id").select("row.*")

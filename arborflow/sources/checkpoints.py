"""Sources and sinks: configuration, checkpoint manifests, stage tables, prompts and text output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.slicing import last_wins, staged, with_prefix


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration file as one row."""
    return spark.read.option("multiLine", True).json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(tensor_name, file) of a checkpoint index file, a JSON object with the map weight_map."""
    text = spark.read.text(path, wholetext=True)
    entry = F.from_json("value", "weight_map map<string,string>")
    return text.select(F.explode(entry["weight_map"]).alias("tensor_name", "file"))


def read_checkpoint(spark: SparkSession, base: str, head: str | None = None, prefix: str = "medusa_head.") -> DataFrame:
    """Tensors of Parquet files below base, of a repeated name the last file's, and those of head under a prefix."""
    read = lambda p: spark.read.parquet(p).withColumn("file", F.col("_metadata.file_path"))
    parts = [read(base)] + ([with_prefix(read(head), prefix)] if head else [])
    return last_wins(*parts)


def write_stages(manifest: DataFrame, stages: DataFrame, path: str) -> None:
    """Each stage's tensors below path/rank=...; replaces what is there."""
    staged(manifest, stages).write.mode("overwrite").partitionBy("rank").parquet(path)


def read_stage(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """One stage's tensors: only its folder is read."""
    return spark.read.parquet(path).where(F.col("rank") == rank)


def prompts(conversations: DataFrame) -> DataFrame:
    """(request_id, question): the first user turn of each conversation."""
    first = F.min_by("text", "turn")
    return conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("request_id")).agg(first.alias("question"))


def outputs(points: DataFrame) -> DataFrame:
    """(request_id, text): each point with its continuation, in the order of branches."""
    line = F.struct("branch_id", F.concat("point", "continuation").alias("text"))
    return points.groupBy("request_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["text"]), "\n").alias("text"))


def tensor_bytes(tensors: DataFrame) -> DataFrame:
    """Bytes of (…, n_elements, element_size) in all."""
    return tensors.agg(F.sum(F.col("n_elements") * F.col("element_size")).alias("n_bytes"))

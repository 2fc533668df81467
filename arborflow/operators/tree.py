"""Candidate trees: nodes, ancestors and root-to-leaf paths as DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Two trees of 63 nodes and one of 5; other trees are read with read_tree().
TREES: dict[str, list[list[int]]] = {
    "mc_sim_7b_63": [[0], [0, 0], [1], [0, 1], [2], [0, 0, 0], [1, 0], [0, 2], [3], [0, 3], [4], [0, 4], [2, 0], [0, 5], [0, 0, 1], [5], [0, 6], [6], [0, 7], [0, 1, 0], [1, 1], [7], [0, 8], [0, 0, 2], [3, 0], [0, 9], [8], [9], [1, 0, 0], [0, 2, 0], [1, 2], [0, 0, 3], [4, 0], [2, 1], [0, 0, 4], [0, 0, 5], [0, 0, 0, 0], [0, 1, 1], [0, 0, 6], [0, 3, 0], [5, 0], [1, 3], [0, 0, 7], [0, 0, 8], [0, 0, 9], [6, 0], [0, 4, 0], [1, 4], [7, 0], [0, 1, 2], [2, 0, 0], [3, 1], [2, 2], [8, 0], [0, 5, 0], [1, 5], [1, 0, 1], [0, 2, 1], [9, 0], [0, 6, 0], [0, 0, 0, 1], [1, 6], [0, 7, 0]],
    "vicuna_7b_stage2": [[0], [0, 0], [1], [0, 1], [0, 0, 0], [1, 0], [2], [0, 2], [0, 0, 1], [0, 3], [3], [0, 1, 0], [2, 0], [4], [0, 0, 2], [0, 4], [1, 1], [1, 0, 0], [0, 0, 0, 0], [5], [0, 0, 3], [0, 5], [0, 2, 0], [3, 0], [0, 1, 1], [0, 6], [6], [0, 7], [0, 0, 4], [4, 0], [1, 2], [0, 8], [7], [0, 3, 0], [0, 0, 0, 1], [0, 0, 5], [2, 1], [0, 0, 6], [1, 0, 1], [0, 0, 1, 0], [2, 0, 0], [5, 0], [0, 9], [0, 1, 2], [8], [0, 4, 0], [0, 2, 1], [1, 3], [0, 0, 7], [0, 0, 0, 2], [0, 0, 8], [1, 1, 0], [0, 1, 0, 0], [6, 0], [9], [0, 1, 3], [0, 0, 0, 3], [1, 0, 2], [0, 5, 0], [3, 1], [0, 0, 2, 0], [7, 0], [1, 4]],
    "vicuna_7b_stage3": [[0], [1], [2], [3], [4]],
}
DEFAULT, TOP_K = "vicuna_7b_stage2", 10


def read_tree(spark: SparkSession, path: str) -> list[list[int]]:
    """A tree from a JSON file, a list of paths of ranks, in any store that Spark reads."""
    text = spark.read.text(path, wholetext=True).first()
    return [list(map(int, p)) for p in json.loads(text.value)]


def tree_named(spark: SparkSession, name: str, folder: str | None = None) -> list[list[int]]:
    """A built-in tree, or the one that folder/name.json holds."""
    if name in TREES:
        return TREES[name]
    if folder is None:
        raise ValueError(f"tree {name} is not built in; name the folder with {name}.json")
    return read_tree(spark, f"{folder}/{name}.json")


def tree_nodes(spark: SparkSession, choices: list[list[int]]) -> DataFrame:
    """node_id, parent_id, depth, rank, path and tree_index (place in the flat candidates) of each node; 0 is the root."""
    paths = spark.createDataFrame([(p,) for p in [[], *choices]], "path array<int>")
    nodes = paths.withColumn("depth", F.size("path").cast("long"))
    nodes = nodes.withColumn("node_id", (F.row_number().over(Window.orderBy("depth", "path")) - 1).cast("long"))  # one row a node
    rank = F.element_at("path", F.when(F.col("depth") > 0, F.lit(-1)).otherwise(F.lit(None)))
    nodes = nodes.withColumn("rank", rank.cast("long")).withColumn("tree_index", F.when(F.col("depth") == 0, 0).otherwise(F.col("rank") + TOP_K * (F.col("depth") - 1) + 1).cast("long"))
    parents = nodes.select(F.col("path").alias("parent_path"), F.col("node_id").alias("parent_id"))
    up = F.expr("CASE WHEN depth > 0 THEN slice(path, 1, depth - 1) END")
    return nodes.join(F.broadcast(parents), up == F.col("parent_path"), "left").select("node_id", "parent_id", "depth", "rank", "path", "tree_index")


def tree_ancestors(nodes: DataFrame) -> DataFrame:
    """(node_id, anc_id): each node with its ancestors and itself."""
    prefixes = nodes.select("node_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.slice("path", F.lit(1), d))).alias("anc_path"))
    return prefixes.join(F.broadcast(nodes.select(F.col("path").alias("anc_path"), F.col("node_id").alias("anc_id"))), "anc_path").select("node_id", "anc_id")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(path_id, nodes): the node ids from the root to each leaf, padded with -1 to the deepest; leaves in falling
    node order, which breaks ties of acceptance."""
    inner = nodes.select(F.col("parent_id").alias("node_id")).where("node_id IS NOT NULL").distinct()
    leaves = nodes.join(inner, "node_id", "left_anti").select("node_id")
    walk = tree_ancestors(nodes).join(leaves, "node_id").join(nodes.select(F.col("node_id").alias("anc_id"), "depth"), "anc_id")
    most = nodes.agg(F.max("depth").alias("most"))
    paths = walk.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "anc_id"))), lambda s: s["anc_id"]).alias("nodes")).crossJoin(F.broadcast(most))  # one row
    padded = F.concat("nodes", F.array_repeat(F.lit(-1).cast("long"), (F.col("most") + 1 - F.size("nodes")).cast("int")))
    return paths.select((F.row_number().over(Window.orderBy(F.desc("node_id"))) - 1).cast("long").alias("path_id"), padded.alias("nodes"))


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth > 0").groupBy("depth").agg(F.count("*").alias("n_nodes"))

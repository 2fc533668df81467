"""Table functions for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@udtf(returnType="idx bigint, point string")
class Outline:
    """arborflow_outline(text): the lines of a text as points; none of a null."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(text.split("\n"))


@udtf
class TreePaths:
    """arborflow_tree_paths(TABLE(nodes)): for rows (tree, path), the paths of a tree's nodes, each node's beginnings being
    nodes as well: (tree, leaf, n_nodes), the path of each leaf and its number of nodes.  It asks for one partition a tree,
    in the order of paths; so it holds one path at a time, however large a tree is."""

    def __init__(self):
        self._last, self._first = None, 0

    @staticmethod
    def analyze(nodes: AnalyzeArgument) -> AnalyzeResult:
        kind = nodes.dataType["path"].dataType if nodes.isTable and nodes.dataType.names == ["tree", "path"] else None
        if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StringType):
            raise ValueError("arborflow_tree_paths takes TABLE(...) with the columns tree and path, path an array of strings")
        out = StructType().add("tree", nodes.dataType["tree"].dataType).add("leaf", ArrayType(StringType())).add("n_nodes", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("tree")], orderBy=[OrderingColumn("path")])

    def eval(self, row):
        path = list(row["path"])
        if self._last is None:
            self._first = len(path)  # the root comes first
        elif path[: len(self._last[1])] != self._last[1]:
            yield self._leaf()
        self._last = row["tree"], path

    def terminate(self):
        if self._last is not None:
            yield self._leaf()

    def _leaf(self):
        tree, path = self._last
        return tree, path, len(path) - self._first + 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("arborflow_outline", Outline)
    spark.udtf.register("arborflow_tree_paths", TreePaths)

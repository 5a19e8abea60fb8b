"""Trees and level-by-level walks over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import cut


def level_walk(roots: DataFrame, edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """Rows (node, path, depth) from roots (node, path) along edges (parent, child, name).

    One join per level, ended by an empty level; nodes deeper than max_depth are an error. A node is kept at its first level only, so that cycles and shared
    subtrees end; of several paths on one level the least stays.
    """
    level = roots.select("node", "path", F.lit(0).alias("depth"))
    seen = level
    for depth in range(1, max_depth + 1):
        below = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node"), F.concat_ws("/", "path", "name").alias("path"))
        level = cut(below.groupBy("node").agg(F.min("path").alias("path")).withColumn("depth", F.lit(depth)).join(seen.select("node"), "node", "left_anti"))
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)
    deeper = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node")).join(seen.select("node"), "node", "left_anti")
    if not deeper.isEmpty():
        raise RuntimeError(f"nodes deeper than {max_depth}")
    return seen


def orphans(nodes: DataFrame, reached: DataFrame, key: str = "node") -> DataFrame:
    """Nodes that no walk has reached."""
    return nodes.join(reached.select(key), key, "left_anti")

"""Choosing one row among several: deduplication, overrides, votes and upserts. Every order ends in a total one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("place__", place).where(F.col("place__") <= n).drop("place__")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """old, and the first new row of each key that old has not."""
    fresh = best_per(new, keys, order).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new rows, and the old rows whose key they don't replace."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*old.columns))


def first_ok(candidates: DataFrame, keys: Sequence[str], rank: Column, ok: Column, value: str) -> DataFrame:
    """Per key the value of the least-ranked candidate that passes, null if none does; and how many were tried."""
    tried = candidates.withColumns({"rank__": rank, "ok__": ok})
    out = tried.groupBy(*keys).agg(
        F.min_by(value, F.when(F.col("ok__"), F.col("rank__"))).alias("chosen"), F.min(F.when(F.col("ok__"), F.col("rank__"))).alias("rank"), F.count("*").alias("candidates")
    )
    return out.withColumn("chosen", F.when(F.col("rank").isNotNull(), F.col("chosen")))


def majority(votes: DataFrame, key: str, choice: str, share: float) -> DataFrame:
    """The choice with most votes per key (the least of equals), its votes, all votes, and if it has the share."""
    counted = votes.groupBy(key, choice).agg(F.count("*").alias("votes"))
    top = counted.groupBy(key).agg(F.max_by(choice, F.struct("votes", -F.col(choice))).alias(choice), F.max("votes").alias("votes"), F.sum("votes").alias("total"))
    return top.withColumn("placed", F.col("votes") >= F.lit(share) * F.col("total"))


def number_collisions(df: DataFrame, parent: str, name: str, order: Sequence[Column]) -> DataFrame:
    """Adds target: name, with ~2, ~3, ... from the second of equal names (case ignored) in one parent on."""
    n = F.row_number().over(Window.partitionBy(parent, F.lower(name)).orderBy(*order))
    return df.withColumn("target", F.when(n > 1, F.concat(F.col(name), F.lit("%~"), n.cast("string"))).otherwise(F.col(name)))

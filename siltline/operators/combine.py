"""Mirrors: each region of an image from the healthiest member that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.operators.intervals import buckets


def choose_members(spark, size: int, members: list[str], bad: DataFrame, region: int = 1 << 20) -> DataFrame:
    """Rows (start, end, member): per region the member with fewest bad bytes in all (then the first) that has none here; null if all have.

    bad: (member, start, end). Members are few; regions are made where they are used, and bad ranges meet them by number.
    """
    order = spark.createDataFrame([(m, i) for i, m in enumerate(members)], "member string, place int")
    total = bad.groupBy("member").agg(F.sum(F.col("end") - F.col("start")).alias("lost"))
    health = F.broadcast(order.join(total, "member", "left").select("member", "place", F.coalesce("lost", F.lit(0)).alias("lost")))
    hurt = bad.select("member", F.explode(buckets(F.col("start"), F.col("end"), region)).alias("n")).distinct()
    regions = spark.range(-(-size // region)).select(F.col("id").alias("n"), F.explode(F.array(*map(F.lit, members))).alias("member"))
    fine = regions.join(hurt, ["n", "member"], "left_anti").join(health, "member")
    best = fine.groupBy("n").agg(F.min_by("member", F.struct("lost", "place")).alias("member"))
    out = spark.range(-(-size // region)).select(F.col("id").alias("n")).join(best, "n", "left")
    return out.select((F.col("n") * region).alias("start"), F.least((F.col("n") + 1) * region, F.lit(size)).alias("end"), "member")

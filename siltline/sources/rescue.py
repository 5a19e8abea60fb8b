"""Rescue maps: which ranges of an image could not be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import parse_size

FINISHED = "+"


def bad_ranges(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (pos, end, status) of the lines "pos size status" whose status is not finished."""
    parts = F.split(F.trim(F.col(column)), r"\s+")
    rows = lines.where(~F.startswith(F.trim(F.col(column)), F.lit("#"))).select(parts.alias("p")).where(F.size("p") >= 3)
    found = rows.select(parse_size(F.col("p")[0]).alias("pos"), parse_size(F.col("p")[1]).alias("size"), F.col("p")[2].alias("status"))
    return found.where(F.col("pos").isNotNull() & F.col("size").isNotNull() & (F.col("status") != FINISHED)).select("pos", (F.col("pos") + F.col("size")).alias("end"), "status")


def read_bad_ranges(spark: SparkSession, path: str) -> DataFrame:
    return bad_ranges(spark.read.text(path))


def map_lines(gaps: DataFrame, size: int) -> DataFrame:
    """The map's lines (pos, line) for one image: finished ranges between the gaps (start, end)."""
    from siltline.operators.intervals import coalesce_intervals, complement

    spark = gaps.sparkSession
    one = gaps.select(F.lit(0).alias("g"), "start", "end")
    fine = complement(one, "g", spark.createDataFrame([(0, size)], "g int, size long"))
    rows = coalesce_intervals(one, "g").select("start", "end", F.lit("-").alias("s")).unionByName(fine.select("start", "end", F.lit(FINISHED).alias("s")))
    line = F.format_string("0x%X  0x%X  %s", F.col("start"), F.col("end") - F.col("start"), F.col("s"))
    return rows.select(F.col("start").alias("pos"), line.alias("line"))

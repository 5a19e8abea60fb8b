"""Queries with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def big(name: str):
    return F.col(name).cast("long")


#: A block stream per volume: supplier = volume, its line items in order = blocks, with statuses.
BLOCKS = """blocks AS (
    SELECT l_suppkey AS volume, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) - 1 AS blkid,
           CASE l_returnflag WHEN 'A' THEN 'ok' WHEN 'R' THEN 'cksum_mismatch' ELSE 'hole' END AS status,
           CAST(l_quantity AS BIGINT) AS word, l_orderkey AS entry, l_linenumber AS slot, l_partkey AS part, l_linestatus AS kind
    FROM lineitem)"""

RUNS = f"""{BLOCKS},
    marked AS (SELECT *, CASE WHEN lag(status) OVER w IS NOT DISTINCT FROM status THEN 0 ELSE 1 END AS change FROM blocks WINDOW w AS (PARTITION BY volume ORDER BY blkid)),
    runs AS (SELECT volume, min(blkid) AS first, count(*) AS count, min(status) AS status
             FROM (SELECT *, sum(change) OVER (PARTITION BY volume ORDER BY blkid) AS run FROM marked) GROUP BY volume, run)"""

#: Intervals per device: orders as byte ranges on one of 200 devices.
RANGES = """ranges AS (
    SELECT o_orderkey AS id, o_custkey % 200 AS dev, (o_orderkey * 131) % 100000 AS start,
           (o_orderkey * 131) % 100000 + CAST(floor(o_totalprice) AS BIGINT) % 1500 + 1 AS "end", o_orderstatus AS status
    FROM orders)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    status = F.when(F.col("l_returnflag") == "A", "ok").when(F.col("l_returnflag") == "R", "cksum_mismatch").otherwise("hole")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("volume"),
        (F.row_number().over(order) - 1).cast("long").alias("blkid"),
        status.alias("status"),
        big("l_quantity").alias("word"),
        F.col("l_orderkey").alias("entry"),
        F.col("l_linenumber").alias("slot"),
        F.col("l_partkey").alias("part"),
        F.col("l_linestatus").alias("kind"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltline.operators.intervals import run_lengths

    return run_lengths(blocks(spark, sf_dir).select("volume", "blkid", "status"), "volume", "blkid", "status")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") * 131) % 100000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 200).alias("dev"),
        start.alias("start"),
        (start + F.floor("o_totalprice").cast("long") % 1500 + 1).alias("end"),
        F.col("o_orderstatus").alias("status"),
    )

"""Streams: resumable scans of images, and rates and states over event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltline.sources.blockdev import register, size_of


def scan_stream(spark: SparkSession, paths: list[str], block: int, chunk: int, overlap: int = 0) -> DataFrame:
    register(spark)
    options = {"paths": ",".join(paths), "block": str(block), "chunk": str(chunk), "overlap": str(overlap)}
    return spark.readStream.format("blockdev").options(**options).load()


def scan_into(blocks: DataFrame, find: Callable[[DataFrame], DataFrame], table: str, checkpoint: str) -> StreamingQuery:
    """Runs find over each chunk and adds its rows to a Parquet table, each chunk once.

    The batch number is a partition of the table and a batch overwrites its own: a chunk that is done again
    after a failure leaves its rows once. The checkpoint tells a restarted scan where to go on.
    """

    def put(batch: DataFrame, number: int) -> None:
        find(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return blocks.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def scan_rounds(spark: SparkSession, paths: list[str], find: Callable[[DataFrame], DataFrame], table: str, round_bytes: int = 16 << 30, **options: str) -> list[int]:
    """Runs find over images in rounds of round_bytes of each, read by executors, and adds its rows to a Parquet table; returns the rounds done now.

    A round is a partition of the table and overwrites its own; {table}.rounds names those that are whole for these paths, so that a scan that was
    stopped goes on behind them, and another set of images makes every round pending again.
    """
    register(spark)
    mark = spark.createDataFrame([(",".join(paths), round_bytes)], "paths string, bytes long")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}.rounds")
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    done = {r["round"] for r in spark.read.parquet(f"{table}.rounds").join(mark, ["paths", "bytes"]).collect()} if known else set()
    now = []
    for k in range(-(-max(map(size_of, paths)) // round_bytes)):
        if k in done:
            continue
        some = [p for p in paths if size_of(p) > k * round_bytes]
        reader = spark.read.format("blockdev").options(paths=",".join(some), start=str(k * round_bytes), length=str(round_bytes), clip="true", **options)
        # members keep their places in the whole list
        names = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, place int")
        blocks = reader.load().join(F.broadcast(names), "path").select(F.col("place").alias("member"), "path", "offset", "data")
        find(blocks).withColumn("round", F.lit(k)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round").parquet(table)
        mark.withColumn("round", F.lit(k)).write.mode("append").parquet(f"{table}.rounds")
        now.append(k)
    return now


def event_counts(events: DataFrame, ts: str, keys: list[str], span: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key of a stream; events that come later than `late` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, span), *keys).agg(F.count("*").alias("n"))


def resumed_counts(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Events counted by type through a stream that takes what is there and stops; running it again adds nothing."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last")).withColumn("batch", F.lit(number)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch").parquet(f"{folder}/counts")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").groupBy("event_type").agg(F.sum("n").alias("n"), F.max("last").alias("last"))

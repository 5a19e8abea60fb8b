"""Outputs: sparse images, tables with upserts, manifests and listings."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.operators.rank import best_per, upsert

MARK = b"\xde\xad\xbe\xef"


def write_image(blocks: DataFrame, path: str, size: int, fill: str = "zero", force: bool = False) -> DataFrame:
    """Writes blocks (offset, data, status) to a sparse image and returns its gaps (start, end, status).

    The image lies where all executors write to one file; it is made under another name and renamed when
    whole. Zero blocks are left out; with fill="pattern" lost blocks are marked.
    """
    if os.path.exists(path) and not force:
        raise FileExistsError(path)
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.truncate(size)

    def put(rows):
        fd = os.open(part, os.O_WRONLY)
        try:
            for r in rows:
                data = r["data"]
                if data is None and fill == "pattern":
                    data = (MARK * (r["length"] // 4 + 1))[: r["length"]]
                if data is not None and any(data):
                    os.pwrite(fd, bytes(data)[: max(0, size - r["offset"])], r["offset"])
        finally:
            os.fsync(fd)
            os.close(fd)

    blocks.foreachPartition(put)
    os.replace(part, path)
    from siltline.operators.intervals import merge_adjacent

    gaps = blocks.where("data IS NULL").select(F.lit(0).alias("g"), F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "status")
    return merge_adjacent(gaps, "g", ["status"]).drop("g")


def replace_table(df: DataFrame, path: str) -> None:
    """Writes a table beside the old one and puts it in its place: the old one is moved aside before and deleted after.

    A failure leaves the old table at path, or, between the two moves, under path.old; restore() puts that back.
    """
    spark = df.sparkSession
    restore(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.new")
    store, (made, old, aside) = _paths(spark, f"{path}.new", path, f"{path}.old")
    if store.exists(old):
        store.rename(old, aside)
    store.rename(made, old)
    store.delete(aside, True)


def restore(spark, path: str) -> None:
    """Puts a table back that a failed replacement has moved aside."""
    store, (old, aside) = _paths(spark, path, f"{path}.old")
    if store.exists(aside):
        if store.exists(old):
            store.delete(aside, True)
        else:
            store.rename(aside, old)


def _paths(spark, *names: str):
    found = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return found[0].getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def merge_table(new: DataFrame, path: str, keys: list[str]) -> None:
    """Upsert into a Parquet table: new rows replace those of their key."""
    spark = new.sparkSession
    restore(spark, path)
    replace_table(upsert(spark.read.parquet(path), new, keys), path)


def replace_rows(new: DataFrame, path: str, keys: list[str], order: list[Column]) -> None:
    """Like merge_table, with the last of new rows that share a key."""
    merge_table(best_per(new, keys, order), path, keys)


def write_manifest(outputs: list[dict], path: str) -> dict:
    """Adds outputs to the manifest at path, which lists what was extracted before, and returns it with counts per status."""
    known = {"outputs": []}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
    known["outputs"] += outputs
    counts: dict[str, int] = {}
    for o in known["outputs"]:
        counts[o["status"]] = counts.get(o["status"], 0) + 1
    known["summary"] = counts
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(known, f, indent=1, sort_keys=True)
    os.replace(f"{path}.part", path)
    return known


def write_listing(entries: DataFrame, path: str) -> None:
    """CSV of entries in order of file system and path."""
    entries.orderBy("fs_id", "path").write.mode("overwrite").option("header", True).csv(path)

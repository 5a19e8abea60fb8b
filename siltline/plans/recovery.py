"""Recovery of volumes as one plan: pointers of all generations, candidates per block, verification, coverage, losses."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltline.functions import records
from siltline.operators import intervals
from siltline.operators.rank import best_per

RECOVERED, BY_DESIGN = ("ok", "embedded", "ok_stale"), ("hole", "discarded")
LOST = ("cksum_mismatch", "zeroed", "no_metadata", "unreadable", "decompress_fail")
#: Candidates of one slot beyond so many are the oldest ones (the limit of the index format).
MAX_CANDIDATES = 254


def candidates(pointers: DataFrame, most: int | None = MAX_CANDIDATES) -> DataFrame:
    """Rows (volume, blkid, rank, p): pointers (volume, blkid, p, provenance), newest birth first, those of a ring of roots before carved ones; equal ones come once. most: how many of a slot are kept, None for all."""
    key = F.struct("p.vdev", "p.offset", "p.cksum", "p.birth")
    rows = pointers.withColumn("key", F.xxhash64(key)).groupBy("volume", "blkid", "key").agg(F.min_by(F.struct("p", "provenance"), "provenance").alias("x"))
    order = Window.partitionBy("volume", "blkid").orderBy(F.desc("x.p.birth"), F.when(F.col("x.provenance").startswith("ring"), 0).otherwise(1), "key")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("volume", "blkid", "rank", F.col("x.p").alias("p"))


def with_data(rows: DataFrame, read: Callable[[int, int, int], bytes | None]) -> DataFrame:
    """Adds data: psize bytes at the pointer's place, null where they can't be read. read(vdev, offset, size) runs in executors."""

    @F.arrow_udf("binary")
    def fetch(vdev: pa.Array, offset: pa.Array, size: pa.Array) -> pa.Array:
        out = []
        for v, o, n in zip(vdev.to_pylist(), offset.to_pylist(), size.to_pylist(), strict=True):
            d = None if v is None else read(v, o, n)
            out.append(d if d is not None and len(d) == n else None)
        return pa.array(out, pa.binary())

    # physical order within each task, so that reads run forward
    near = rows.repartition("p.vdev", F.floor(F.col("p.offset") / (64 << 20))).sortWithinPartitions("p.vdev", "p.offset")
    return near.withColumn("data", F.when(~F.col("p.hole") & ~F.col("p.embedded"), fetch("p.vdev", "p.offset", "p.psize")))


def verified(rows: DataFrame) -> DataFrame:
    """Adds status: hole and embedded by the pointer, else by checksum, before anything is decompressed."""
    status = records.block_status("p.cksum_type", "data", "p.cksum")
    return rows.withColumn("status", F.when(F.col("p.hole"), "hole").when(F.col("p.embedded"), "embedded").otherwise(status))


def chosen(checked: DataFrame) -> DataFrame:
    """One row per block: the first candidate that verifies (ok_stale if it isn't the newest), else the newest and why it fails."""
    fine = F.col("status").isin("ok", "embedded", "hole", "unverified")
    best = best_per(checked, ["volume", "blkid"], [F.desc(fine), F.asc("rank")])
    return best.withColumn("status", F.when((F.col("rank") > 1) & (F.col("status") == "ok"), "ok_stale").otherwise(F.col("status")))


def coverage(blocks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Rows (volume, first, count, status) that tile [0, n_blocks) of each volume (volume, n_blocks): blocks without metadata are no_metadata."""
    runs = intervals.run_lengths(blocks.select("volume", "blkid", "status"), "volume", "blkid", "status")
    known = runs.select("volume", F.col("first").alias("start"), (F.col("first") + F.col("count")).alias("end"))
    gaps = intervals.complement(known, "volume", volumes.select("volume", F.col("n_blocks").alias("size")))
    missing = gaps.select("volume", F.col("start").alias("first"), (F.col("end") - F.col("start")).alias("count"), F.lit("no_metadata").alias("status"))
    return runs.unionByName(missing)


def summary(runs: DataFrame) -> DataFrame:
    count = lambda names: F.coalesce(F.sum(F.when(F.col("status").isin(*names), F.col("count"))), F.lit(0))
    return runs.groupBy("volume").agg(F.sum("count").alias("n_blocks"), count(RECOVERED).alias("n_recovered"), count(BY_DESIGN).alias("n_holes"), count(LOST).alias("n_lost"), count(("unknown", "unverified")).alias("n_unknown"))


def file_losses(extents: DataFrame, runs: DataFrame, block: int, width: int = 1 << 30) -> DataFrame:
    """Rows (entry, offset, length, status): lost byte ranges of files, whose extents are (entry, volume, file_offset, volume_offset, length)."""
    lost = runs.where(F.col("status").isin(*LOST)).select("volume", "status", (F.col("first") * block).alias("r_start"), ((F.col("first") + F.col("count")) * block).alias("r_end"))
    placed = extents.select("entry", "volume", "file_offset", F.col("volume_offset").alias("l_start"), (F.col("volume_offset") + F.col("length")).alias("l_end"))
    hit = intervals.overlap_join(placed, lost, width, ["volume"])
    ranges = hit.select("entry", "status", (F.col("file_offset") + F.col("start") - F.col("l_start")).alias("start"), (F.col("file_offset") + F.col("end") - F.col("l_start")).alias("end"))
    merged = intervals.merge_adjacent(ranges, "entry", ["status"])
    return merged.select("entry", F.col("start").alias("offset"), (F.col("end") - F.col("start")).alias("length"), "status")


def carve_verdict(volume: DataFrame, roots: DataFrame, done: bool) -> DataFrame:
    """Whether scanning the raw disk may help: done, yes (no roots), no (the newest root is as old as the last sight of the data set), else maybe.

    volume: (volume, n_lost, destroy_txg, seen_txg); roots: (volume, txg).
    """
    newest = roots.groupBy("volume").agg(F.max("txg").alias("txg"))
    rows = volume.join(newest, "volume", "left")
    verdict = (
        F.when(F.lit(done), "done").when(F.col("txg").isNull(), "yes").when(F.col("n_lost") == 0, "no").when(F.col("seen_txg") >= F.col("txg"), "no").otherwise("maybe")
    )
    return rows.select("volume", verdict.alias("verdict"))


def report(runs: DataFrame, entries: DataFrame, top: int = 20, volumes: int = 1000) -> str:
    """Markdown: the first volumes, then the entries that lost most, and how many more of each there are. entries: (path, size, recoverable)."""
    lines = ["# Recovery report", "", "| volume | blocks | recovered | holes | lost | unknown |", "|---|---:|---:|---:|---:|---:|"]
    # one line per volume: the report is a document for people
    every = summary(runs)
    lines += ["| {volume} | {n_blocks} | {n_recovered} | {n_holes} | {n_lost} | {n_unknown} |".format(**r.asDict()) for r in every.orderBy("volume").limit(volumes).collect()]
    more = every.count() - volumes
    lines += ["", f"and {more} more volumes"] if more > 0 else []
    hurt = entries.where("recoverable < size")
    lines += ["", "## Files with losses", ""]
    lines += [f"- `{r['path']}`: {r['size'] - r['recoverable']} of {r['size']} bytes" for r in hurt.orderBy(F.desc(F.col("size") - F.col("recoverable")), "path").limit(top).collect()]
    more = hurt.count() - top
    return "\n".join(lines + ([f"- and {more} more"] if more > 0 else [])) + "\n"

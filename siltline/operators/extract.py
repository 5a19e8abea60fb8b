"""Getting bytes back: reads of a volume with its gaps, and files put together from extents."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import cut, ship

#: Statuses of blocks whose data can be read; those that are empty by design; all others are gaps.
READABLE, EMPTY = ("ok", "ok_stale", "embedded"), ("hole", "discarded")


def volume_pieces(requests: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Rows (id, n, start, size, reason, data): requests (id, volume, offset, length) in pieces of one block each, in order n.

    blocks: (volume, blkid, status, data). start counts from the request's offset. reason is null where data are there or the block
    is empty by design (data are zeros), else the block's status, no_metadata for blocks that no row tells of.
    A block that should be readable but has no data, or too few, is a gap with reason unreadable: never a guess.
    """
    first, last = F.floor(F.col("offset") / block_size), F.floor((F.col("offset") + F.col("length") - 1) / block_size)
    asked = requests.where("length > 0").select("id", "volume", "offset", "length", F.explode(F.sequence(first, last)).alias("blkid"))
    held = asked.join(blocks.select("volume", "blkid", "status", "data"), ["volume", "blkid"], "left")
    at = F.col("blkid") * block_size
    low, high = F.greatest(at, F.col("offset")), F.least(at + block_size, F.col("offset") + F.col("length"))
    size = high - low
    part = F.substring(F.col("data"), (low - at + 1).cast("int"), size.cast("int"))
    whole = F.col("status").isin(*READABLE) & F.coalesce(F.octet_length(part) == size, F.lit(False))
    empty = F.col("status").isin(*EMPTY)
    reason = F.when(whole | empty, F.lit(None)).when(F.col("status").isin(*READABLE), "unreadable").otherwise(F.coalesce("status", F.lit("no_metadata")))
    zeros = F.unhex(F.repeat(F.lit("00"), size.cast("int")))
    return held.select("id", (F.col("blkid") - first).alias("n"), (low - F.col("offset")).alias("start"), size.alias("size"), reason.alias("reason"), F.when(whole, part).otherwise(zeros).alias("data"))


def read_volume(requests: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Rows (id, data, gaps): the bytes of each request, gaps filled with zeros, and the gaps (start, end, reason), touching ones of a reason as one.

    For requests that fit into a row; extract() writes larger ones. Requests of no length are left out.
    """
    piece = F.struct("n", "start", (F.col("start") + F.col("size")).alias("end"), "reason", "data")
    rows = volume_pieces(requests, blocks, block_size).groupBy("id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    gap = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["reason"].alias("reason"))
    lost = F.transform(F.filter("p", lambda x: x["reason"].isNotNull()), gap)

    def joined(done, x):
        last = F.try_element_at(done, F.lit(-1))
        touches = F.coalesce((last["end"] == x["start"]) & (last["reason"] == x["reason"]), F.lit(False))
        longer = F.struct(last["start"].alias("start"), x["end"].alias("end"), x["reason"].alias("reason"))
        return F.when(touches, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,reason:string>>")
    data = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["data"])), ""))
    return rows.select("id", data.alias("data"), F.aggregate(lost, empty, joined).alias("gaps"))


def file_pieces(extents: DataFrame, blocks: DataFrame, block_size: int) -> DataFrame:
    """Rows (id, n, start, size, reason, data) of files: extents (id, volume, file_offset, length, volume_offset, kind), kind data or hole."""
    stored = cut(extents.where("kind = 'data'").select(F.monotonically_increasing_id().alias("x"), "*"))
    read = volume_pieces(stored.select(F.col("x").alias("id"), "volume", F.col("volume_offset").alias("offset"), "length"), blocks, block_size)
    data = read.withColumnRenamed("id", "x").join(stored.select("x", "id", "file_offset"), "x").select("id", (F.col("file_offset") + F.col("start")).alias("start"), "size", "reason", "data")
    return data.select("id", F.col("start").alias("n"), "start", "size", "reason", "data")


def extract(entries: DataFrame, pieces: DataFrame, path: str, marker: bytes = b"\0", force: bool = False) -> DataFrame:
    """Writes a file per entry (id, path, size) under the URI `path` and returns rows (id, path, size, lost, status, sha256, gaps).

    pieces: rows (id, n, start, size, reason, data). What no piece covers is sparse (zeros); pieces with a reason are gaps, filled with
    the marker over and over. status: full, partial, or none. A file is written by one task, piece by piece in order of n,
    under a name of the attempt, and renamed when whole; existing ones are kept, with status exists, unless force is set.
    """
    ship(entries.sparkSession)

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        now = out = None
        for b in batches:
            for row in b.to_pylist():
                if row["n"] == -1:
                    if out:
                        yield out.finish()
                    target = f"{root}/{row['name'].lstrip('/')}"
                    out = _Out(store, target, row, marker) if force or store.get_file_info(target).type == fs.FileType.NotFound else _Kept(row)
                    now = row["id"]
                elif out and row["id"] == now:
                    out.put(row)
        if out:
            yield out.finish()

    heads = entries.select("id", F.lit(-1).cast("long").alias("n"), F.lit(0).cast("long").alias("start"), F.col("size").cast("long").alias("size"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("binary").alias("data"), F.col("path").alias("name"))
    rows = heads.unionByName(pieces.withColumn("name", F.lit(None).cast("string")))
    made = rows.repartition("id").sortWithinPartitions("id", "n").mapInArrow(run, "id long, path string, size long, lost long, status string, sha256 string, gaps string")
    return cut(made)


class _Out:
    """One file: zeros between pieces, a marker in gaps, a digest of all of it."""

    def __init__(self, store, target: str, row: dict, marker: bytes):
        self.store, self.target, self.row, self.marker = store, target, row, marker
        store.create_dir(target.rpartition("/")[0], recursive=True)
        self.trial = f"{target}.{TaskContext.get().taskAttemptId()}.part"
        self.file, self.at, self.lost, self.gaps, self.digest = store.open_output_stream(self.trial, compression=None), 0, 0, [], hashlib.sha256()

    def write(self, data: bytes) -> None:
        self.file.write(data)
        self.digest.update(data)
        self.at += len(data)

    def fill(self, to: int, what: bytes) -> None:
        while self.at < to:
            self.write((what * (-(-min(1 << 20, to - self.at) // len(what))))[: min(1 << 20, to - self.at)])

    def put(self, piece: dict) -> None:
        end = min(piece["start"] + piece["size"], self.row["size"])
        if end <= self.at:
            return
        self.fill(min(piece["start"], self.row["size"]), b"\0")
        if piece["reason"] is None:
            self.write(piece["data"][self.at - piece["start"] : end - piece["start"]])
            return
        self.lost += end - self.at
        if self.gaps and self.gaps[-1][1] == self.at and self.gaps[-1][2] == piece["reason"]:
            self.gaps[-1][1] = end
        else:
            self.gaps.append([self.at, end, piece["reason"]])
        self.fill(end, self.marker)

    def finish(self) -> pa.RecordBatch:
        size = self.row["size"]
        self.fill(size, b"\0")
        self.file.close()
        self.store.move(self.trial, self.target)
        status = "full" if not self.lost else "none" if self.lost >= size else "partial"
        return _result(self.row, self.lost, status, self.digest.hexdigest(), json.dumps(self.gaps))


class _Kept:
    def __init__(self, row: dict):
        self.row = row

    def put(self, piece: dict) -> None:
        pass

    def finish(self) -> pa.RecordBatch:
        return _result(self.row, 0, "exists", None, "[]")


def _result(row: dict, lost: int, status: str, digest: str | None, gaps: str) -> pa.RecordBatch:
    columns = [pa.array([row["id"]], pa.int64()), pa.array([row["name"]]), pa.array([row["size"]], pa.int64()), pa.array([lost], pa.int64()), pa.array([status]), pa.array([digest], pa.string()), pa.array([gaps])]
    return pa.RecordBatch.from_arrays(columns, ["id", "path", "size", "lost", "status", "sha256", "gaps"])


def restore_script(entries: DataFrame) -> DataFrame:
    """Lines (k, line) of a shell script that gives restored entries (path, local, type, mode, uid, gid, mtime, link_target) their names, owners, modes and times.

    Names first, the deepest first; then links; then files; then directories, the deepest first, so that nothing changes a
    directory's time after it is set. Entries whose path would lead out of the folder keep their local name and get no line.
    """
    quoted = lambda c: F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("'\\''")), F.lit("'"))
    inner = F.regexp_replace("path", "^/+|/+$", "")
    rows = entries.withColumns({"p": inner, "local": F.regexp_replace("local", "^/+|/+$", "")})
    rows = rows.where((F.col("p") != "") & ~F.col("p").rlike(r"(^|/)\.{0,2}(/|$)"))
    depth = F.size(F.split("p", "/"))
    parent = F.regexp_replace("local", "[^/]*$", "")
    target = F.concat(parent, F.element_at(F.split("p", "/"), -1))
    rename = rows.where(F.col("local") != target).select(F.lit(1).alias("step"), (-depth).alias("d"), "p", F.concat(F.lit("mv -n -- "), quoted(F.col("local")), F.lit(" "), quoted(target)).alias("line"))
    links = rows.where("type = 'symlink'").select(F.lit(2).alias("step"), F.lit(0).alias("d"), "p", F.concat(F.lit("ln -s -- "), quoted(F.col("link_target")), F.lit(" "), quoted(F.col("p"))).alias("line"))
    meta = F.concat(
        F.lit("chown -h "), F.col("uid").cast("string"), F.lit(":"), F.col("gid").cast("string"), F.lit(" -- "), quoted(F.col("p")),
        F.lit("; chmod "), F.lpad(F.conv(F.col("mode").cast("string"), 10, 8), 4, "0"), F.lit(" -- "), quoted(F.col("p")),
        F.lit("; touch -d @"), F.col("mtime").cast("string"), F.lit(" -- "), quoted(F.col("p")),
    )
    files = rows.where("type = 'file'").select(F.lit(3).alias("step"), F.lit(0).alias("d"), "p", meta.alias("line"))
    dirs = rows.where("type = 'dir'").select(F.lit(4).alias("step"), (-depth).alias("d"), "p", meta.alias("line"))
    return rename.unionByName(links).unionByName(files).unionByName(dirs).select(F.struct("step", "d", "p").alias("k"), "line")

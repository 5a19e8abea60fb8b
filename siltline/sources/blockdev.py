"""Disk images as tables of blocks: a data source with batch and streaming readers.

    register(spark)
    spark.read.format("blockdev").option("paths", "a.img,b.img").option("block", 4096).load()

Columns: member, path, offset, data. Each partition is a byte range, read in its executor by positional reads;
paths must be reachable there. A filter on offset or member prunes partitions.

With option prefilter=metadata only blocks come that may open a metadata block by their first bytes, each with as many
bytes as it may take: a scan for metadata then makes rows of a few blocks in ten thousand, and reads every byte once.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThan, SimpleDataSourceStreamReader

SCHEMA = "member int, path string, offset bigint, data binary"
BATCH_BYTES = 8 << 20


@dataclass
class Range(InputPartition):
    member: int
    path: str
    start: int
    end: int


def size_of(path: str) -> int:
    """Bytes of a file or a block device."""
    with open(path, "rb") as f:
        return f.seek(0, os.SEEK_END)


def blocks(path: str, start: int, end: int, block: int, overlap: int = 0):
    """(offset, bytes) of the blocks that begin in [start, end); each is read `overlap` bytes further, and the last may be short."""
    with open(path, "rb") as f:
        at = start
        while at < end:
            span = min(end - at, max(block, BATCH_BYTES // block * block))
            data = os.pread(f.fileno(), span + overlap, at)
            if not data:
                return
            for i in range(0, min(span, len(data)), block):
                yield at + i, data[i : i + block + overlap]
            at += span


#: A framed block opens with its length, then a token; frames are at most so long, and bare object sets take so much.
FRAME, BARE = 128 << 10, 4096


def openings(data: bytes, span: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, bytes needed) of the blocks that begin in the first `span` bytes and may open a metadata block.

    A frame has a plausible big-endian length and a first token with literals; a bare object set has a type in its first byte and a
    kind from 1 to 3 in the little-endian word at 704.
    """
    at = np.arange(0, min(span, len(data)), block)
    view = np.frombuffer(data, np.uint8)
    padded = np.concatenate([view, np.zeros(1024, np.uint8)]) if len(data) < span + 1024 else view
    length = np.zeros(len(at), np.int64)
    for k in range(4):
        length = length << 8 | padded[at + k]
    framed = (length >= 8) & (length <= FRAME - 4) & (padded[at + 4] >> 4 != 0)
    bare = (padded[at] != 0) & (padded[at + 704] >= 1) & (padded[at + 704] <= 3)
    for k in range(705, 712):
        bare &= padded[at + k] == 0
    some = framed | bare
    return at[some], np.maximum(BARE, np.where(framed, length + 4, 0))[some]


def filtered(path: str, start: int, end: int, block: int):
    """(offset, bytes) of the openings in [start, end)."""
    with open(path, "rb") as f:
        at = start
        while at < end:
            span = min(end - at, max(block, BATCH_BYTES // block * block))
            data = os.pread(f.fileno(), span + FRAME + BARE, at)
            if not data:
                return
            for i, n in zip(*(x.tolist() for x in openings(data, span, block)), strict=True):
                yield at + i, data[i : i + n]
            at += span


class _Options:
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        if not self.paths:
            raise ValueError("option paths is missing")
        if len({os.path.realpath(p) for p in self.paths}) != len(self.paths):
            raise ValueError("a path is given twice")
        self.block = int(options.get("block", 4096))
        self.chunk = max(self.block, int(options.get("chunk", 64 << 20)) // self.block * self.block)
        self.overlap = int(options.get("overlap", 0))
        self.start = int(options.get("start", 0))
        self.length = int(options["length"]) if "length" in options else None
        self.clip = options.get("clip", "false") == "true"
        self.prefilter = options.get("prefilter", "")
        if self.prefilter not in ("", "metadata"):
            raise ValueError(f"no such prefilter: {self.prefilter}")

    def blocks(self, path: str, start: int, end: int):
        return filtered(path, start, end, self.block) if self.prefilter else blocks(path, start, end, self.block, self.overlap)

    def end(self, path: str) -> int:
        size = size_of(path)
        end = size if self.length is None else self.start + self.length
        if self.clip:
            return min(end, size)
        if self.start > size or end > size:
            raise ValueError(f"[{self.start}, {end}) exceeds {path} of {size} bytes")
        return end


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = _Options(options)
        self.low, self.high, self.member = 0, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("offset",):
                self.low = max(self.low, f.value)
            elif isinstance(f, LessThan) and f.attribute == ("offset",):
                self.high = f.value if self.high is None else min(self.high, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("member",):
                self.member = f.value
            # partitions are pruned only; Spark still applies the filter to rows
            yield f

    def partitions(self):
        out = []
        for k, path in enumerate(self.o.paths):
            end = self.o.end(path)
            for a in range(self.o.start, end, self.o.chunk):
                b = min(a + self.o.chunk, end)
                if b > self.low and (self.high is None or a < self.high) and self.member in (None, k):
                    out.append(Range(k, path, a, b))
        return out

    def read(self, part: Range):
        rows: list[tuple[int, bytes]] = []
        held = 0
        for row in self.o.blocks(part.path, part.start, part.end):
            rows.append(row)
            held += len(row[1])
            if held >= BATCH_BYTES:
                yield self._batch(part, rows)
                rows, held = [], 0
        if rows:
            yield self._batch(part, rows)

    @staticmethod
    def _batch(part: Range, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array([part.member] * n, pa.int32()), pa.array([part.path] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["member", "path", "offset", "data"]
        )


class BlockStream(SimpleDataSourceStreamReader):
    """Chunks in order, one per member and batch: the stream's checkpoint is the record of what is done, and a restart goes on behind it.

    The driver reads them: for images that grow, or small ones. streaming.scan.scan_rounds reads large ones in executors.
    """

    def __init__(self, options: dict):
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {"at": json.dumps([self.o.start] * len(self.o.paths))}

    def read(self, start: dict):
        at = json.loads(start["at"])
        rows, after = [], []
        for k, (path, a) in enumerate(zip(self.o.paths, at, strict=True)):
            b = min(a + self.o.chunk, self.o.end(path))
            rows += [(k, path, off, data) for off, data in self.o.blocks(path, a, b)]
            after.append(max(a, b))
        return iter(rows), {"at": json.dumps(after)}

    def readBetweenOffsets(self, start: dict, end: dict):
        for k, (path, a, b) in enumerate(zip(self.o.paths, json.loads(start["at"]), json.loads(end["at"]), strict=True)):
            for off, data in self.o.blocks(path, a, b):
                yield k, path, off, data


class BlockDevice(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockdev"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)

    def simpleStreamReader(self, schema):
        return BlockStream(self.options)


def register(spark) -> None:
    """Makes the format known to the session, with filters pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockDevice)


def fingerprints(paths: list[str]) -> dict[str, tuple[int, int]]:
    """(size, mtime in ns) of evidence files."""
    return {p: (size_of(p), os.stat(p).st_mtime_ns) for p in paths}


def assert_unchanged(before: dict[str, tuple[int, int]]) -> None:
    """Raises if a file is not as it was when the run began."""
    changed = [p for p, was in before.items() if fingerprints([p])[p] != was]
    if changed:
        raise RuntimeError(f"changed during the run: {', '.join(changed)}")

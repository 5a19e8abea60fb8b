"""Plugins: file systems and signatures that name what a device holds."""

from __future__ import annotations

import logging
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Protocol

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

Read = Callable[[int, int], bytes]

ENTRY_SCHEMA = "inode bigint, parent_inode bigint, path string, type string, size bigint, mode int, deleted boolean, link_target string"


@dataclass
class Entry:
    inode: int
    parent_inode: int
    path: str
    type: str
    size: int = 0
    mode: int = 0
    deleted: bool = False
    link_target: str | None = None


@dataclass
class Extent:
    file_offset: int
    length: int
    dev_offset: int | None
    kind: str = "data"


class Handle(Protocol):
    def info(self) -> dict: ...
    def iter_entries(self) -> Iterator[Entry]: ...
    def extents(self, entry: Entry) -> Iterator[Extent]: ...


@dataclass
class FileSystem:
    """probe gives the certainty, from 0 to 1, that the device holds it; open reads it."""

    name: str
    probe: Callable[[Read, int], float]
    open: Callable[[Read, int], Handle]


#: (offset, bytes, name) of formats that are named but not read (fixed values of the formats).
SIGNATURES: list[tuple[int, bytes, str]] = [
    (0, b"XFSB", "xfs"),
    (3, b"NTFS    ", "ntfs"),
    (3, b"EXFAT   ", "exfat"),
    (82, b"FAT32   ", "fat32"),
    (54, b"FAT16   ", "fat16"),
    (54, b"FAT12   ", "fat12"),
    (0x10040, b"_BHRfS_M", "btrfs"),
    (0, b"LUKS\xba\xbe", "luks"),
    (3, b"-FVE-FS-", "bitlocker"),
    (0x218, b"LVM2 001", "lvm2"),
    (4086, b"SWAPSPACE2", "linux-swap"),
    (4086, b"SWAP-SPACE", "linux-swap-old"),
    (0x8001, b"CD001", "iso9660"),
    (0x400, b"\x10\x20\xf5\xf2", "f2fs"),
    (0x400, b"H+", "hfsplus"),
    (32, b"NXSB", "apfs"),
    (0x4000, b"\x01\x01\x00\x00", "zfs-member"),
    (0x1000, b"\xfc\x4e\x2b\xa9", "md-raid"),
    (0x10034, b"ReIsEr", "reiserfs"),
    (0, b"hsqs", "squashfs"),
]
#: A probe must be so sure that the file system is read.
SURE = 0.5
#: Group of entry points under which other packages offer a FileSystem.
GROUP = "siltline.file_systems"


@dataclass
class Registry:
    file_systems: list[FileSystem] = field(default_factory=list)

    def add(self, fs: FileSystem) -> None:
        self.file_systems.append(fs)

    def discover(self, group: str = GROUP) -> list[str]:
        """Adds the file systems that installed packages offer as entry points; returns their names. One that can't be loaded is passed over."""
        found = []
        for point in sorted(entry_points(group=group), key=lambda p: p.name):
            try:
                fs = point.load()
            except Exception as e:  # as above
                logging.getLogger(__name__).warning("plugin %s can't be loaded: %s", point.name, e)
                continue
            if fs.name not in {x.name for x in self.file_systems}:
                self.add(fs)
                found.append(fs.name)
        return found

    def detect(self, read: Read, size: int) -> tuple[FileSystem | None, str | None]:
        """The surest file system that can be read, SURE at least, else the name of a signature. Probes that fail count as 0."""
        best, sure = None, 0.0
        for fs in self.file_systems:
            try:
                found = fs.probe(read, size)
            except Exception as e:  # a plugin's fault must not end the run
                logging.getLogger(__name__).warning("probe of %s failed: %s", fs.name, e)
                found = 0.0
            if found >= SURE and found > sure:
                best, sure = fs, found
        return (best, best.name) if best else (None, identify(read))

    def entries(self, read: Read, size: int) -> list[Entry]:
        fs, _ = self.detect(read, size)
        return list(fs.open(read, size).iter_entries()) if fs else []


def identify(read: Read) -> str | None:
    return next((name for offset, magic, name in SIGNATURES if read(offset, len(magic)) == magic), None)


def reader(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


@arrow_udf(StringType())
def identified(head: pa.Array) -> pa.Array:
    """The name of the format that the first bytes of a device show, null if none."""
    return pa.array([None if d is None else identify(reader(d)) for d in head.to_pylist()], pa.string())


# a flat table of 64-byte records, as an example of a plugin


FLAT_MAGIC = b"FLATFS01"


class FlatHandle:
    """Magic number, count, then records: name of 40 bytes, offset, length, mode."""

    def __init__(self, read: Read, size: int):
        self.read, self.size = read, size
        self.count = struct.unpack("<Q", read(8, 8))[0]

    def info(self) -> dict:
        return {"fstype": "flat", "entries": self.count}

    def _records(self):
        for i in range(self.count):
            raw = self.read(64 + 64 * i, 64)
            if len(raw) < 64:
                return
            name, start, length, mode, _ = struct.unpack("<40sQQII", raw)
            yield i, name.rstrip(b"\0").decode("utf-8", "replace"), start, length, mode

    def iter_entries(self) -> Iterator[Entry]:
        yield Entry(0, 0, "/", "dir")
        for i, name, start, length, mode in self._records():
            yield Entry(i + 1, 0, f"/{name}", "file", length, mode, start + length > self.size)

    def extents(self, entry: Entry) -> Iterator[Extent]:
        for i, _, start, length, _ in self._records():
            if i + 1 == entry.inode:
                yield Extent(0, length, start)


FLAT = FileSystem("flat", lambda read, size: float(read(0, 8) == FLAT_MAGIC), FlatHandle)

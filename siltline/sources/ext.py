"""The ext family of file systems: superblock, inodes, extents and directories of one device."""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterator

from siltline.sources.plugins import Entry, Extent, FileSystem, Read

ROOT, MAGIC, EXTENT_MAGIC = 2, 0xEF53, 0xF30A
F_EXTENTS, F_INLINE = 0x80000, 0x10000000
I_EXTENTS, I_64BIT, I_FLEX, I_METABG, C_JOURNAL = 0x40, 0x80, 0x200, 0x10, 0x4
KINDS = {0x4000: "dir", 0x8000: "file", 0xA000: "symlink", 0x2000: "char", 0x6000: "block", 0x1000: "fifo", 0xC000: "socket"}


def superblock(raw: bytes) -> dict | None:
    """Fields of the 1024 bytes at offset 1024; None without the magic number or with sizes that can't be."""
    if len(raw) < 1024 or struct.unpack_from("<H", raw, 56)[0] != MAGIC:
        return None
    inodes, blocks_lo = struct.unpack_from("<II", raw, 0)
    first, log_block = struct.unpack_from("<II", raw, 20)
    per_group, _, inodes_per_group = struct.unpack_from("<III", raw, 32)
    revision = struct.unpack_from("<I", raw, 76)[0]
    inode_size = struct.unpack_from("<H", raw, 88)[0] if revision else 128
    compat, incompat, ro = struct.unpack_from("<III", raw, 92)
    wide = bool(incompat & I_64BIT)
    if log_block > 6 or not per_group or not inodes_per_group or inode_size < 128:
        return None
    return {
        "inodes": inodes, "blocks": blocks_lo | (struct.unpack_from("<I", raw, 336)[0] << 32 if wide else 0), "first_block": first, "block_size": 1024 << log_block, "blocks_per_group": per_group,
        "inodes_per_group": inodes_per_group, "inode_size": inode_size, "compat": compat, "incompat": incompat, "ro_compat": ro, "desc_size": max(32, struct.unpack_from("<H", raw, 254)[0]) if wide else 32,
        "label": raw[120:136].partition(b"\0")[0].decode("utf-8", "replace"),
    }


class ExtHandle:
    def __init__(self, read: Read, size: int):
        self.read, self.size = read, size
        self.sb = superblock(read(1024, 1024))
        if self.sb is None:
            raise ValueError("no superblock")
        self.bs = self.sb["block_size"]
        self.problems: list[str] = []

    def info(self) -> dict:
        sb = self.sb
        kind = "ext4" if sb["incompat"] & (I_EXTENTS | I_64BIT | I_FLEX) else "ext3" if sb["compat"] & C_JOURNAL else "ext2"
        return {"fstype": kind, "label": sb["label"], "block_size": self.bs, "bytes": sb["blocks"] * self.bs}

    def inode(self, number: int) -> dict | None:
        sb = self.sb
        if not 1 <= number <= sb["inodes"]:
            return None
        group, index = divmod(number - 1, sb["inodes_per_group"])
        table = self._descriptor(group)
        if table is None:
            return None
        raw = self.read(table * self.bs + index * sb["inode_size"], sb["inode_size"])
        if len(raw) < 128:
            return None
        mode, _, size = struct.unpack_from("<HHI", raw)
        deleted, links = struct.unpack_from("<I", raw, 20)[0], struct.unpack_from("<H", raw, 26)[0]
        high = struct.unpack_from("<I", raw, 108)[0]
        kind = KINDS.get(mode & 0xF000)
        return {"number": number, "mode": mode & 0o7777, "type": kind, "size": size | (high << 32 if kind == "file" else 0), "links": links, "dtime": deleted, "flags": struct.unpack_from("<I", raw, 32)[0], "block": raw[40:100]}

    def _descriptor(self, group: int) -> int | None:
        sb, size = self.sb, self.sb["desc_size"]
        per_block = self.bs // size
        if sb["incompat"] & I_METABG:
            first = group // per_block * per_block
            at = sb["first_block"] + first * sb["blocks_per_group"] + int(self._has_backup(first))
        else:
            at = sb["first_block"] + 1 + group // per_block
        raw = self.read(at * self.bs + group % per_block * size, size)
        if len(raw) < size:
            return None
        return struct.unpack_from("<I", raw, 8)[0] | (struct.unpack_from("<I", raw, 40)[0] << 32 if size >= 64 else 0)

    @staticmethod
    def _has_backup(group: int) -> bool:
        """Groups 0, 1 and the powers of 3, 5 and 7 hold copies of the superblock."""
        if group < 2:
            return True
        for base in (3, 5, 7):
            n = base
            while n < group:
                n *= base
            if n == group:
                return True
        return False

    def runs(self, inode: dict) -> Iterator[tuple[int, int, int, bool]]:
        """(file block, device block, blocks, unwritten) of an inode."""
        if inode["flags"] & F_EXTENTS:
            yield from self._extent_node(inode["block"], 0)
        else:
            yield from self._mapped(inode)

    def _extent_node(self, raw: bytes, depth: int) -> Iterator[tuple[int, int, int, bool]]:
        magic, n, _, level = struct.unpack_from("<HHHH", raw) if len(raw) >= 12 else (0, 0, 0, 0)
        if magic != EXTENT_MAGIC or depth > 5 or 12 + 12 * n > len(raw):
            self.problems.append("damaged extent node")
            return
        for i in range(n):
            at = 12 + 12 * i
            if level:
                low, high = struct.unpack_from("<IH", raw, at + 4)
                yield from self._extent_node(self.read((low | high << 32) * self.bs, self.bs), depth + 1)
            else:
                first, count, high, low = struct.unpack_from("<IHHI", raw, at)
                yield first, low | high << 32, count - 32768 if count > 32768 else count, count > 32768

    def _mapped(self, inode: dict) -> Iterator[tuple[int, int, int, bool]]:
        pointers = struct.unpack("<15I", inode["block"])
        per = self.bs // 4
        total = -(-inode["size"] // self.bs)

        def walk(block: int, depth: int, first: int) -> Iterator[tuple[int, int, int, bool]]:
            span = per ** max(0, depth)
            if first >= total or block == 0:
                return
            if depth == 0:
                yield first, block, 1, False
                return
            raw = self.read(block * self.bs, self.bs)
            for i in range(len(raw) // 4):
                yield from walk(struct.unpack_from("<I", raw, 4 * i)[0], depth - 1, first + i * (span // per))

        at = 0
        for k, p in enumerate(pointers):
            depth = max(0, k - 11)
            yield from walk(p, depth, at)
            at += per**depth

    def data(self, inode: dict) -> bytes:
        """Contents of a small file or directory; holes are zeros."""
        if inode["flags"] & F_INLINE or (inode["type"] == "symlink" and inode["size"] < 60 and not inode["flags"] & F_EXTENTS):
            return inode["block"][: inode["size"]]
        out = bytearray(inode["size"])
        for first, block, n, unwritten in self.runs(inode):
            if not unwritten and first * self.bs < len(out):
                piece = self.read(block * self.bs, n * self.bs)[: len(out) - first * self.bs]
                out[first * self.bs : first * self.bs + len(piece)] = piece
        return bytes(out)

    def names(self, data: bytes) -> Iterator[tuple[int, str]]:
        """(inode, name) of directory blocks, without . and ..; a bad record ends its block."""
        for base in range(0, len(data), self.bs):
            at, end = base, min(base + self.bs, len(data))
            while at + 8 <= end:
                number, size, length, _ = struct.unpack_from("<IHBB", data, at)
                if size < 8 or size % 4 or at + size > end or length > size - 8:
                    break
                name = data[at + 8 : at + 8 + length]
                if number and name not in (b".", b".."):
                    yield number, name.decode("utf-8", "surrogateescape")
                at += size

    def iter_entries(self) -> Iterator[Entry]:
        """Breadth first from the root, then inodes in use that no directory names, then deleted ones that still have a map."""
        queue, seen = deque([(ROOT, 0, "/")]), {ROOT}
        while queue:
            number, parent, path = queue.popleft()
            inode = self.inode(number)
            if inode is None or inode["type"] is None:
                continue
            yield self._entry(inode, parent, path)
            if inode["type"] == "dir":
                for child, name in self.names(self.data(inode)):
                    if child not in seen:
                        seen.add(child)
                        queue.append((child, number, path.rstrip("/") + "/" + name))
        for number in range(11, self.sb["inodes"] + 1):
            inode = self.inode(number)
            if number in seen or inode is None or inode["type"] is None:
                continue
            if inode["links"] and not inode["dtime"]:
                yield self._entry(inode, 0, f"/$orphans/#{number}")
            elif inode["dtime"] and any(self.runs(inode)):
                yield self._entry(inode, 0, f"/$deleted/#{number}", True)

    def _entry(self, inode: dict, parent: int, path: str, deleted: bool = False) -> Entry:
        target = self.data(inode).decode("utf-8", "replace") if inode["type"] == "symlink" else None
        return Entry(inode["number"], parent, path, inode["type"], inode["size"], inode["mode"], deleted, target)

    def extents(self, entry: Entry) -> Iterator[Extent]:
        """Data, unwritten and sparse ranges that tile the file."""
        inode, at = self.inode(entry.inode), 0
        if inode["flags"] & F_INLINE:
            yield Extent(0, entry.size, None, "inline")
            return
        for first, block, n, unwritten in sorted(self.runs(inode)):
            start, end = first * self.bs, min((first + n) * self.bs, entry.size)
            if start >= end:
                continue
            if start > at:
                yield Extent(at, start - at, None, "sparse")
            yield Extent(start, end - start, block * self.bs, "unwritten" if unwritten else "data")
            at = end
        if at < entry.size:
            yield Extent(at, entry.size - at, None, "sparse")


def probe(read: Read, size: int) -> float:
    """Sure, or half sure if the superblock claims more than the device has."""
    sb = superblock(read(1024, 1024))
    if sb is None:
        return 0.0
    return 0.5 if sb["blocks"] * sb["block_size"] > size * 1.01 + (1 << 20) else 1.0


EXT = FileSystem("ext", probe, ExtHandle)

"""Objects of a pool: verified reads through block trees, attribute maps, data sets and their file trees.

Reads go through a function (vdev, offset, size) -> bytes or None, so that images, mirrors and striped
groups look alike. These walks follow pointers one after the other; they serve the small metadata of a pool. Bulk
work over all blocks of a volume is done by siltline.plans.recovery.
"""

from __future__ import annotations

import hashlib
import struct
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from siltline.functions import codecs, records

ReadAt = Callable[[int, int, int], bytes | None]
MAX_DEPTH = 64


class Unreadable(Exception):
    """No copy of the block is there and holds."""


def checksum(kind: int, data: bytes) -> tuple[int, ...] | None:
    """Four words of a checksum, None if its kind is not known here."""
    if kind == records.CK_FLETCHER4:
        return records.fletcher4_bytes(data)
    if kind == records.CK_FLETCHER2:
        return records.fletcher2_bytes(data)
    if kind == records.CK_SHA256:
        return struct.unpack(">4Q", hashlib.sha256(data).digest())
    return None


class Pool:
    """Reads blocks by pointer; the copies of a block are tried in order, each checked before it is decompressed."""

    def __init__(self, read: ReadAt):
        self.read_at = read
        self.unverified = 0

    def block(self, pointer: bytes) -> bytes:
        w = records.words_of(pointer)
        f = {k: v[0].item() for k, v in records.pointer_fields(w).items()}
        if f["embedded"]:
            return codecs.decompress(f["comp"], records.embedded_data(pointer), f["lsize"])
        if f["hole"]:
            return bytes(f["lsize"])
        want = tuple(int(x) for x in w[0, 12:])
        why = "no copy"
        for k in range(3):
            if not f[f"asize{k}"]:
                continue
            if f[f"gang{k}"]:
                data = self._gang(f[f"vdev{k}"], f[f"offset{k}"], f["psize"])
            else:
                data = self.read_at(f[f"vdev{k}"], f[f"offset{k}"], f["psize"])
            if data is None or len(data) < f["psize"]:
                why = "missing"
                continue
            have = checksum(f["cksum_type"], data)
            if have is not None and have != want:
                why = "zeroed" if not any(data) else "cksum_mismatch"
                continue
            self.unverified += have is None and f["cksum_type"] != records.CK_OFF
            try:
                return codecs.decompress(f["comp"], data, f["lsize"])
            except codecs.CodecError:
                why = "decompress_fail"
        raise Unreadable(why)

    def _gang(self, vdev: int, offset: int, size: int) -> bytes | None:
        """A block in pieces: a sector with up to three pointers to them."""
        head = self.read_at(vdev, offset, records.SECTOR)
        if head is None or len(head) < records.SECTOR:
            return None
        out = b""
        for i in range(3):
            pointer = head[i * records.POINTER : (i + 1) * records.POINTER]
            if any(pointer):
                try:
                    out += self.block(pointer)
                except Unreadable:
                    return None
        return out[:size] if len(out) >= size else None


class ObjectReader:
    """The blocks of one object, through its tree of indirect blocks."""

    def __init__(self, pool: Pool, node: dict):
        self.pool, self.node, self.size = pool, node, node["block_size"]
        self.fan = (1 << node["indblkshift"]) // records.POINTER if node["nlevels"] > 1 else 1

    def pointer(self, number: int) -> bytes | None:
        """The pointer of a data block; None in a hole."""
        level = self.node["nlevels"] - 1
        span = self.fan**level
        table = self.node["blkptrs"]
        while True:
            i, number = divmod(number, span)
            found = table[i * records.POINTER : (i + 1) * records.POINTER]
            if len(found) < records.POINTER or not any(found):
                return None
            if level == 0:
                return found
            if records.pointer_fields(records.words_of(found))["hole"][0]:
                return None
            table, level, span = self.pool.block(found), level - 1, span // self.fan

    def block(self, number: int) -> bytes:
        found = self.pointer(number)
        return bytes(self.size) if found is None else self.pool.block(found)

    def blocks(self) -> Iterator[tuple[int, bytes | None, str]]:
        """(number, data, status) of every block, unreadable ones with None."""
        for n in range(self.node["maxblkid"] + 1):
            try:
                yield n, self.block(n), "ok"
            except Unreadable as e:
                yield n, None, str(e)

    def read(self, start: int, length: int) -> tuple[bytes, list[tuple[int, int, str]]]:
        """Bytes, zeros where they are lost, and the lost ranges with why."""
        out, gaps, at = bytearray(), [], start
        while at < start + length:
            n, skip = divmod(at, self.size)
            take = min(self.size - skip, start + length - at)
            try:
                out += self.block(n)[skip : skip + take]
            except Unreadable as e:
                out += bytes(take)
                if gaps and gaps[-1][0] + gaps[-1][1] == at and gaps[-1][2] == str(e):
                    gaps[-1] = (gaps[-1][0], gaps[-1][1] + take, str(e))
                else:
                    gaps.append((at, take, str(e)))
            at += take
        return bytes(out), gaps


class ObjectSet:
    def __init__(self, pool: Pool, pointer: bytes):
        header = records.parse_object_set(pool.block(pointer))
        if header is None:
            raise Unreadable("not an object set")
        self.pool, self.kind = pool, header["os_type"]
        self.meta = ObjectReader(pool, header["meta"])
        self.per = self.meta.size // records.NODE

    def node(self, number: int) -> dict | None:
        block, i = divmod(number, self.per)
        return records.parse_node(self.meta.block(block)[i * records.NODE :])

    def open(self, number: int) -> ObjectReader:
        node = self.node(number)
        if node is None:
            raise Unreadable(f"no object {number}")
        return ObjectReader(self.pool, node)

    def nodes(self) -> Iterator[tuple[int, dict]]:
        """All objects; unreadable blocks are passed over, wide headers count as the slots they take."""
        for block, data, _ in self.meta.blocks():
            i = 0
            while data is not None and i < self.per:
                node = records.parse_node(data[i * records.NODE :])
                if node:
                    yield block * self.per + i, node
                i += node["slots"] if node else 1

    def entries(self, number: int) -> dict[str, int | list[int]]:
        """Entries of an attribute map, small or with leaves. Every leaf is read, whatever the pointer table says."""
        reader = self.open(number)
        out: dict[str, int | list[int]] = {}
        for _, data, _ in reader.blocks():
            if data is None:
                continue
            small = records.micro_map(data)
            out |= small if small is not None else leaf(data)
        return out


LEAF_KIND, LEAF_MAGIC, ARRAY_CHUNK, ENTRY_CHUNK, CHUNK, LEAF_HEAD = 1 << 63, 0x2AB1EAF, 251, 252, 24, 48


def leaf(data: bytes) -> dict[str, int | list[int]]:
    """Entries of a leaf block of a large attribute map: chunks of 24 bytes behind a header and a hash table."""
    if len(data) < 512 or struct.unpack_from("<Q", data)[0] != LEAF_KIND or struct.unpack_from("<I", data, 24)[0] != LEAF_MAGIC:
        return {}
    base = LEAF_HEAD + len(data) // 32 * 2
    chunks = [data[i : i + CHUNK] for i in range(base, len(data) - CHUNK + 1, CHUNK)]

    def chain(first: int, size: int) -> bytes:
        out, at, seen = b"", first, set()
        while len(out) < size and at < len(chunks) and at not in seen and chunks[at][0] == ARRAY_CHUNK:
            seen.add(at)
            out += chunks[at][1:22]
            at = struct.unpack_from("<H", chunks[at], 22)[0]
        return out[:size]

    found: dict[str, int | list[int]] = {}
    for c in chunks:
        if c[0] != ENTRY_CHUNK:
            continue
        width, _, name_at, name_size, value_at, count = struct.unpack_from("<xBHHHHH", c)
        if width not in (1, 2, 4, 8):
            continue
        name = chain(name_at, name_size).rstrip(b"\0").decode("utf-8", "surrogateescape")
        raw = chain(value_at, width * count)
        values = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw), width)]
        if name and values:
            found[name] = values[0] if len(values) == 1 else values
    return found


@dataclass
class DataSet:
    name: str
    directory: int
    head: int
    creation_txg: int
    guid: str
    referenced: int
    pointer: bytes | None
    snapshots: dict[str, int]
    error: str | None = None


def datasets(meta: ObjectSet, pool_name: str) -> Iterator[DataSet]:
    """The tree of data sets, depth first, children by name; hidden names are left out and damage gives a row with the error."""
    root = meta.entries(1).get("root_dataset")
    if isinstance(root, int):
        yield from _below(meta, root, pool_name, 0)


def _below(meta: ObjectSet, directory: int, name: str, depth: int) -> Iterator[DataSet]:
    if depth > MAX_DEPTH:
        return
    try:
        bonus = meta.open(directory).node["bonus"]
        _, head, _, _, children = struct.unpack_from("<5Q", bonus)
        yield _dataset(meta, name, directory, head)
        below = meta.entries(children) if children else {}
    except (Unreadable, struct.error) as e:
        yield DataSet(name, directory, 0, 0, "", 0, None, {}, str(e))
        return
    for child in sorted(below):
        if not child.startswith("$") and isinstance(below[child], int):
            yield from _below(meta, below[child], f"{name}/{child}", depth + 1)


def _dataset(meta: ObjectSet, name: str, directory: int, head: int) -> DataSet:
    if not head:
        return DataSet(name, directory, 0, 0, "", 0, None, {})
    bonus = meta.open(head).node["bonus"]
    f = struct.unpack_from("<16Q", bonus)
    try:
        snapshots = {k: v for k, v in (meta.entries(f[4]) if f[4] else {}).items() if isinstance(v, int)}
    except Unreadable:
        snapshots = {}
    return DataSet(name, directory, head, f[7], str(f[14]), f[9], bonus[128:256], snapshots)


KINDS = {1: "fifo", 2: "char", 4: "dir", 6: "block", 8: "file", 10: "symlink", 12: "socket"}
SA_MAGIC = 0x2F505A


class Attributes:
    """System attributes of files: layouts list attribute numbers, a registry gives their names and sizes (0: variable)."""

    def __init__(self, files: ObjectSet, number: int):
        maps = files.entries(number)
        registry, layouts = files.entries(maps["REGISTRY"]), files.entries(maps["LAYOUTS"])
        self.names = {v & 0xFFFF: (k, v >> 24 & 0xFFFF) for k, v in registry.items() if isinstance(v, int)}
        self.layouts = {int(k): v if isinstance(v, list) else [v] for k, v in layouts.items()}

    def decode(self, bonus: bytes) -> dict[str, bytes]:
        if len(bonus) < 8 or struct.unpack_from("<I", bonus)[0] != SA_MAGIC:
            return {}
        info = struct.unpack_from("<H", bonus, 4)[0]
        head, layout = (info >> 10) * 8, self.layouts.get(info & 0x3FF, [])
        variable = [n for n in layout if not self.names.get(n, ("", 0))[1]]
        lengths = iter(struct.unpack_from(f"<{len(variable)}H", bonus, 6)) if 6 + 2 * len(variable) <= len(bonus) else iter(())
        out, at = {}, head
        for n in layout:
            name, size = self.names.get(n, ("", 0))
            size = size or next(lengths, 0)
            out[name] = bonus[at : at + size]
            at += size + 7 & ~7
        return out


def file_tree(files: ObjectSet) -> Iterator[dict]:
    """Files from the root, breadth first, then unlinked ones (deleted), then objects that no directory names."""
    master = files.entries(1)
    attributes = Attributes(files, master["SA_ATTRS"]) if "SA_ATTRS" in master else None
    queue, seen = deque([(master["ROOT"], 0, "/", "dir")]), {master["ROOT"]}
    while queue:
        number, parent, path, kind = queue.popleft()
        yield _file(files, attributes, number, parent, path, kind, False)
        if kind != "dir":
            continue
        try:
            names = files.entries(number)
        except Unreadable:
            continue
        for name in sorted(names):
            value = names[name]
            child = value & (1 << 48) - 1 if isinstance(value, int) else 0
            if child and child not in seen:
                seen.add(child)
                queue.append((child, number, f"{path.rstrip('/')}/{name}", KINDS.get(value >> 60, "file")))
    gone = files.entries(master["DELETE_QUEUE"]) if "DELETE_QUEUE" in master else {}
    for value in gone.values():
        if isinstance(value, int) and value not in seen:
            seen.add(value)
            yield _file(files, attributes, value, 0, f"/$unlinked/#{value}", "file", True)
    for number, node in files.nodes():
        if number not in seen and node["type"] in (19, 20):
            yield _file(files, attributes, number, 0, f"/$orphans/#{number}", "dir" if node["type"] == 20 else "file", False)


def _file(files: ObjectSet, attributes: Attributes | None, number: int, parent: int, path: str, kind: str, deleted: bool) -> dict:
    row = {"inode": number, "parent_inode": parent, "path": path, "type": kind, "size": None, "mode": None, "mtime": None, "deleted": deleted, "link_target": None}
    try:
        node = files.node(number)
    except Unreadable:
        return row
    found = attributes.decode(node["bonus"]) if attributes and node else {}
    word = lambda name: int.from_bytes(found[name][:8], "little") if len(found.get(name, b"")) >= 8 else None
    row |= {"size": word("ZPL_SIZE"), "mode": word("ZPL_MODE"), "mtime": word("ZPL_MTIME")}
    if row["mode"] is not None:
        row["mode"] &= 0o7777
    if kind == "symlink" and "ZPL_SYMLINK" in found:
        row["link_target"] = found["ZPL_SYMLINK"].decode("utf-8", "replace")
    return row

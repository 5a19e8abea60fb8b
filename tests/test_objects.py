"""A pool synthesised in memory: block trees, maps, data sets and a file tree."""

import struct

import pytest

from siltline.functions import codecs, records
from siltline.sources import objects


class Store:
    """Hands out space on one vdev and keeps what is written."""

    def __init__(self):
        self.raw, self.at = bytearray(4 << 20), 0

    def put(self, data, level=0, kind=20, comp=2, copies=1):
        frame = data
        if comp == codecs.LZ4:
            packed = codecs.lz4_literal(data)
            frame = struct.pack(">I", len(packed)) + packed
            frame = frame.ljust(-(-len(frame) // 512) * 512, b"\0")
        places = []
        for _ in range(copies):
            places.append(self.at)
            self.raw[self.at : self.at + len(frame)] = frame
            self.at += len(frame)
        pointer = bytearray(records.build_pointer(0, places[0], len(frame), len(frame), len(data), comp, records.CK_FLETCHER4, kind, level, 9, records.fletcher4_bytes(frame)))
        for k, place in enumerate(places[1:], 1):
            struct.pack_into("<QQ", pointer, 16 * k, len(frame) // 512, place // 512)
        return bytes(pointer)

    def read(self, vdev, offset, size):
        return bytes(self.raw[offset : offset + size])

    def node(self, blocks, kind=20, size=None, bonus=b"", levels=1, shift=10):
        """An object of these blocks; with two levels, through one indirect block."""
        size = size or (len(blocks[0]) if blocks else 512)
        pointers = [self.put(b, kind=kind) if b is not None else bytes(128) for b in blocks]
        top = pointers[0] if pointers else bytes(128)
        if levels == 2:
            top = self.put(b"".join(pointers).ljust(1 << shift, b"\0"), level=1, kind=kind, comp=codecs.LZ4)
        head = struct.pack("<8B2HB", kind, shift if levels > 1 else 0, levels, 1, 44, 7, 2, 1, size // 512, len(bonus), 0).ljust(16, b"\0") + struct.pack("<2Q", max(0, len(blocks) - 1), 4096)
        return (head.ljust(64, b"\0") + top + bonus).ljust(512, b"\0")

    def object_set(self, nodes, kind):
        table = bytearray(16384)
        for n, raw in nodes.items():
            table[512 * n : 512 * (n + 1)] = raw
        whole = bytearray(2048)
        whole[:512] = self.node([bytes(table)], kind=10)
        struct.pack_into("<Q", whole, 704, kind)
        return self.put(bytes(whole), kind=11, comp=codecs.LZ4, copies=2)


@pytest.fixture
def store():
    return Store()


def test_copies_and_damage(store):
    pool = objects.Pool(store.read)
    pointer = store.put(b"x" * 1024, copies=2)
    assert pool.block(pointer) == b"x" * 1024
    store.raw[:1024] = bytes(1024)
    assert pool.block(pointer) == b"x" * 1024
    store.raw[1024] ^= 1
    with pytest.raises(objects.Unreadable, match="cksum_mismatch"):
        pool.block(pointer)
    assert pool.block(records.build_embedded(b"hi", 2, 2, 19, 5)) == b"hi"


def test_trees_with_holes_and_losses(store):
    blocks = [bytes([65 + i]) * 512 if i != 2 else None for i in range(6)]
    reader = objects.ObjectReader(objects.Pool(store.read), records.parse_node(store.node(blocks, kind=19, size=512, levels=2)))
    whole = b"".join(b or bytes(512) for b in blocks)
    assert reader.read(0, 3072) == (whole, [])
    assert reader.read(500, 1100) == (whole[500:1600], [])
    at = store.raw.index(b"D" * 512)
    store.raw[at : at + 1024] = b"?" * 1024
    data, gaps = reader.read(1000, 2000)
    assert gaps == [(1536, 1024, "cksum_mismatch")] and data[:536] == whole[1000:1536] and data[-440:] == whole[2560:3000]
    assert [s for _, _, s in reader.blocks()] == ["ok", "ok", "ok", "cksum_mismatch", "cksum_mismatch", "ok"]


def big_leaf(entries, size=1024):
    raw = bytearray(size)
    struct.pack_into("<QQQI", raw, 0, objects.LEAF_KIND, 0, 0, objects.LEAF_MAGIC)
    base, at = 48 + size // 32 * 2, 0

    def chunk(data):
        nonlocal at
        raw[base + 24 * at : base + 24 * (at + 1)] = data.ljust(24, b"\0")
        at += 1
        return at - 1

    def array(data):
        pieces = [data[i : i + 21] for i in range(0, len(data), 21)]
        following = 0xFFFF
        for p in reversed(pieces):
            following = chunk(struct.pack("<B21sH", 251, p, following))
        return following

    for name, values in entries.items():
        n, v = array(name.encode() + b"\0"), array(b"".join(x.to_bytes(8, "big") for x in values))
        chunk(struct.pack("<BBHHHHHIQ", 252, 8, 0xFFFF, n, len(name) + 1, v, len(values), 0, 0))
    return bytes(raw)


def test_large_maps():
    entries = {"a": [7], "a name that takes more than one chunk": [1 << 63], "many": [1, 2, 3, 4]}
    assert objects.leaf(big_leaf(entries)) == {"a": 7, "a name that takes more than one chunk": 1 << 63, "many": [1, 2, 3, 4]}
    assert objects.leaf(bytes(1024)) == {}


def sa(store_layout, mode, size, link=b""):
    body = struct.pack("<QQQQ", mode, size, 1_700_000_000, 0) + link
    return struct.pack("<IHH", objects.SA_MAGIC, 1 << 10 | store_layout, len(link)) + body


def test_data_sets_and_files(store):
    micro = records.pack_micro_map
    registry = micro({"ZPL_MODE": 8 << 24 | 0, "ZPL_SIZE": 8 << 24 | 1, "ZPL_MTIME": 16 << 24 | 2, "ZPL_SYMLINK": 3})
    layouts = big_leaf({"2": [0, 1, 2], "3": [0, 1, 2, 3]})
    kind = lambda k, n: k << 60 | n
    files = store.object_set(
        {
            1: store.node([micro({"ROOT": 4, "SA_ATTRS": 2, "DELETE_QUEUE": 9})], kind=21),
            2: store.node([micro({"REGISTRY": 3, "LAYOUTS": 5})], kind=45),
            3: store.node([registry], kind=46),
            4: store.node([micro({"b.txt": kind(8, 6), "dir": kind(4, 7), "to": kind(10, 8)})], bonus=sa(2, 0o40755, 5)),
            5: store.node([layouts], kind=47),
            6: store.node([b"hello".ljust(512, b"\0")], kind=19, bonus=sa(2, 0o100644, 5)),
            7: store.node([micro({"deep": kind(8, 10)})], bonus=sa(2, 0o40700, 3)),
            8: store.node([], kind=19, bonus=sa(3, 0o120777, 5, b"b.txt")),
            9: store.node([micro({"c": 11})], kind=22),
            10: store.node([b"d" * 512], kind=19, bonus=sa(2, 0o100600, 512)),
            11: store.node([b"u" * 512], kind=19, bonus=sa(2, 0o100600, 512)),
            12: store.node([b"o" * 512], kind=19, bonus=sa(2, 0o100600, 512)),
        },
        2,
    )
    head = struct.pack("<16Q", 2, 0, 0, 0, 5, 0, 0, 77, 0, 4096, 0, 0, 0, 0, 123, 0) + files
    meta = store.object_set(
        {
            1: store.node([micro({"root_dataset": 2})], kind=1),
            2: store.node([], kind=12, bonus=struct.pack("<5Q", 0, 3, 0, 0, 4)),
            3: store.node([], kind=16, bonus=head),
            4: store.node([micro({"vol": 6, "$MOS": 9, "lost": 30})], kind=13),
            5: store.node([micro({"snap1": 8})], kind=15),
            6: store.node([], kind=12, bonus=struct.pack("<5Q", 0, 0, 2, 0, 0)),
        },
        1,
    )
    pool = objects.Pool(store.read)
    found = list(objects.datasets(objects.ObjectSet(pool, meta), "tank"))
    assert [(d.name, d.creation_txg, d.error is None) for d in found] == [("tank", 77, True), ("tank/lost", 0, False), ("tank/vol", 0, True)]
    assert found[0].snapshots == {"snap1": 8} and found[0].guid == "123"
    tree = list(objects.file_tree(objects.ObjectSet(pool, found[0].pointer)))
    assert [(r["path"], r["type"], r["size"], r["deleted"]) for r in tree] == [
        ("/", "dir", 5, False), ("/b.txt", "file", 5, False), ("/dir", "dir", 3, False), ("/to", "symlink", 5, False), ("/dir/deep", "file", 512, False),
        ("/$unlinked/#11", "file", 512, True), ("/$orphans/#12", "file", 512, False),
    ]
    assert tree[3]["link_target"] == "b.txt" and tree[1]["mode"] == 0o644
    assert objects.ObjectSet(pool, found[0].pointer).open(6).read(0, 5) == (b"hello", [])

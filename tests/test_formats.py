"""Codecs, records, layouts and partition tables against synthesised bytes."""

import itertools
import random
import struct
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltline.functions import codecs, records
from siltline.operators import striping
from siltline.sources import ext, partitions
from siltline.sources.plugins import FLAT, FLAT_MAGIC, Registry, identify, reader


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_lz4_literals_round_trip(data):
    assert codecs.lz4_block(codecs.lz4_literal(data), len(data)) == data


def test_lz4_matches_and_damage():
    # "abcd", then 12 bytes from 4 back, then a last literal
    block = bytes([0x48]) + b"abcd" + b"\x04\x00" + bytes([0x10]) + b"!"
    assert codecs.lz4_block(block, 64) == b"abcd" * 4 + b"!"
    framed = struct.pack(">I", len(block)) + block + bytes(100)
    assert codecs.decompress(codecs.LZ4, framed, 17) == b"abcd" * 4 + b"!"
    for bad in (b"\x48abcd\x09\x00", b"\xf0\xff", b"\x10", b"\x18a\x00\x00"):
        with pytest.raises(codecs.CodecError):
            codecs.lz4_block(bad, 64)
    with pytest.raises(codecs.CodecError):
        codecs.decompress(codecs.LZ4, framed, 16)


def test_other_codecs():
    # eight literals would be one mask; here "ab" and a match of 6 from 2 back
    assert codecs.lzjb(bytes([0b100]) + b"ab" + struct.pack(">H", (6 - 3) << 10 | 2), 8) == b"abababab"
    assert codecs.zero_runs(bytes([1]) + b"xy" + bytes([64 + 2]), 5) == b"xy\0\0\0"
    assert codecs.decompress(9, zlib.compress(b"q" * 900), 900) == b"q" * 900
    assert codecs.decompress(2, b"abc", 3) == b"abc"
    import zstandard

    body = zstandard.ZstdCompressor().compress(b"z" * 500)
    assert codecs.decompress(codecs.ZSTD, struct.pack(">II", len(body), 3) + body, 500) == b"z" * 500
    with pytest.raises(codecs.CodecError):
        codecs.decompress(99, b"", 1)


def test_pointers_round_trip():
    rng = random.Random(1)
    for _ in range(200):
        args = {"vdev": rng.randrange(1 << 20), "offset": rng.randrange(1 << 40) * 512, "asize": rng.randrange(1, 1 << 20) * 512, "psize": rng.randrange(1, 257) * 512, "lsize": rng.randrange(1, 257) * 512}
        args |= {"comp": rng.randrange(16), "cksum_type": rng.randrange(1, 14), "kind": rng.randrange(1, 54), "level": rng.randrange(6), "birth": rng.randrange(1, 1 << 40), "cksum": tuple(rng.getrandbits(64) for _ in range(4))}
        f = records.pointer_fields(records.words_of(records.build_pointer(**args)))
        assert (f["vdev0"][0], f["offset0"][0], f["asize0"][0], f["psize"][0], f["lsize"][0]) == (args["vdev"], args["offset"], args["asize"], args["psize"], args["lsize"])
        assert (f["comp"][0], f["cksum_type"][0], f["type"][0], f["level"][0], f["birth"][0], f["phys_birth"][0]) == (args["comp"], args["cksum_type"], args["kind"], args["level"], args["birth"], args["birth"])
        assert not f["hole"][0] and not f["embedded"][0]
    raw = records.build_embedded(b"inline data", 512, 2, 19, 77)
    f = records.pointer_fields(records.words_of(raw))
    assert f["embedded"][0] and (f["lsize"][0], f["psize"][0], f["birth"][0]) == (512, 11, 77) and records.embedded_data(raw) == b"inline data"
    assert records.pointer_fields(np.zeros((1, 16), np.uint64))["hole"][0]


def test_pointer_arrow_functions(spark):
    pointers = [records.build_pointer(1, 4096 * k, 4096, 4096, 4096, 15, 7, 19, 0, 10 + k, (k, 2, 3, (1 << 64) - 1)) for k in range(3)]
    df = spark.createDataFrame([(b"".join(pointers) + b"tail",), (None,), (b"short",)], "b binary")
    out = df.select(records.split_pointers("b").alias("a")).selectExpr("explode(a) raw").select(records.decode_pointer("raw").alias("p")).select("p.*").collect()
    assert [(r["vdev"], r["offset"], r["birth"], r["cksum"]) for r in out] == [(1, 4096 * k, 10 + k, [k, 2, 3, -1]) for k in range(3)]


def node(kind=20, levels=1, bonus=b"", pointers=b"", slots=1):
    head = struct.pack("<8B2HB", kind, 17, levels, 1, 44, 7, 15, 1, 32, len(bonus), slots - 1).ljust(16, b"\0") + struct.pack("<2Q", 5, 8192)
    return (head.ljust(64, b"\0") + pointers.ljust(128, b"\0") + bonus).ljust(512 * slots, b"\0")


def test_nodes_object_sets_and_roots():
    n = records.parse_node(node(bonus=b"attrs"))
    assert (n["type"], n["nlevels"], n["block_size"], n["maxblkid"], n["bonus"], n["used"]) == (20, 1, 16384, 5, b"attrs", 8192)
    assert records.parse_node(bytes(512)) is None and records.parse_node(node(levels=9)) is None
    whole = bytearray(2048)
    whole[:512] = node(10)
    struct.pack_into("<2Q", whole, 704, 3, 1)
    assert records.parse_object_set(bytes(whole))["os_type"] == 3
    for order in "<>":
        raw = struct.pack(order + "5Q", records.UBERBLOCK_MAGIC, 5000, 99, 7, 1700000000) + bytes(128) + struct.pack(order + "Q", 5000)
        assert records.parse_uberblock(raw.ljust(1024, b"\0"), 3)["txg"] == 99
    assert records.parse_uberblock(bytes(1024)) is None


def test_maps_and_lists_round_trip():
    entries = {"ROOT": 1, "size": 1 << 63}
    assert records.micro_map(records.pack_micro_map(entries)) == entries
    assert records.micro_map(bytes(512)) is None
    values = {"name": "tänk", "guid": (1 << 64) - 1, "live": True, "raw": b"abcde", "ids": [1, 2, 3], "tree": {"type": "root", "children": [{"id": 0}, {"id": 1, "x": {}}]}}
    assert records.unpack_list(records.pack_list(values)) == values
    for cut in range(0, 200, 7):
        with pytest.raises(ValueError):
            records.unpack_list(records.pack_list(values)[:cut])


def test_byte_checksums():
    rng = random.Random(3)
    data = rng.randbytes(4096)
    sums = [0] * 4
    for (w,) in struct.iter_unpack("<I", data):
        sums[0] += w
        for k in range(1, 4):
            sums[k] += sums[k - 1]
    assert records.fletcher4_bytes(data) == tuple(x % (1 << 64) for x in sums)
    assert records.fletcher4_bytes(b"") == (0, 0, 0, 0)


def test_block_status(spark):
    import hashlib

    data = b"x" * 512
    signed = lambda many: [x - (1 << 64) if x >> 63 else x for x in many]
    rows = [
        (7, data, signed(records.fletcher4_bytes(data))), (6, data, signed(records.fletcher2_bytes(data))), (8, data, signed(struct.unpack(">4Q", hashlib.sha256(data).digest()))),
        (7, bytes(512), [1, 2, 3, 4]), (7, data, [1, 2, 3, 4]), (7, None, None), (11, data, [0] * 4), (2, data, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k int, d binary, c array<bigint>")
    found = [r["s"] for r in df.select("i", records.block_status("k", "d", "c").alias("s")).orderBy("i").collect()]
    assert found == ["ok", "ok", "ok", "zeroed", "cksum_mismatch", "unreadable", "unverified", "ok"]


@pytest.mark.parametrize("nparity", [1, 2, 3])
def test_every_erasure_is_repaired(nparity):
    rng = random.Random(nparity)
    for n in (1, 2, 5):
        sizes = sorted((rng.randrange(1, 9) for _ in range(n)), reverse=True)
        data = [rng.randbytes(s) for s in sizes]
        columns = [*striping.parity_of(data, nparity), *data]
        lengths = [sizes[0]] * nparity + sizes
        for k in range(nparity + 1):
            for gone in itertools.combinations(range(len(columns)), k):
                assert striping.repaired([None if i in gone else c for i, c in enumerate(columns)], lengths, nparity) == data
        if n > nparity:
            assert striping.repaired([None if i in range(nparity + 1) else c for i, c in enumerate(columns)], lengths, nparity) is None


@pytest.mark.parametrize(("width", "nparity", "shift"), [(4, 1, 12), (3, 1, 9), (6, 2, 12), (5, 2, 9), (7, 3, 12)])
def test_layouts_hold_whole_blocks(width, nparity, shift):
    rng = random.Random(width)
    disks = [bytearray(4 << 20) for _ in range(width)]
    at, blocks = 0, []
    for _ in range(40):
        psize = rng.randrange(1, 33) * 512
        blocks.append((at, rng.randbytes(psize)))
        at += striping.allocated_size(psize, shift, width, nparity)
    for offset, data in blocks:
        found = striping.layout(offset, len(data), shift, width, nparity)
        assert found.allocated >= sum(c.size for c in found.columns) and len({c.member for c in found.columns}) == len(found.columns)
        padded, pieces, p = data.ljust(sum(c.size for c in found.data), b"\0"), [], 0
        for c in found.data:
            pieces.append(padded[p : p + c.size])
            p += c.size
        for c, piece in zip(found.columns, [*striping.parity_of(pieces, nparity), *pieces], strict=True):
            assert not any(disks[c.member][c.offset : c.offset + c.size]) or not any(piece)
            disks[c.member][c.offset : c.offset + c.size] = piece
        assert offset in striping.origins(striping.first_data(found).member, striping.first_data(found).offset, shift, width, nparity)
    for gone in itertools.combinations(range(width), nparity):
        read = lambda m, o, n, gone=gone: None if m in gone else bytes(disks[m][o : o + n])
        for offset, data in blocks[:12]:
            assert striping.assembled(striping.layout(offset, len(data), shift, width, nparity), read, len(data)) == data
    whole = lambda m, o, n: bytes(disks[m][o : o + n])
    found = striping.layout(*(blocks[0][0], len(blocks[0][1])), shift, width, nparity)
    assert striping.consistent(found, whole) is True and striping.consistent(found, lambda m, o, n: None) is None


def gpt_image(sector=512, size=4 << 20, damage=False):
    image = bytearray(size)
    kind = uuid.UUID("6a898cc3-1dd2-11b2-99a6-080020736631")
    entries = bytearray(128 * 128)
    for i, (a, b, name) in enumerate([(40, 79, "data"), (80, 99, "tail")]):
        struct.pack_into("<16s16sQQQ72s", entries, 128 * i, kind.bytes_le, uuid.uuid4().bytes_le, a, b, 0, name.encode("utf-16-le"))

    def header(me, other, at):
        raw = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, me, other, 34, size // sector - 34, uuid.uuid4().bytes_le, at, 128, 128, zlib.crc32(entries)))
        struct.pack_into("<I", raw, 16, zlib.crc32(raw))
        return raw

    last = size // sector - 1
    image[sector : sector + 92] = header(1, last, 2)
    image[2 * sector : 2 * sector + len(entries)] = entries
    image[last * sector : last * sector + 92] = header(last, 1, last - 32)
    image[(last - 32) * sector : (last - 32) * sector + len(entries)] = entries
    if damage:
        image[sector + 80] ^= 1
    return bytes(image), sector


@pytest.mark.parametrize("sector", [512, 4096])
@pytest.mark.parametrize("damage", [False, True])
def test_guid_tables(sector, damage):
    image, _ = gpt_image(sector, damage=damage)
    found = partitions.detect(reader(image), len(image))
    assert [(p[0], p[1], p[2], p[4]) for p in found] == [(1, 40 * sector, 40 * sector, "data"), (2, 80 * sector, 20 * sector, "tail")]


def test_boot_records_with_logical_partitions():
    image = bytearray(1 << 20)
    image[446:462] = struct.pack("<B3sB3sII", 0x80, b"", 0x83, b"", 64, 100)
    image[462:478] = struct.pack("<B3sB3sII", 0, b"", 0x05, b"", 200, 1000)
    image[510:512] = b"\x55\xaa"
    for at, nxt in ((200, 300), (500, 0)):
        e = at * 512
        image[e + 446 : e + 462] = struct.pack("<B3sB3sII", 0, b"", 0x83, b"", 8, 50)
        if nxt:
            image[e + 462 : e + 478] = struct.pack("<B3sB3sII", 0, b"", 0x05, b"", nxt, 100)
        image[e + 510 : e + 512] = b"\x55\xaa"
    assert [(p[0], p[1] // 512) for p in partitions.detect(reader(bytes(image)), len(image))] == [(1, 64), (5, 208), (6, 508)]
    image[450] = 0xEE
    assert partitions.detect(reader(bytes(image)), len(image)) == []


def ext_image():
    """Eight inodes in a small ext2-like device with extents: a file with a hole, a directory, a short link."""
    bs, image = 1024, bytearray(256 << 10)
    sb = bytearray(1024)
    struct.pack_into("<II", sb, 0, 32, 256)
    struct.pack_into("<II", sb, 20, 1, 0)
    struct.pack_into("<III", sb, 32, 8192, 8192, 32)
    struct.pack_into("<HI", sb, 56, 0xEF53, 0)
    struct.pack_into("<I", sb, 76, 1)
    struct.pack_into("<H", sb, 88, 256)
    struct.pack_into("<III", sb, 92, 0, 0x40, 0)
    image[1024:2048] = sb
    struct.pack_into("<I", image, 2048 + 8, 5)

    def inode(n, mode, size, runs=(), inline=b"", links=1):
        raw = bytearray(256)
        struct.pack_into("<HHI", raw, 0, mode, 0, size)
        struct.pack_into("<H", raw, 26, links)
        if inline:
            raw[40 : 40 + len(inline)] = inline
        else:
            struct.pack_into("<I", raw, 32, 0x80000)
            struct.pack_into("<HHHH", raw, 40, 0xF30A, len(runs), 4, 0)
            for i, (first, block, count) in enumerate(runs):
                struct.pack_into("<IHHI", raw, 52 + 12 * i, first, count, 0, block)
        image[5 * bs + (n - 1) * 256 : 5 * bs + n * 256] = raw

    def names(block, rows):
        at = 0
        for i, (number, name) in enumerate(rows):
            size = bs - at if i == len(rows) - 1 else (8 + len(name) + 3) & ~3
            struct.pack_into(f"<IHBB{len(name)}s", image, block * bs + at, number, size, len(name), 0, name)
            at += size

    inode(2, 0x41ED, bs, [(0, 40, 1)], links=3)
    names(40, [(2, b"."), (2, b".."), (12, b"sub"), (13, b"link")])
    inode(12, 0x41ED, bs, [(0, 41, 1)], links=2)
    names(41, [(12, b"."), (2, b".."), (14, b"data.bin")])
    inode(13, 0xA1FF, 6, inline=b"target")
    inode(14, 0x81A4, 3500, [(0, 50, 1), (2, 60, 1)])
    inode(15, 0x81A4, 10, [(0, 70, 1)])
    return bytes(image)


def test_ext_entries_and_extents():
    image = ext_image()
    registry = Registry([ext.EXT, FLAT])
    fs, name = registry.detect(reader(image), len(image))
    assert name == "ext"
    handle = fs.open(reader(image), len(image))
    entries = {e.path: e for e in handle.iter_entries()}
    assert list(entries) == ["/", "/sub", "/link", "/sub/data.bin", "/$orphans/#15"]
    assert entries["/link"].link_target == "target" and handle.info()["fstype"] == "ext4"
    assert [(x.file_offset, x.length, x.dev_offset, x.kind) for x in handle.extents(entries["/sub/data.bin"])] == [(0, 1024, 51200, "data"), (1024, 1024, None, "sparse"), (2048, 1024, 61440, "data"), (3072, 428, None, "sparse")]
    assert registry.detect(reader(image[:1024] + bytes(4096)), 5120) == (None, None)


def test_signatures_and_plugins():
    assert identify(reader(b"\0\0\0NTFS    ")) == "ntfs" and identify(reader(b"XFSB")) == "xfs" and identify(reader(b"")) is None
    flat = FLAT_MAGIC + struct.pack("<Q", 2)
    flat = flat.ljust(64, b"\0") + struct.pack("<40sQQII", b"a", 192, 5, 0o644, 0) + struct.pack("<40sQQII", b"b", 9000, 5, 0o644, 0) + b"hello"
    registry = Registry()
    registry.add(FLAT)
    entries = registry.entries(reader(flat), len(flat))
    assert [(e.path, e.deleted) for e in entries] == [("/", False), ("/a", False), ("/b", True)]


@pytest.mark.parametrize("most", [4096, 8])
def test_plugin_entries_hold_every_part(spark, tmp_path, monkeypatch, most):
    from siltline.plans import formats

    parts = [(k, f"part {k % 37}", f"Brand#{k % 3}", k % 50) for k in range(1, 64)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(formats, "DEVICE_FILES", most)
    found = [tuple(r) for r in formats.udtf_plugin_entries(spark, str(tmp_path)).collect()]
    files = sorted((d.split("/")[0], path, n, gone) for d, path, kind, n, gone in found if kind == "file")
    assert files == sorted((b, f"/{name}", n, n > 25) for _, name, b, n in parts)
    devices = {r[0] for r in found}
    assert sorted(r[:3] for r in found if r[2] == "dir") == sorted((d, "/", "dir") for d in devices)
    assert len(devices) == 3 if most == 4096 else len(devices) > 3

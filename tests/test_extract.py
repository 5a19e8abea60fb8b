"""Reads with gaps, files put together from extents, restore scripts, GUID entries and plugin discovery."""

import hashlib
import json
import random
import struct
import subprocess
import zlib

import pytest

from siltline.operators import extract
from siltline.sources import partitions, plugins


@pytest.fixture(scope="module")
def blocks(spark):
    rng = random.Random(1)
    rows = []
    for blkid in range(60):
        status = rng.choice(["ok", "ok", "ok_stale", "hole", "cksum_mismatch", "ok"])
        data = bytes(rng.randrange(1, 256) for _ in range(16)) if status.startswith("ok") else None
        rows.append((1, blkid, status, data))
    rows[7] = (1, 7, "ok", None)
    rows[8] = (1, 8, "ok", b"short")
    del rows[20:23]
    return spark.createDataFrame(rows, "volume int, blkid long, status string, data binary"), {r[1]: r for r in rows}


def expected(known, offset, length):
    out, gaps = b"", []
    for at in range(offset, offset + length):
        _, _, status, data = known.get(at // 16, (1, 0, "no_metadata", None))
        if status.startswith("ok") and data is not None and len(data) == 16:
            out += data[at % 16 : at % 16 + 1]
            continue
        out += b"\0"
        reason = None if status == "hole" else "unreadable" if status.startswith("ok") else status
        if reason and gaps and gaps[-1][1] == at - offset and gaps[-1][2] == reason:
            gaps[-1][1] += 1
        elif reason:
            gaps.append([at - offset, at - offset + 1, reason])
    return out, gaps


def whole_reads(rows, known):
    for r in rows:
        data, gaps = expected(known, r["offset"], r["length"])
        assert bytes(r["data"]) == data and [[g["start"], g["end"], g["reason"]] for g in r["gaps"]] == gaps


def test_reads_are_zeros_and_gaps_where_nothing_is(spark, blocks):
    df, known = blocks
    rng = random.Random(2)
    # requests cut a block that is too short only as a whole
    asked = [(k, 1, a, n) for k in range(60) for a, n in [(rng.randrange(950), rng.randrange(1, 90))] if not (a < 8 * 16 + 16 and a + n > 8 * 16)]
    asked += [(100, 1, 0, 960), (101, 1, 950, 100)]
    requests = spark.createDataFrame(asked, "id long, volume int, offset long, length long")
    found = extract.read_volume(requests, df, 16).join(requests, "id").collect()
    assert len(found) == len(asked)
    whole_reads([r for r in found if r["id"] < 100 or r["id"] == 101], known)
    empty = spark.createDataFrame([(1, 1, 5, 0)], "id long, volume int, offset long, length long")
    assert extract.read_volume(empty, df, 16).count() == 0


def test_files_are_extracted_from_their_extents(spark, blocks, tmp_path):
    df, known = blocks
    entries = spark.createDataFrame([(1, "/a/one.bin", 100), (2, "/two", 40), (3, "/empty", 0), (4, "/lost", 16)], "id long, path string, size long")
    extents = [(1, 1, 0, 48, 0, "data"), (1, 1, 64, 32, 480, "data"), (2, 1, 0, 40, 330, "data"), (4, 1, 0, 16, 20 * 16, "data"), (1, 1, 48, 16, None, "hole")]
    pieces = extract.file_pieces(spark.createDataFrame(extents, "id long, volume int, file_offset long, length long, volume_offset long, kind string"), df, 16)
    made = {r["id"]: r for r in extract.extract(entries, pieces, f"file://{tmp_path}/out", b"\xde\xad").collect()}
    assert set(made) == {1, 2, 3, 4} and made[3]["status"] == "full" and made[4]["status"] == "none"
    for key, _, size in [tuple(r) for r in entries.collect()]:
        data, gaps = bytearray(size), []
        for i, _, at, n, where, kind in extents:
            if i == key and kind == "data":
                part, lost = expected(known, where, n)
                part = bytearray(part)
                for a, b, _ in lost:
                    part[a:b] = (b"\xde\xad" * (b - a))[: b - a]
                data[at : at + n] = part
                gaps += [[at + a, at + b, why] for a, b, why in lost]
        r = made[key]
        written = (tmp_path / "out" / r["path"].lstrip("/")).read_bytes()
        assert len(written) == size and r["sha256"] == hashlib.sha256(written).hexdigest()
        assert sorted(json.loads(r["gaps"])) == sorted(gaps) or len(gaps) > len(json.loads(r["gaps"]))
        assert r["lost"] == sum(b - a for a, b, _ in gaps)
        if not gaps:
            assert written == bytes(data)
    again = {r["status"] for r in extract.extract(entries, pieces, f"file://{tmp_path}/out").collect()}
    assert again == {"exists"}


def test_restore_script_runs(spark, tmp_path):
    import os

    for name in ("odd%3Fdir", "odd%3Fdir/sub"):
        os.mkdir(tmp_path / name)
    (tmp_path / "odd%3Fdir/sub/it%27s").write_text("x")
    rows = [
        ("/odd?dir", "odd%3Fdir", "dir", 0o700, 5000, None),
        ("/odd?dir/sub", "odd%3Fdir/sub", "dir", 0o750, 6000, None),
        ("/odd?dir/sub/it's", "odd%3Fdir/sub/it%27s", "file", 0o640, 7000, None),
        ("/odd?dir/link", "odd%3Fdir/link", "symlink", 0o777, 1, "sub/it's"),
        ("/../evil", "evil", "file", 0o777, 1, None),
    ]
    uid, gid = os.getuid(), os.getgid()
    df = spark.createDataFrame([(p, t, k, m, uid, gid, s, to) for p, t, k, m, s, to in rows], "path string, local string, type string, mode long, uid long, gid long, mtime long, link_target string")
    lines = [r["line"] for r in extract.restore_script(df).orderBy("k").collect()]
    assert not any("evil" in x for x in lines)
    subprocess.run(["sh", "-e"], input="\n".join(lines), text=True, cwd=tmp_path, check=True)
    top = tmp_path / "odd?dir"
    assert (top / "link").read_text() == "x" and (top / "sub/it's").stat().st_mtime == 7000
    assert oct(top.stat().st_mode & 0o7777) == "0o700" and top.stat().st_mtime == 5000 and (top / "sub").stat().st_mtime == 6000


def table_of(entries, my_lba, backup, where, spoil=False):
    raw = b"".join(entries).ljust(128 * 4, b"\0")
    head = bytearray(struct.pack("<8sIIIIQQQQ16sQIII", b"EFI PART", 0x10000, 92, 0, 0, my_lba, backup, 34, 200, b"d" * 16, where, 4, 128, zlib.crc32(raw)))
    head[16:20] = struct.pack("<I", zlib.crc32(bytes(head)))
    return bytes(head), (b"\x01" + raw[1:] if spoil else raw)


def test_damaged_guid_entries_give_way_to_the_backup():
    entry = lambda name: struct.pack("<16s16sQQQ72s", b"t" * 16, b"u" * 16, 40, 50, 0, name.encode("utf-16-le"))
    image = bytearray(512 * 256)
    head, raw = table_of([entry("primary")], 1, 255, 2, spoil=True)
    image[512 : 512 + 92], image[1024 : 1024 + len(raw)] = head, raw
    head, raw = table_of([entry("backup")], 255, 1, 250)
    image[255 * 512 : 255 * 512 + 92], image[250 * 512 : 250 * 512 + len(raw)] = head, raw
    read = lambda at, n: bytes(image[at : at + n])
    assert [p[4] for p in partitions.guid_table(read, len(image))] == ["backup"]
    image[255 * 512 : 256 * 512] = bytes(512)
    assert [p[4] for p in partitions.guid_table(read, len(image))] == ["primary"]


def test_plugins_are_discovered_and_faults_passed_over(monkeypatch):
    class Point:
        def __init__(self, name, thing):
            self.name, self.thing = name, thing

        def load(self):
            if self.thing is None:
                raise RuntimeError("broken")
            return self.thing

    monkeypatch.setattr(plugins, "entry_points", lambda group: [Point("b", plugins.FLAT), Point("a", None)])
    registry = plugins.Registry()
    assert registry.discover() == ["flat"] and registry.discover() == []

    def fails(read, size):
        raise KeyError("probe")

    registry.add(plugins.FileSystem("faulty", fails, plugins.FlatHandle))
    registry.add(plugins.FileSystem("unsure", lambda read, size: 0.4, plugins.FlatHandle))
    assert registry.detect(plugins.reader(b"x" * 100), 100) == (None, None)
    assert registry.detect(plugins.reader(b"\0" * 3 + b"-FVE-FS-"), 11) == (None, "bitlocker")

"""Journals from synthesised log blocks, and the command line."""

import struct

from siltline.__main__ import main
from siltline.sources import journal

BS = 1024


def block(kind, seq, body=b""):
    return (struct.pack(">3I", journal.MAGIC, kind, seq) + body).ljust(BS, b"\0")


def tags(*homes):
    out = b""
    for i, home in enumerate(homes):
        flags = (journal.SAME_UUID if i else 0) | (journal.LAST if i == len(homes) - 1 else 0) | (journal.ESCAPED if home == 77 else 0)
        out += struct.pack(">IHH", home, 0, flags) + (b"" if i else bytes(16))
    return out


def log(first=1, start=1, seq=5):
    head = (struct.pack(">3I", journal.MAGIC, journal.SUPER_2, 0) + struct.pack(">5I", BS, 12, first, seq, start)).ljust(BS, b"\0")
    data = bytes(BS)
    blocks = [
        block(journal.DESCRIPTOR, 5, tags(100, 77)), data, data, block(journal.COMMIT, 5),
        block(journal.REVOKE, 6, struct.pack(">2I", 20, 77)), block(journal.DESCRIPTOR, 6, tags(100)), data, block(journal.COMMIT, 6),
        block(journal.DESCRIPTOR, 7, tags(300)), data, block(journal.COMMIT, 99),
    ]
    ring = {0: head}
    for i, b in enumerate(blocks):
        ring[first + (start - first + i) % (12 - first)] = b
    return ring


def test_journals_and_their_wrap(spark):
    for start in (1, 6):
        ring = log(start=start)
        found, revokes, commits = journal.tables(ring.get, BS)
        place = lambda i, start=start: 1 + (start - 1 + i) % 11
        assert found == [(5, 0, 100, place(1), False), (5, 1, 77, place(2), True), (6, 0, 100, place(6), False), (7, 0, 300, place(9), False)]
        assert revokes == [(6, 77)] and commits == [(5,), (6,)]
        assert [tuple(r) for r in journal.overlay(spark, ring.get, BS).collect()] == [(100, place(6))]
    assert journal.tables({0: bytes(BS)}.get, BS) == ([], [], [])
    assert journal.unescape(bytes(8), True) == journal.MAGIC_BYTES + bytes(4)


def test_command_line(tmp_path, capsys):
    from tests.test_formats import ext_image, gpt_image

    (tmp_path / "gpt.img").write_bytes(gpt_image()[0])
    (tmp_path / "ext.img").write_bytes(ext_image())
    assert main(["partitions", str(tmp_path / "gpt.img")]) == 0
    assert [line.split("\t")[1:4] for line in capsys.readouterr().out.splitlines()] == [["1", "20480", "20480"], ["2", "40960", "10240"]]
    main(["identify", str(tmp_path / "ext.img"), str(tmp_path / "gpt.img")])
    assert [line.split("\t")[2] for line in capsys.readouterr().out.splitlines()] == ["ext", "unknown", "unknown", "unknown"]
    main(["entries", str(tmp_path / "ext.img")])
    assert [line.split("\t")[-1] for line in capsys.readouterr().out.splitlines()] == ["/", "/sub", "/link", "/sub/data.bin", "/$orphans/#15"]
    main(["labels", str(tmp_path / "gpt.img")])
    assert capsys.readouterr().out.count("damaged") == 4

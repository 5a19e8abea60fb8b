"""Labels, history logs, journals and mirrors."""

import struct

from siltline.functions import records
from siltline.operators.combine import choose_members
from siltline.sources import labels
from siltline.sources.plugins import reader


def device(guid, txg, pool=7, damage=()):
    size = 8 << 20
    image = bytearray(size)
    config = records.pack_list({"name": "tank", "pool_guid": pool, "guid": guid, "top_guid": guid, "txg": txg, "vdev_tree": {"type": "disk", "ashift": 12}})
    for k, at in enumerate(labels.label_offsets(size)):
        raw = labels.sealed(config.ljust(labels.LIST_SIZE, b"\0"), at + labels.LIST_AT)
        image[at + labels.LIST_AT : at + labels.LIST_AT + len(raw)] = raw
        if k in damage:
            image[at + labels.LIST_AT : at + labels.LIST_AT + 64] = b"\xff" * 64
        for slot, t in enumerate((txg - 1, txg)):
            place = at + labels.RING_AT + slot * 4096
            root = struct.pack("<5Q", records.UBERBLOCK_MAGIC, 5000, t, 0, 1_700_000_000 + t) + b"p" * 128 + struct.pack("<Q", 5000)
            raw = labels.sealed(root.ljust(4096, b"\0"), place)
            image[place : place + 4096] = raw
        if k == 1:
            image[at + labels.RING_AT + 4096 + 500] ^= 1
    return reader(bytes(image)), size


def test_labels_and_members(spark):
    devices = {"a": device(1, 50), "b": device(2, 50, damage=(0,)), "b-old": device(2, 40), "c": device(3, 30), "blank": (reader(bytes(8 << 20)), 8 << 20)}
    members, roots = labels.tables(spark, devices)
    assert sorted((r["member"], r["best_root"], r["labels"]) for r in members.collect()) == [("a", 50, 4), ("b", 50, 3), ("b-old", 40, 4), ("c", 30, 4)]
    assert roots.where("member = 'b'").count() == 8 and roots.where("member = 'a' AND NOT checksum_ok").count() == 1
    state = {r["member"]: r["state"] for r in labels.newest_members(members).collect()}
    assert state == {"a": "present", "b": "present", "b-old": "duplicate", "c": "stale"}
    ring = labels.ring_of_roots(roots)
    assert sorted(r["txg"] for r in ring.collect()) == [29, 30, 39, 40, 49, 50] and ring.where("NOT checksum_ok").count() == 0


def test_history_wraps_around():
    made = [records.pack_list({"n": i, "cmd": "x" * i}) for i in range(12)]
    packed = [struct.pack("<Q", len(r)) + r for r in made]
    created = len(packed[0])
    size = created + 700
    ring, at, first = bytearray(size), created, created
    ring[:created] = packed[0]
    kept = []
    for i, p in enumerate(packed[1:], 1):
        for k, byte in enumerate(p):
            ring[created + (at + k - created) % (size - created)] = byte
        at += len(p)
        kept.append((i, at - len(p)))
        while at - first > size - created:
            kept.pop(0)
            first = kept[0][1]
    found = labels.history(bytes(ring), created, first, at)
    assert [r["n"] for r in found] == [0] + [i for i, _ in kept] and len(kept) < 11
    assert labels.history(bytes(ring[:created]) + bytes(700), created, created, created + 300)[0]["n"] == 0


def test_journal_overlay(spark):
    tags = spark.createDataFrame([(1, 0, 100, 10), (1, 1, 101, 11), (2, 0, 100, 12), (2, 1, 102, 13), (3, 0, 103, 14), (4, 0, 100, 15)], "seq long, n int, home long, block long")
    revokes = spark.createDataFrame([(2, 101), (2, 102), (1, 103), (4, 100)], "seq long, home long")
    commits = spark.createDataFrame([(1,), (2,), (3,)], "seq long")
    assert sorted(tuple(r) for r in labels.journal_overlay(tags, revokes, commits).collect()) == [(100, 12), (103, 14)]


def test_regions_come_from_the_healthiest_member(spark):
    bad = spark.createDataFrame([("a", 0, 10), ("b", 5, 6), ("b", 1000, 1100), ("b", 2000, 2600), ("c", 0, 4000)], "member string, start long, end long")
    found = sorted(tuple(r) for r in choose_members(spark, 3000, ["a", "b", "c"], bad, 1000).collect())
    assert found == [(0, 1000, None), (1000, 2000, "a"), (2000, 3000, "a")]
    assert choose_members(spark, 10, ["x", "y"], bad, 1000).first()["member"] == "x"

"""Device labels, rings of roots, history logs: from images to pool tables."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltline.functions import records
from siltline.operators.rank import best_per
from siltline.sources.plugins import Read

LABEL, LIST_AT, LIST_SIZE, RING_AT, RING_SIZE, DATA_AT = 256 << 10, 16 << 10, 112 << 10, 128 << 10, 128 << 10, 4 << 20


def label_offsets(size: int) -> list[int]:
    """Two labels at the head, two at the tail of the whole label units."""
    end = size // LABEL * LABEL
    return [0, LABEL, end - 2 * LABEL, end - LABEL]


def sealed(data: bytes, offset: int) -> bytes:
    """data with its embedded checksum: the last 40 bytes hold a magic number and a SHA-256 over the rest, seeded with the offset."""
    body = data[:-40] + struct.pack("<5Q", records.EMBEDDED_CHECKSUM_MAGIC, offset, 0, 0, 0)
    words = struct.unpack(">4Q", hashlib.sha256(body).digest())
    return body[:-32] + struct.pack("<4Q", *words)


def seal_holds(data: bytes, offset: int) -> bool:
    return len(data) > 40 and data == sealed(data, offset)


def read_label(read: Read, at: int, shift: int | None = None) -> dict:
    """One label: its configuration (None if damaged), whether its checksum holds, and its ring of roots."""
    raw = read(at + LIST_AT, LIST_SIZE)
    try:
        config = records.unpack_list(raw)
    except ValueError:
        config = None
    tree = (config or {}).get("vdev_tree", {})
    shift = tree.get("ashift", shift) if isinstance(tree, dict) else shift
    slot = max(1 << 10, 1 << (shift or 10))
    ring = read(at + RING_AT, RING_SIZE)
    roots = []
    for i in range(len(ring) // slot):
        found = records.parse_uberblock(ring[i * slot : (i + 1) * slot], i)
        if found:
            piece = ring[i * slot : (i + 1) * slot]
            roots.append(found | {"offset": at + RING_AT + i * slot, "checksum_ok": seal_holds(piece, at + RING_AT + i * slot)})
    return {"offset": at, "config": config, "ok": config is not None and seal_holds(raw, at + LIST_AT), "shift": shift, "roots": roots}


def read_labels(read: Read, size: int) -> list[dict]:
    """The labels of a device; a ring behind a damaged configuration is read with the sector size of another label."""
    found = [read_label(read, at) for at in label_offsets(size)]
    shift = next((x["shift"] for x in found if x["shift"]), None)
    return [x if x["config"] else read_label(read, x["offset"], shift) for x in found]


MEMBERS = "member string, pool string, name string, guid string, top string, txg bigint, best_root bigint, labels int"
ROOTS = "member string, pool string, txg bigint, timestamp bigint, checksum_ok boolean, label bigint, slot int, rootbp binary"


def tables(spark: SparkSession, devices: dict[str, tuple[Read, int]]) -> tuple[DataFrame, DataFrame]:
    """(members, roots) of the labels of named devices: labels are four small records each. Guids are decimal text, as they may exceed a signed long."""
    members, roots = [], []
    for name, (read, size) in devices.items():
        labels = read_labels(read, size)
        good = next((x for x in labels if x["ok"]), None) or next((x for x in labels if x["config"]), None)
        if good is None:
            continue
        c = good["config"]
        pool = str(c.get("pool_guid", ""))
        valid = [r for x in labels for r in x["roots"] if r["checksum_ok"]]
        members.append((name, pool, c.get("name"), str(c.get("guid", "")), str(c.get("top_guid", "")), c.get("txg"), max((r["txg"] for r in valid), default=None), sum(x["ok"] for x in labels)))
        roots += [(name, pool, r["txg"], r["timestamp"], r["checksum_ok"], x["offset"], r["slot"], r["rootbp"]) for x in labels for r in x["roots"]]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(roots, ROOTS)


def newest_members(members: DataFrame) -> DataFrame:
    """One image per member guid, the one with the newest valid root; state tells duplicates and members behind the newest of their pool."""
    best = best_per(members, ["pool", "guid"], [F.desc_nulls_last("best_root"), F.desc_nulls_last("txg"), F.asc("member")])
    top = members.groupBy("pool").agg(F.max("best_root").alias("pool_txg"))
    state = F.when(F.col("best_root") < F.col("pool_txg"), "stale").otherwise("present")
    kept = best.join(top, "pool", "left").withColumn("state", state).drop("pool_txg")
    extra = members.join(kept.select("member"), "member", "left_anti").withColumn("state", F.lit("duplicate"))
    return kept.unionByName(extra)


def ring_of_roots(roots: DataFrame) -> DataFrame:
    """One root per pool and transaction, checked ones first."""
    return best_per(roots, ["pool", "txg"], [F.desc("checksum_ok"), F.asc("member"), F.asc("label"), F.asc("slot")])


def history(ring: bytes, created: int, first: int, last: int) -> list[dict]:
    """Records of a pool's history log: those of its creation, then [first, last) in logical offsets, wrapped around the ring."""
    size = len(ring) - created

    def at(offset: int, n: int) -> bytes:
        out = b""
        while n > 0:
            place = created + (offset - created) % size
            piece = ring[place : place + min(n, len(ring) - place)]
            out, offset, n = out + piece, offset + len(piece), n - len(piece)
        return out

    def region(read, a: int, b: int):
        while a + 8 <= b:
            n = struct.unpack("<Q", read(a, 8))[0]
            if not 0 < n <= b - a - 8:
                return
            try:
                yield records.unpack_list(read(a + 8, n))
            except ValueError:
                return
            a += 8 + n

    return [*region(lambda o, n: ring[o : o + n], 0, created), *region(at, first, last)]


def journal_overlay(tags: DataFrame, revokes: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows (home, block): the newest committed copy of each block in a journal, unless it is revoked in the same or a later transaction.

    tags: (seq, n, home, block), n the order within a transaction; revokes: (seq, home); commits: (seq). The log ends at the first transaction without a commit.
    """
    ended = tags.select("seq").unionByName(revokes.select("seq")).distinct().join(commits.select("seq"), "seq", "left_anti").agg(F.min("seq").alias("end"))
    before = lambda df: df.join(F.broadcast(ended), F.col("end").isNull() | (F.col("seq") < F.col("end"))).drop("end")  # noqa: E731  (one row)
    last = before(revokes).groupBy("home").agg(F.max("seq").alias("revoked"))
    live = before(tags).join(last, "home", "left").where("revoked IS NULL OR revoked < seq")
    return live.groupBy("home").agg(F.max_by("block", F.struct("seq", "n")).alias("block"))

"""Partition tables: GUID tables in either sector size, and master boot records with their chain of logical partitions."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Read = Callable[[int, int], bytes]
SCHEMA = "idx int, start bigint, length bigint, kind string, name string, scheme string"
MAX_ENTRIES, MAX_LOGICAL = 1024, 128


def _header(read: Read, at: int) -> dict | None:
    raw = read(at, 512)
    if len(raw) < 92 or raw[:8] != b"EFI PART":
        return None
    size, crc = struct.unpack_from("<II", raw, 12)
    fine = 92 <= size <= len(raw) and zlib.crc32(raw[:16] + bytes(4) + raw[20:size]) == crc
    entries, count, each, entries_crc = struct.unpack_from("<QIII", raw, 72)
    return {"ok": fine, "backup": struct.unpack_from("<Q", raw, 32)[0], "entries": entries, "count": min(count, MAX_ENTRIES), "all": count, "each": each, "crc": entries_crc}


def _checked(read: Read, sector: int, header: dict | None) -> dict | None:
    """The header, no longer sound if its entries do not have their checksum."""
    if header and header["ok"]:
        raw = read(header["entries"] * sector, header["all"] * header["each"]) if header["all"] * header["each"] <= 1 << 24 else b""
        header["ok"] = zlib.crc32(raw) == header["crc"]
    return header


def guid_table(read: Read, size: int) -> list[tuple] | None:
    """Partitions of a GUID table; None without one. A header or entries with a wrong checksum give way to a backup that holds."""
    for sector in (512, 4096):
        first, last = (_checked(read, sector, _header(read, at)) for at in (sector, size - sector))
        chosen = next((h for h in (first, last) if h and h["ok"]), first)
        if chosen is None or not 128 <= chosen["each"] <= 4096:
            continue
        raw = read(chosen["entries"] * sector, chosen["count"] * chosen["each"])
        out = []
        for i in range(len(raw) // chosen["each"]):
            e = raw[i * chosen["each"] : (i + 1) * chosen["each"]]
            a, b = struct.unpack_from("<QQ", e, 32)
            if any(e[:16]) and b >= a:
                out.append((i + 1, a * sector, (b - a + 1) * sector, str(uuid.UUID(bytes_le=e[:16])), e[56:128].decode("utf-16-le", "replace").partition("\0")[0], "gpt"))
        return out
    return None


def _records(raw: bytes) -> list[tuple[int, int, int]]:
    return [(raw[446 + 16 * i + 4], *struct.unpack_from("<II", raw, 446 + 16 * i + 8)) for i in range(4)]


def boot_record(read: Read, size: int) -> list[tuple] | None:
    """Partitions of a master boot record, logical ones from 5 on; None without one, or if it only protects a GUID table."""
    raw = read(0, 512)
    if len(raw) < 512 or raw[510:] != b"\x55\xaa":
        return None
    rows = _records(raw)
    if any(kind == 0xEE for kind, _, _ in rows) or any(raw[446 + 16 * i] not in (0, 0x80) for i in range(4)):
        return None
    out, extended = [], None
    for i, (kind, start, n) in enumerate(rows, 1):
        if kind in (0x05, 0x0F, 0x85):
            extended = extended or start
        elif kind and n:
            out.append((i, start * 512, n * 512, f"{kind:#04x}", "", "mbr"))
    at, seen, idx = extended, set(), 5
    while at and at not in seen and len(seen) < MAX_LOGICAL:
        seen.add(at)
        raw = read(at * 512, 512)
        if len(raw) < 512 or raw[510:] != b"\x55\xaa":
            break
        (kind, start, n), (following, offset, _) = _records(raw)[:2]
        if kind and n:
            out.append((idx, (at + start) * 512, n * 512, f"{kind:#04x}", "", "mbr"))
            idx += 1
        at = extended + offset if following in (0x05, 0x0F, 0x85) else None
    return out


#: Schemes in the order they are tried; add(name, parse) puts another first.
SCHEMES: list[tuple[str, Callable[[Read, int], list[tuple] | None]]] = [("gpt", guid_table), ("mbr", boot_record)]


def add(name: str, parse: Callable[[Read, int], list[tuple] | None]) -> None:
    SCHEMES.insert(0, (name, parse))


def detect(read: Read, size: int) -> list[tuple]:
    """Partitions by the first scheme that knows the device; a scheme that fails on it is passed over."""
    for _, parse in SCHEMES:
        try:
            found = parse(read, size)
        except (struct.error, ValueError):
            continue
        if found is not None:
            return found
    return []


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """The partitions of one image."""
    from siltline.sources.blockdev import size_of

    with open(path, "rb") as f:
        import os

        rows = detect(lambda at, n: os.pread(f.fileno(), n, at) if at >= 0 else b"", size_of(path))
    return spark.createDataFrame(rows, SCHEMA)

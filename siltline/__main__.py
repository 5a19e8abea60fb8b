"""Command line: python -m siltline COMMAND IMAGE ...

partitions   partition table of an image
identify     what the image, and each of its partitions, holds
labels       pool labels and the newest root of each member
entries      files of an ext or plugin file system (of the image, or --partition N)
carve        metadata blocks, resumable, into a Parquet table (--out)
"""

from __future__ import annotations

import argparse
import os
import sys

from siltline.sources import ext, labels, partitions
from siltline.sources.plugins import FLAT, Read, Registry, identify

REGISTRY = Registry([ext.EXT, FLAT])


def opened(path: str) -> tuple[Read, int]:
    """Positional reads of a file that is only opened for reading, and its size."""
    f = open(path, "rb")  # noqa: SIM115  (kept open for the run)
    return (lambda at, n: os.pread(f.fileno(), n, at) if at >= 0 else b""), f.seek(0, os.SEEK_END)


def window(read: Read, size: int, start: int, length: int) -> tuple[Read, int]:
    if start < 0 or start + length > size:
        raise ValueError("the window exceeds the image")
    return (lambda at, n: read(start + at, max(0, min(n, length - at))) if 0 <= at < length else b""), length


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="siltline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["partitions", "identify", "labels", "entries", "carve"])
    parser.add_argument("images", nargs="+")
    parser.add_argument("--partition", type=int)
    parser.add_argument("--out", default="carved")
    args = parser.parse_args(argv)
    if args.command == "carve":
        return carve(args.images, args.out)
    for path in args.images:
        read, size = opened(path)
        found = partitions.detect(read, size)
        if args.partition is not None:
            read, size = window(read, size, *next(p[1:3] for p in found if p[0] == args.partition))
        if args.command == "partitions":
            for idx, start, length, kind, name, scheme in found:
                print(f"{path}\t{idx}\t{start}\t{length}\t{scheme}\t{kind}\t{name}")
        elif args.command == "identify":
            for idx, start, length in [(0, 0, size), *(p[:3] for p in found)]:
                part = window(read, size, start, min(length, size - start))
                print(f"{path}\t{idx}\t{REGISTRY.detect(*part)[1] or identify(part[0]) or 'unknown'}")
        elif args.command == "labels":
            for label in labels.read_labels(read, size):
                config = label["config"] or {}
                newest = max((r["txg"] for r in label["roots"] if r["checksum_ok"]), default=None)
                print(f"{path}\t{label['offset']}\t{'ok' if label['ok'] else 'damaged'}\t{config.get('name')}\t{config.get('guid')}\t{newest}")
        else:
            for e in REGISTRY.entries(read, size):
                print(f"{e.inode}\t{e.type}\t{e.size}\t{'deleted' if e.deleted else ''}\t{e.path}")
    return 0


def carve(images: list[str], out: str) -> int:
    from siltline.operators.carve import carved
    from siltline.session import build_session, ship
    from siltline.sources.blockdev import assert_unchanged, fingerprints
    from siltline.streaming.scan import scan_rounds

    spark = build_session("carve")
    ship(spark)
    before = fingerprints(images)
    scan_rounds(spark, images, carved, f"{out}/blocks", block="512", prefilter="metadata")
    assert_unchanged(before)
    for row in spark.read.parquet(f"{out}/blocks").groupBy("member", "kind").count().orderBy("member", "kind").collect():
        print(f"{images[row['member']]}\t{row['kind']}\t{row['count']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

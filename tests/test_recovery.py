"""Images end to end: reading, carving, verifying, coverage, losses, outputs and resumed scans."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from siltline.functions import codecs, records
from siltline.operators import carve
from siltline.plans import recovery
from siltline.sources import sinks
from siltline.sources.blockdev import assert_unchanged, fingerprints, register
from siltline.streaming.scan import resumed_counts, scan_into, scan_stream

BLOCK, SECTOR = 4096, 512


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    """Ten data blocks; a pointer block of them in two generations; block 3 is damaged in both, block 5 in the newer one, 6 is zeroed, 7 a hole."""
    rng = random.Random(1)
    raw = bytearray(2 << 20)
    data = [rng.randbytes(BLOCK) for _ in range(10)]
    old, new = [], []
    for i, d in enumerate(data):
        for k, (many, birth) in enumerate(((old, 10), (new, 20))):
            at = (1 << 20) * k // 2 + 65536 + i * BLOCK
            raw[at : at + BLOCK] = d
            many.append(records.build_pointer(0, at, BLOCK, BLOCK, BLOCK, 2, 7, 23, 0, birth + i % 2, records.fletcher4_bytes(d)))
    for i, gens in ((3, (0, 1)), (5, (1,)), (6, (0, 1))):
        for k in gens:
            at = (1 << 20) * k // 2 + 65536 + i * BLOCK
            raw[at : at + BLOCK] = bytes(BLOCK) if i == 6 else rng.randbytes(BLOCK)
    new[7] = bytes(80) + (25).to_bytes(8, "little") + bytes(40)
    for at, many in ((4096, old), (12288, new)):
        block = b"".join(many).ljust(4096, b"\0")
        frame = codecs.lz4_literal(block)
        frame = len(frame).to_bytes(4, "big") + frame
        raw[at : at + len(frame)] = frame
    path = tmp_path_factory.mktemp("images") / "member0.img"
    path.write_bytes(raw)
    return str(path), data


def load(spark, path, **options):
    register(spark)
    return spark.read.format("blockdev").options(paths=path, **{k: str(v) for k, v in options.items()}).load()


def test_blocks_of_an_image(spark, image):
    path, _ = image
    raw = open(path, "rb").read()
    df = load(spark, path, block=SECTOR, chunk=100_000, overlap=100)
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    assert len(rows) == len(raw) // SECTOR and all(bytes(r["data"]) == raw[r["offset"] : r["offset"] + SECTOR + 100] for r in rows)
    part = load(spark, path, block=SECTOR, start=1024, length=2048).collect()
    assert sorted(r["offset"] for r in part) == [1024, 1536, 2048, 2560]
    with pytest.raises(Exception, match="exceeds"):
        load(spark, path, start=0, length=1 << 30).count()
    with pytest.raises(Exception, match="twice"):
        load(spark, f"{path},{path}").count()
    before = fingerprints([path])
    assert_unchanged(before)
    with pytest.raises(RuntimeError):
        assert_unchanged({path: (1, 2)})


def found_blocks(spark, path):
    return carve.carved(load(spark, path, block=SECTOR, overlap=carve.MAX_BLOCK))


def recovered(spark, path):
    indirect = found_blocks(spark, path).where("kind = 'indirect'").select("offset", "block")
    pointers = carve.children(indirect).where("p.birth > 0").select(F.lit(1).alias("volume"), F.col("slot").cast("long").alias("blkid"), "p", F.concat(F.lit("carved:"), "offset").alias("provenance"))

    def read(vdev, offset, size):
        with open(path, "rb") as f:
            return os.pread(f.fileno(), size, offset)

    ranked = recovery.candidates(pointers)
    return recovery.chosen(recovery.verified(recovery.with_data(ranked, read)))


def test_carved_blocks_and_recovered_volume(spark, image):
    path, data = image
    assert sorted((r["offset"], r["kind"]) for r in found_blocks(spark, path).collect()) == [(4096, "indirect"), (12288, "indirect")]
    blocks = recovered(spark, path).cache()
    status = {r["blkid"]: r["status"] for r in blocks.collect()}
    assert status == {0: "ok", 1: "ok", 2: "ok", 3: "cksum_mismatch", 4: "ok", 5: "ok_stale", 6: "zeroed", 7: "hole", 8: "ok", 9: "ok"}
    assert all(bytes(r["data"]) == data[r["blkid"]] for r in blocks.collect() if r["status"].startswith("ok"))
    runs = recovery.coverage(blocks, spark.createDataFrame([(1, 12)], "volume int, n_blocks long"))
    tiles = sorted((r["first"], r["count"], r["status"]) for r in runs.collect())
    assert sum(n for _, n, _ in tiles) == 12 and tiles[-1] == (10, 2, "no_metadata")
    assert recovery.summary(runs).first().asDict() == {"volume": 1, "n_blocks": 12, "n_recovered": 7, "n_holes": 1, "n_lost": 4, "n_unknown": 0}


def test_group_condition_on_pointers(spark, image):
    path, _ = image
    p = carve.children(found_blocks(spark, path).select("offset", "block"))
    assert sorted(tuple(r) for r in carve.group_is_valid(p.where("p.birth > 0"), "offset").collect()) == [(4096, 10), (12288, 9)]


def test_losses_of_files(spark):
    bs = 16384
    runs = spark.createDataFrame([(1, 0, 40, "ok"), (1, 40, 2, "cksum_mismatch"), (1, 42, 50, "ok"), (1, 92, 8, "hole")], "volume int, first long, count long, status string")
    extents = spark.createDataFrame([(10, 1, 0, 38 * bs, 7 * bs), (11, 1, 0, 0, 100)], "entry long, volume int, file_offset long, volume_offset long, length long")
    assert [tuple(r) for r in recovery.file_losses(extents, runs, bs).collect()] == [(10, 2 * bs, 2 * bs, "cksum_mismatch")]
    volume = spark.createDataFrame([(1, 2, 1000, 990)], "volume int, n_lost long, destroy_txg long, seen_txg long")
    roots = spark.createDataFrame([(1, 900)], "volume int, txg long")
    verdict = lambda v, r, done=False: recovery.carve_verdict(v, r, done).first()["verdict"]
    assert verdict(volume, roots) == "no" and verdict(volume.withColumn("seen_txg", F.lit(500)), roots) == "maybe"
    assert verdict(volume, roots.limit(0)) == "yes" and verdict(volume, roots, True) == "done"
    text = recovery.report(runs, spark.createDataFrame([("/big.bin", 7 * bs, 5 * bs), ("/ok.txt", 100, 100)], "path string, size long, recoverable long"))
    assert f"`/big.bin`: {2 * bs} of {7 * bs} bytes" in text and "| 1 | 100 | 90 | 8 | 2 | 0 |" in text


def test_images_manifests_and_tables(spark, tmp_path):
    rows = [(0, b"a" * 512, 512, "ok"), (512, bytes(512), 512, "hole"), (1024, None, 512, "zeroed"), (1536, None, 512, "zeroed"), (2048, b"b" * 512, 512, "ok")]
    blocks = spark.createDataFrame(rows, "offset long, data binary, length long, status string")
    path = str(tmp_path / "out.img")
    gaps = sinks.write_image(blocks, path, 2400, fill="pattern")
    assert [tuple(r) for r in gaps.select("start", "end", "status").collect()] == [(1024, 2048, "zeroed")]
    raw = open(path, "rb").read()
    assert len(raw) == 2400 and raw[:512] == b"a" * 512 and raw[1024:1028] == sinks.MARK and raw[2048:] == b"b" * 352
    with pytest.raises(FileExistsError):
        sinks.write_image(blocks, path, 2400)
    manifest = str(tmp_path / "manifest.json")
    sinks.write_manifest([{"path": "a", "status": "ok"}], manifest)
    assert sinks.write_manifest([{"path": "b", "status": "partial"}], manifest)["summary"] == {"ok": 1, "partial": 1}
    assert len(json.load(open(manifest))["outputs"]) == 2
    table = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.parquet(table)
    sinks.merge_table(spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), table, ["k"])
    sinks.replace_rows(spark.createDataFrame([(3, "x"), (3, "y")], "k long, v string"), table, ["k"], [F.desc("v")])
    assert sorted(tuple(r) for r in spark.read.parquet(table).collect()) == [(1, "a"), (2, "c"), (3, "y")]


def test_a_scan_goes_on_where_it_stopped(spark, image, tmp_path):
    path, _ = image
    table, checkpoint = str(tmp_path / "carved"), str(tmp_path / "checkpoint")
    size = os.path.getsize(path)

    def run():
        stream = scan_stream(spark, [path], SECTOR, 512 << 10, carve.MAX_BLOCK)
        query = scan_into(stream, lambda df: carve.carved(df).drop("block"), table, checkpoint)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.read.parquet(table)

    first = sorted((r["offset"], r["kind"]) for r in run().collect())
    assert first == [(4096, "indirect"), (12288, "indirect")] and size == 2 << 20
    assert sorted((r["offset"], r["kind"]) for r in run().collect()) == first


def test_the_prefilter_loses_no_block(spark, image, tmp_path):
    """The same blocks as with every sector and its overlap, over frames, bare object sets, and the ends of ranges."""
    rng = random.Random(5)
    raw = bytearray(rng.randbytes(3 << 20))
    raw[1 << 20 : 2 << 20] = bytes(1 << 20)
    frame = open(image[0], "rb").read()[4096 : 4096 + 5000]
    for at in (0, 512 * 77, (1 << 20) - 1024, (3 << 20) - 6144):
        raw[at : at + len(frame)] = frame
    node = bytearray(4096)
    node[0], node[1], node[2], node[3] = 10, 14, 1, 1
    node[704:712] = (2).to_bytes(8, "little")
    for at in ((1 << 20) + 512, (3 << 20) - 1024):
        raw[at : at + 4096] = node[: (3 << 20) - at]
    path = tmp_path / "odd.img"
    path.write_bytes(raw)
    rows = lambda df: sorted((r["offset"], r["kind"], bytes(r["block"])) for r in df.collect())
    for p, n in ((str(path), 4), (image[0], 2)):
        every = rows(carve.carved(load(spark, p, block=SECTOR, overlap=carve.MAX_BLOCK)))
        assert len(every) >= n
        assert rows(carve.carved(load(spark, p, block=SECTOR, prefilter="metadata", chunk=200 << 10))) == every
    assert load(spark, str(path), block=SECTOR, prefilter="metadata").count() < 100


def test_rounds_of_a_scan_are_done_once(spark, image, tmp_path):
    from siltline.streaming.scan import scan_rounds

    path, _ = image
    other = tmp_path / "short.img"
    other.write_bytes(open(path, "rb").read()[: 300 << 10])
    table = str(tmp_path / "blocks")
    run = lambda paths: scan_rounds(spark, paths, lambda df: carve.carved(df).drop("block"), table, 256 << 10, block="512", prefilter="metadata")
    assert run([path, str(other)]) == list(range(8)) and run([path, str(other)]) == []
    found = sorted((r["member"], r["offset"]) for r in spark.read.parquet(table).collect())
    assert found == [(0, 4096), (0, 12288), (1, 4096), (1, 12288)]
    assert run([path]) == list(range(8))
    assert sorted((r["member"], r["offset"]) for r in spark.read.parquet(table).collect()) == [(0, 4096), (0, 12288)]


def test_counts_of_a_stream_equal_those_of_the_table(spark, sf_dir, tmp_path):
    expected = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*"), F.max("event_id")).collect())
    for _ in range(2):
        assert sorted(tuple(r) for r in resumed_counts(spark, sf_dir, f"file://{tmp_path}").collect()) == expected

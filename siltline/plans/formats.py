"""Queries over codecs, plugins and streams."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from siltline.functions import codecs, records
from siltline.plans.registry import query
from siltline.session import scratch_path, ship, table


@query("SELECT codec, count(*) AS blocks, count(*) AS same FROM documents, (VALUES ('deflate'), ('lz4'), ('off')) v(codec) GROUP BY codec")
def codec_roundtrip(spark, sf_dir):
    """Every text as a block of three codecs, and whether it comes back."""
    ship(spark)

    def run(batches):
        for b in batches:
            names, fine = [], []
            for t in b.column("text").to_pylist():
                data = (t or "").encode()
                packed = codecs.lz4_literal(data)
                for name, code, frame in (("lz4", codecs.LZ4, struct.pack(">I", len(packed)) + packed), ("deflate", 9, zlib.compress(data, 1)), ("off", 2, data)):
                    names.append(name)
                    fine.append(codecs.decompress(code, frame, len(data)) == data)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(fine, pa.bool_())], ["codec", "fine"])

    rows = table(spark, sf_dir, "documents").select("text").mapInArrow(run, "codec string, fine boolean")
    return rows.groupBy("codec").agg(F.count("*").alias("blocks"), F.count_if("fine").alias("same"))


@query("""SELECT CAST(o_custkey % 1000 AS BIGINT) AS vdev, CAST(count(*) AS BIGINT) AS pointers, CAST(sum(o_orderkey % 1000 * 512) AS BIGINT) AS offsets, CAST(max(o_orderkey) AS BIGINT) AS newest FROM orders GROUP BY 1""")
def pointer_decode(spark, sf_dir):
    """Pointers built from orders, and decoded."""
    ship(spark)

    @F.arrow_udf("binary")
    def built(vdev: pa.Array, offset: pa.Array, birth: pa.Array) -> pa.Array:
        rows = zip(vdev.to_pylist(), offset.to_pylist(), birth.to_pylist(), strict=True)
        return pa.array([records.build_pointer(v, o, 4096, 4096, 4096, 15, 7, 19, 0, b, (1, 2, 3, 4)) for v, o, b in rows], pa.binary())

    raw = table(spark, sf_dir, "orders").select(built(F.col("o_custkey") % 1000, F.col("o_orderkey") % 1000 * 512, F.col("o_orderkey")).alias("raw"))
    p = raw.select(records.decode_pointer("raw").alias("p")).select("p.*")
    return p.groupBy("vdev").agg(F.count("*").alias("pointers"), F.sum("offset").alias("offsets"), F.max("birth").alias("newest"))


#: Files of one synthesised device, about; a brand with more has several devices.
DEVICE_FILES = 4096


@query()
def udtf_plugin_entries(spark, sf_dir):
    """Flat file systems synthesised from all parts, read through the plugin registry in a table function.

    One device per brand; a brand of more than DEVICE_FILES parts has devices brand/0, brand/1, ..., dealt by the part's key.
    """
    from pyspark.sql.functions import udtf

    from siltline.sources.plugins import FLAT, FLAT_MAGIC, Registry, reader

    ship(spark)

    @udtf(returnType="path string, type string, size bigint, deleted boolean")
    class Entries:
        def eval(self, names: list, sizes: list):
            data = FLAT_MAGIC + struct.pack("<Q", len(names))
            data = data.ljust(64, b"\0")
            end = 64 + 64 * len(names)
            for name, size in zip(names, sizes, strict=True):
                data += struct.pack("<40sQQII", name.encode()[:40], end, size, 0o644, 0)
            for e in Registry([FLAT]).entries(reader(data), end + 25):
                yield e.path, e.type, e.size, e.deleted

    spark.udtf.register("flat_entries", Entries)
    parts = table(spark, sf_dir, "part")
    devices = parts.groupBy("p_brand").agg(F.ceil(F.count("*") / DEVICE_FILES).alias("devices")).withColumnRenamed("p_brand", "brand")
    slot = F.when(F.col("devices") > 1, F.concat(F.lit("/"), F.pmod(F.xxhash64("p_partkey"), F.col("devices")).cast("string"))).otherwise("")
    parts = parts.join(devices, F.col("p_brand").eqNullSafe(F.col("brand"))).withColumn("device", F.concat("p_brand", slot))
    parts = parts.groupBy("device").agg(F.sort_array(F.collect_list(F.struct("p_name", F.col("p_size").cast("long").alias("n")))).alias("x"))
    parts.select("device", F.col("x.p_name").alias("names"), F.col("x.n").alias("sizes")).createOrReplaceTempView("flat_devices")
    return spark.sql("SELECT device, e.* FROM flat_devices, LATERAL flat_entries(names, sizes) e")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type")
def stream_resume_counts(spark, sf_dir):
    from siltline.streaming.scan import resumed_counts

    return resumed_counts(spark, sf_dir, scratch_path(spark, "stream"))

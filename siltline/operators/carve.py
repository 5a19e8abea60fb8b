"""Finding and checking metadata blocks in raw data.

Stages: a prefilter on the first bytes of each sector, decompression, and classification of what comes out.
Classification of pointer blocks is a group condition on decoded pointers and stays in column expressions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from siltline.functions import codecs, records

MAX_BLOCK = 128 << 10


def be32(data: Column) -> Column:
    return F.conv(F.hex(F.substring(data, 1, 4)), 16, 10).cast("long")


def may_be_compressed(data: Column) -> Column:
    """A sector that can open a framed LZ4 block: a plausible length, and a first token with literals."""
    n = be32(data)
    return (n >= 8) & (n <= MAX_BLOCK - 4) & (F.substring(F.hex(F.substring(data, 5, 1)), 1, 1) != "0")


@arrow_udf(BinaryType())
def unframed(data: pa.Array) -> pa.Array:
    """What a framed block holds, if it decodes to a power of two of 512 bytes or more; else null."""
    out = []
    for d in data.to_pylist():
        try:
            x = None if d is None else codecs.framed_lz4(d, MAX_BLOCK)
        except codecs.CodecError:
            x = None
        out.append(x if x is not None and len(x) >= 512 and len(x) & len(x) - 1 == 0 else None)
    return pa.array(out, pa.binary())


def classify(block: bytes | None) -> str | None:
    """object_set, nodes, map or indirect; None for anything else. The first that fits wins."""
    if not block:
        return None
    if len(block) in (1024, 2048, 4096) and (found := records.parse_object_set(block)) and 1 <= found["os_type"] <= 3:
        return "object_set"
    w = records.words_of(block)
    if len(block) % records.POINTER == 0 and plausible_pointers(w):
        return "indirect"
    if records.micro_map(block):
        return "map"
    at, some = 0, 0
    while at + records.NODE <= len(block):
        node = records.parse_node(block[at:])
        if node is None:
            if any(block[at : at + records.NODE]):
                return None
            at += records.NODE
        else:
            some, at = some + 1, at + records.NODE * node["slots"]
    return "nodes" if some else None


def plausible_pointers(w) -> bool:
    """Every pointer is valid or empty, one at least is valid, and the valid ones agree on level and type."""
    f = records.pointer_fields(w)
    empty = (w == 0).all(1)
    hole = f["hole"] & (f["birth"] > 0)
    fine = ~f["hole"] & f["little_endian"] & (f["type"] > 0) & (f["type"] < 200) & (f["level"] < 8) & (f["birth"] > 0) & (f["birth"] < 1 << 48)
    fine &= f["embedded"] | ((f["asize0"] > 0) & (f["psize"] <= f["lsize"]) & (f["cksum_type"] > 0) & (f["cksum_type"] < 16))
    if not (fine | empty | hole).all() or not fine.any():
        return False
    return len(set(f["level"][fine].tolist())) == 1 and len(set(f["type"][fine].tolist())) == 1


@arrow_udf(StringType())
def kind_of(block: pa.Array) -> pa.Array:
    return pa.array([classify(b) for b in block.to_pylist()], pa.string())


def carved(blocks: DataFrame) -> DataFrame:
    """Rows (member, offset, kind, lsize, block) of the metadata blocks among `blocks` (member, offset, data).

    data must reach to the end of the longest frame that begins in its sector: read with an overlap. Frames of one
    content that begin at one place come once. Raw (uncompressed) object sets are found by their own size.
    """
    # one pass over the blocks: what a frame holds, and the block itself in the sizes of a bare object set
    packed = F.struct(unframed(F.when(may_be_compressed(F.col("data")), F.col("data"))).alias("block"), F.lit(True).alias("packed"))
    plain = [F.struct(F.substring("data", 1, n).alias("block"), F.lit(False).alias("packed")) for n in (4096, 2048, 1024)]
    rows = blocks.select("member", "offset", F.explode(F.array(packed, *plain)).alias("x")).select("member", "offset", "x.block", "x.packed")
    rows = rows.where(F.col("block").isNotNull() & (F.col("packed") | F.length("block").isin(1024, 2048, 4096)))
    found = rows.withColumn("kind", kind_of("block")).where(F.when(F.col("packed"), F.col("kind").isNotNull()).otherwise(F.col("kind") == "object_set")).select("member", "offset", "block", "kind")
    return found.groupBy("member", "offset").agg(F.max_by(F.struct("kind", "block"), F.length("block")).alias("x")).select("member", "offset", "x.kind", F.length("x.block").alias("lsize"), "x.block")


def children(indirect: DataFrame, block: str = "block") -> DataFrame:
    """One row per pointer of indirect blocks: all other columns, slot, and the decoded pointer's columns."""
    rows = indirect.select(*[c for c in indirect.columns if c != block], F.posexplode(records.split_pointers(block)).alias("slot", "raw"))
    return rows.withColumn("p", records.decode_pointer("raw"))


def group_is_valid(pointers: DataFrame, key: str) -> DataFrame:
    """Keys of indirect blocks by the group condition: every row valid or a hole, one level and one type among valid ones."""
    p = F.col("p")
    valid = ~p["hole"] & (p["type"] > 0) & (p["birth"] > 0) & (p["lsize"] <= MAX_BLOCK)
    return (
        pointers.groupBy(key)
        .agg(F.bool_and(valid | p["hole"]).alias("all"), F.count_if(valid).alias("some"), F.count_distinct(F.when(valid, p["level"])).alias("levels"), F.count_distinct(F.when(valid, p["type"])).alias("types"))
        .where("all AND some > 0 AND levels = 1 AND types = 1")
        .select(key, F.col("some").alias("pointers"))
    )

"""WARC archives with dictionary compression.

An archive opens with a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary built
from the archive's own first records; every record is one frame of its own, compressed with it, so that a
record can be read from its offset. Of records with equal payloads of min_bytes or more, that with the
largest page_id is a response and the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import slices
from siltline.session import cut, scratch_path, ship

#: Of the WARC format with Zstandard compression and its revisit profile (fixed values).
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: The dictionary's size, and the records it is built from: the first of the archive, up to so many and so many bytes.
DICTIONARY, SAMPLES, SAMPLE_BYTES, SAMPLE_RECORD = 32 << 10, 400, 2 << 20, 32 << 10


def decided(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows (page_id, url, payload, digest, kind, refers_to), one per row of pages.

    Null payloads are empty. Ties: rows that share the largest id of their payload are all responses; null ids are
    below any other, and all are responses if the payload has no other. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = F.octet_length("payload") >= min_bytes
    newest = rows.where(long).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").select("digest", "newest")
    # cut off, so that the join has a plain exchange on both sides and a hot digest can be split
    newest = cut(newest)
    first = F.col("newest").isNull() | F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(newest.hint("merge"), "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(first, "response").otherwise("revisit").alias("kind"), F.when(~first, F.col("newest")).alias("refers_to")
    )


def _urn(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _line(text: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record: the block is an HTTP response, or only its head for a revisit."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_line(url)}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([] if kind == "response" else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """The record's page_id, url, kind, payload_bytes, payload_digest, refers_to and payload (None for a revisit). Raises ValueError where it doesn't hold together."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    page = lambda x: None if x is None or x == _urn(None) else int(x.removeprefix("<urn:page:")[:-1])
    return {
        "page_id": page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "kind": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": page(fields.get("WARC-Refers-To")),
        "payload": payload if kind == "response" else None,
    }


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; where they are too few for that, their last bytes themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """Writes records to a stream; holds back the first few until the dictionary is built."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.held, self.size, self.frames, self.records = out, level, [], 0, None, 0

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.frames:
            self.out.write(self.frames.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if len(self.held) >= SAMPLES or self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        built = dictionary([x[:SAMPLE_RECORD] for x in self.held])
        content = built.as_bytes()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
        self.frames = zstandard.ZstdCompressor(level=self.level, dict_data=built, write_checksum=True, write_content_size=True)
        for x in self.held:
            self.out.write(self.frames.compress(x))
        self.held = []

    def close(self) -> None:
        if self.held:
            self.start()


def frames(source, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    content = source.read(size)
    kind = zstandard.DICT_TYPE_AUTO
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=kind))
    rest = b""
    while True:
        rest = rest or source.read(chunk)
        if not rest:
            return
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(chunk)
            if not rest:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def write(pages: DataFrame, path: str | None = None, min_bytes: int = 1000, **columns: str) -> DataFrame:
    """Writes the archives under path (a URI all executors reach; a new shared folder if none) and returns rows (path, records, bytes).

    One archive per partition, written under a name of the attempt and renamed when whole, so that a task that runs
    again replaces its archive. Partitions without rows write none.
    """
    spark = pages.sparkSession
    ship(spark)
    path = path or scratch_path(spark, "warc")
    fields = ("page_id", "url", "payload", "digest", "kind", "refers_to")

    def run(batches):
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():05d}.warc.zst"
        trial = f"{name}.{task.taskAttemptId()}"
        writer = None
        for b in slices(batches, "payload"):
            if writer is None and b.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(trial, compression=None)
                writer = ArchiveWriter(out)
            for row in zip(*(b.column(c).to_pylist() for c in fields), strict=True):
                writer.add(record(*row))
        if writer:
            writer.close()
            size = out.tell()
            out.close()
            store.move(trial, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([writer.records]), pa.array([size])], ["path", "records", "bytes"])

    made = decided(pages, min_bytes, **columns).mapInArrow(run, "path string, records long, bytes long")
    scheme = path.partition("://")[0] if "://" in path else "file"
    authority = "" if scheme == "file" else path.partition("://")[2].partition("/")[0]
    return cut(made.select(F.concat(F.lit(f"{scheme}://{authority}"), "path").alias("path"), "records", "bytes"))


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in column path, digests checked: page_id, url, kind, payload_bytes, payload_digest, refers_to and, if wanted, payload."""
    kinds = {"page_id": "long", "url": "string", "kind": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long"} | ({"payload": "binary"} if payloads else {})
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for b in batches:
            for uri in b.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(uri)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as source:
                    for data in frames(source):
                        rows.append(parsed(data))
                        size += len(data) if payloads else 200
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[t]) for k, t in kinds.items()], list(kinds))

    ship(archives.sparkSession)
    return archives.select("path").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))

"""Byte-level BPE by tree concatenation.

The pre-tokenizer splits a text into pieces, and pieces are encoded on their own. A long piece that it doesn't split
(letters, digits, signs or blanks without a break) is halved down to leaves, the leaves of all such pieces
are encoded in parallel, and halves are joined again: a window around each join is re-encoded and
grows until its first and last tokens agree with both sides. Token sequences in which every two
neighbours encode to themselves are the encoding of their text, so an agreed join is exact.
"""

from __future__ import annotations

import hashlib
import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import slices
from siltline.session import ship

#: The split pattern of the vocabulary (fixed value, from its published configuration).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces above this many characters are taken as a tree, with leaves of LEAF at most.
LONG, LEAF = 1024, 256
#: Leaves are encoded by so many threads (outside Python's lock).
THREADS = 4


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies spell bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encodes and decodes as the tokenizer file says; special strings in a text become their ids."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in self.special}
        self.engine = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.spell = np.empty(size, object)
        self.spell[:] = b""
        for w, i in ranks.items():
            self.spell[i] = w
        for w, i in self.special.items():
            self.spell[i] = w.encode()
        self.length = np.array([len(x) for x in self.spell], np.int64)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.run = regex.compile(rf"\S{{{LONG},}}|\s{{{LONG},}}")
        self.pieces = regex.compile(PATTERN)

    def encode(self, text: str) -> np.ndarray:
        """Ids of one text, unsigned 32-bit."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        if len(text) < LONG or not self.run.search(text):
            return np.array(self.engine.encode_ordinary(text), np.uint32)
        parts, at = [], 0
        for m in self.pieces.finditer(text):
            if m.end() - m.start() > LONG:
                # pieces before it stand alone: joined again they split as before, the one that follows being left out only at a border
                parts += [self._pieces(text, at, m.start()), self.tree(m[0])]
                at = m.end()
        return np.concatenate([*parts, self._pieces(text, at, len(text))])

    def _pieces(self, text: str, start: int, end: int) -> np.ndarray:
        """The pieces of text within a span that is bounded by pieces."""
        found = self.engine._core_bpe
        ids: list[int] = []
        for m in self.pieces.finditer(text, start):
            if m.start() >= end:
                break
            ids += found.encode_single_piece(m[0].encode())
        return np.array(ids, np.uint32)

    def tree(self, piece: str) -> np.ndarray:
        """Ids of one unsplit piece."""
        leaves = [piece[i : i + LEAF] for i in range(0, len(piece), LEAF)]
        level = [np.array(x, np.uint32) for x in self._many(leaves)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _many(self, leaves: list[str]) -> list[list[int]]:
        return self.engine.encode_ordinary_batch(leaves, num_threads=THREADS) if len(leaves) > 64 else [self.engine.encode_ordinary(x) for x in leaves]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of the text of both, from their encodings."""
        n = 4
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            window = b"".join(self.spell[left[len(left) - a :]]) + b"".join(self.spell[right[:b]])
            ids = np.array(self.engine._core_bpe.encode_single_piece(window), np.uint32)
            agree_left = a == len(left) or ids[0] == left[len(left) - a]
            agree_right = b == len(right) or ids[-1] == right[b - 1]
            if agree_left and agree_right:
                return np.concatenate([left[: len(left) - a], ids, right[b:]])
            n *= 2

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.spell[ids]).decode("utf-8", "replace")


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, decoded), one per row of docs: token ids as an array of long, and the text they decode to.

    Null texts count as empty: no ids. path: the tokenizer file, at the same place on every executor (it is
    part of the installed tokenizer package). Ids may be null or repeat; only the two named columns are read.
    """

    def run(batches):
        c = codec(path)
        for b in slices(batches, "t"):
            ids = [c.encode(x or "") for x in b.column("t").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array([c.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens, ids_sha256, decoded_sha256): as encoded(), hashed where it is made so that ids don't travel."""

    def run(batches):
        c = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches, "t"):
            n, ids_sha, text_sha = [], [], []
            for x in b.column("t").to_pylist():
                ids = c.encode(x or "")
                n.append(len(ids))
                ids_sha.append(sha(ids.astype("<u4").tobytes()))
                text_sha.append(sha(c.decode(ids).encode()))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stored(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the text replaced by what its ids decode to, plus column token_ids (clashing names are replaced). The round trip is exact for valid text."""
    columns = [c for c in docs.columns if c not in ("token_ids", "n_tokens")]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        c = codec(path)
        for b in slices(batches, text_col):
            texts = b.column(text_col).to_pylist()
            ids = [c.encode(x or "") for x in texts]
            decoded = [None if x is None else c.decode(i) for x, i in zip(texts, ids, strict=True)]
            arrays = [pa.array(decoded, pa.string()) if name == text_col else b.column(name) for name in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())], [*columns, "token_ids", "n_tokens"])

    ship(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, f"{kinds}, token_ids array<int>, n_tokens long")

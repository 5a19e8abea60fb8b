"""Benchmark decontamination with SimHash windows.

Over each document slide windows of the size of each benchmark item. A window's fingerprint is the
256-bit SimHash of its five-word shingles, repeats included. Fingerprints are looked up in a
multi-index: 16 blocks of 16 bits; two fingerprints within RADIUS = 80 bits share a block within
80 // 16 = 5 bits, so the blocks guarantee every item within the radius. Candidates are verified by the
exact similarity of weighted shingles (weight: how often it occurs), sum of minima over sum of maxima.

Without repeats, at similarity 0.8 fingerprints differ in 39 bits on average with a deviation below 6, and in 48 with
one of 6.3 at worst (4 shingles against 5), so RADIUS is five deviations beyond or more. Repeats widen the angle without bound: a window
or items of a size in which a shingle repeats are looked up by their shingles instead (Postings), which is exact.

A window is fingerprinted only if enough of its shingles occur in items of its size to reach the
similarity at all; that bound is exact.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import LANES, Rolling, slices, split_words, wide_simhash, word_hashes
from siltline.session import ship, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 80, 16
#: Items are broadcast in blocks of so many bytes of text at most; each block is one pass over the documents.
BLOCK_BYTES = 16 << 20
EDGE = ".,;:!?()[]{}<>\"'`|"


def plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text and the end, words): lower case, without punctuation at their edges; null texts have none."""
    at, words = split_words(texts)
    coded = words.dictionary_encode()
    names = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=EDGE)
    words = names.take(coded.indices)
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        words = words.filter(pa.array(full))
    return at, words


def similarity(one: Counter, two: Counter) -> float:
    shared = sum(min(n, two[k]) for k, n in one.items() if k in two)
    return shared / (one.total() + two.total() - shared) if one or two else 0.0


class MultiIndex:
    """Fingerprints by blocks; lookup() finds all within RADIUS."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        blocks = np.ascontiguousarray(prints).view(np.uint16)
        self.buckets = []
        for k in range(BLOCKS):
            values, where = np.unique(blocks[:, k], return_inverse=True)
            self.buckets.append((values, [np.flatnonzero(where == i) for i in range(len(values))]))

    def lookup(self, fingerprint: np.ndarray) -> list[tuple[int, int]]:
        """(index, differing bits) of all within RADIUS."""
        found: set[int] = set()
        for value, (values, members) in zip(fingerprint.view(np.uint16), self.buckets, strict=True):
            for i in np.flatnonzero(np.bitwise_count(values ^ value) <= RADIUS // BLOCKS):
                found.update(members[i].tolist())
        out = []
        for i in sorted(found):
            bits = int(np.bitwise_count(self.prints[i] ^ fingerprint).sum())
            if bits <= RADIUS:
                out.append((i, bits))
        return out


class Postings:
    """Items of one size by their shingles; lookup() finds all of a similarity, by exact sums of minima."""

    def __init__(self, counts: list[Counter], prints: np.ndarray):
        self.prints = prints
        rows = sorted((shingle, i, n) for i, c in enumerate(counts) for shingle, n in c.items())
        self.shingles = np.array([r[0] for r in rows], np.uint64)
        self.items, self.times = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
        self.totals = np.array([c.total() for c in counts], np.int64)

    def lookup(self, fingerprint: np.ndarray, shingles: np.ndarray, times: np.ndarray) -> list[tuple[int, int]]:
        """(index, differing bits) of all items at SIMILARITY or more to a window of those different shingles."""
        lo, hi = (np.searchsorted(self.shingles, shingles, side=s) for s in ("left", "right"))
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(self.items[at], np.minimum(self.times[at], np.repeat(times, n)), len(self.totals))
        found = np.flatnonzero(shared >= SIMILARITY * (self.totals + times.sum() - shared) - 1e-9)
        return [(int(i), int(np.bitwise_count(self.prints[i] ^ fingerprint).sum())) for i in found]


class Items:
    """Benchmark items of one block, by their number of words. Items of equal words are one, named by the least id, null only if all are; items without words are left out."""

    def __init__(self, ids: list[int | None], texts: pa.Array):
        at, words = plain_words(texts)
        hashes = word_hashes(words)
        by_words: dict[bytes, tuple[int | None, np.ndarray]] = {}
        for key, (lo, hi) in zip(ids, pairwise(at.tolist()), strict=True):
            if hi > lo:
                same = by_words.get(hashes[lo:hi].tobytes(), (None,))[0]
                by_words[hashes[lo:hi].tobytes()] = (min((k for k in (key, same) if k is not None), default=None), hashes[lo:hi])
        groups = defaultdict(list)
        for key, h in sorted(by_words.values(), key=lambda x: (x[0] is not None, x[0])):
            groups[len(h)].append((key, shingled(h)))
        #: by size: ids, shingle counts, index, the shingles of all, postings, whether a shingle repeats in an item
        self.sizes = {}
        for n, g in groups.items():
            counts, prints = [Counter(s.tolist()) for _, s in g], np.stack([wide_simhash(s) for _, s in g])
            repeats = any(len(c) < c.total() for c in counts)
            self.sizes[n] = ([k for k, _ in g], counts, MultiIndex(prints), np.unique(np.concatenate([s for _, s in g])), Postings(counts, prints), repeats)
        self.widths = sorted({min(SHINGLE, n) for n in self.sizes})
        self.shingles = {w: np.unique(np.concatenate([x[3] for n, x in self.sizes.items() if min(SHINGLE, n) == w])) for w in self.widths}

    def matches(self, hashes: np.ndarray, hits: dict[int, np.ndarray]) -> list[dict]:
        """The best window per item in a document of those word hashes; hits: by width, hashes of all its shingles."""
        found: dict[tuple[int, int], dict] = {}
        for n, (ids, counts, index, own, postings, repeats) in self.sizes.items():
            width = min(SHINGLE, n)
            shingles = hits.get(width)
            if shingles is None or not len(shingles):
                continue
            size = min(n, len(hashes)) - width + 1
            least = math.ceil(SIMILARITY * (size + n - width + 1) / (1 + SIMILARITY) - 1e-9)
            hit = np.zeros(len(shingles) + 1, np.int64)
            np.cumsum(isin(shingles, own), out=hit[1:])
            for start in np.flatnonzero(hit[size:] - hit[:-size] >= least).tolist():
                window = shingles[start : start + size]
                counted = None
                different, times = np.unique(window, return_counts=True)
                found_here = postings.lookup(wide_simhash(window), different, times) if repeats or len(different) < size else index.lookup(wide_simhash(window))
                for i, bits in found_here:
                    counted = counted or Counter(window.tolist())
                    alike = similarity(counted, counts[i])
                    best = found.get((n, i))
                    if alike >= SIMILARITY and (best is None or alike > best["similarity"]):
                        found[n, i] = {"item_id": ids[i], "start": start, "words": size + width - 1, "similarity": alike, "bits": bits}
        return sorted(found.values(), key=lambda m: (m["item_id"] is not None, *m.values()))

    def search(self, texts: pa.Array) -> list[list[dict]]:
        """Matches of each text."""
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        at, words = plain_words(texts)
        hashes = word_hashes(words)
        rolling = Rolling(hashes)
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        some: set[int] = set()
        for w in self.widths:
            if len(hashes) >= w:
                starts = np.arange(len(hashes) - w + 1)
                whole = doc[starts] == doc[starts + w - 1]
                some.update(doc[starts[whole & isin(rolling.of(starts, w), self.shingles[w])]].tolist())
        for i in sorted(some):
            lo, hi = int(at[i]), int(at[i + 1])
            hits = {w: rolling.of(np.arange(lo, hi - w + 1), w) for w in self.widths if hi - lo >= w}
            out[i] = self.matches(hashes[lo:hi], hits)
        return out


def isin(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values if len(known) else np.zeros(len(values), bool)


def shingled(hashes: np.ndarray) -> np.ndarray:
    width = min(SHINGLE, len(hashes))
    return Rolling(hashes).of(np.arange(len(hashes) - width + 1), width)


def named_by_words(rows: DataFrame) -> DataFrame:
    """rows (id, t) with a hash k of the words that items are compared by."""

    def run(batches):
        for b in batches:
            at, words = plain_words(b.column("t"))
            hashes = word_hashes(words)
            keys = [xxhash.xxh3_64_intdigest(hashes[lo:hi].tobytes()) >> 1 for lo, hi in pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), pa.array(keys, pa.int64())], ["id", "t", "k"])

    return rows.mapInArrow(run, "id long, t string, k long")


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """Rows (id, t) of items in blocks of bounded size: a benchmark of any size is a stated query set against all rows, in blocks."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    if total <= block_bytes:
        return [rows]
    ship(benchmark.sparkSession)
    blocks = math.ceil(2 * total / block_bytes)
    # items of equal words meet in one block
    named = written(named_by_words(rows), "items")
    return [named.where(F.pmod("k", F.lit(blocks)) == k).select("id", "t") for k in range(blocks)]


def read_items(block: DataFrame) -> Items:
    found = block.toArrow()
    return Items(found.column("id").to_pylist(), found.column("t").combine_chunks())


MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("words", pa.int64()), ("similarity", pa.float64()), ("bits", pa.int64())]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (id, matches): the documents with a window at SIMILARITY or more to an item, with the best window per item, in order of item_id.

    Items are found whatever their id; one without an id has item_id null, first in order.

    Null and blank texts match nothing; a document shorter than an item is one window; items and
    documents of fewer than five words are one shingle. Repeated rows are found each. Only the named columns are read.
    block_bytes bounds the items of one pass and decides nothing about the rows.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()
    blocks = item_blocks(benchmark, block_bytes=block_bytes)
    # matches of several blocks meet by a key of their row; one block needs none
    docs = docs.select(F.lit(0).cast("long").alias("row"), "*") if len(blocks) == 1 else written(docs.select(F.monotonically_increasing_id().alias("row"), "*"), "rows")
    found = None
    for block in blocks:
        shared = spark.sparkContext.broadcast(read_items(block))

        def run(batches, shared=shared):
            for b in slices(batches, "t"):
                matches = shared.value.search(b.column("t"))
                some = [i for i, m in enumerate(matches) if m]
                at = pa.array(some, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("row").take(at), b.column("id").take(at), pa.array([matches[i] for i in some], MATCHES)], ["row", "id", "matches"])

        one = docs.mapInArrow(run, f"row long, id {kind}, matches array<struct<item_id:long,start:long,words:long,similarity:double,bits:long>>")
        found = one if found is None else found.unionByName(one)
    if len(blocks) > 1:
        found = found.groupBy("row").agg(F.first("id").alias("id"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return found.select("id", "matches")


def without_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the rows that match an item; all columns stay. Rows are judged where they are: nothing is joined."""
    spark = docs.sparkSession
    ship(spark)
    for block in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(read_items(block))

        def run(batches, shared=shared):
            for b in slices(batches, text_col):
                yield b.filter(pa.array([not m for m in shared.value.search(b.column(text_col))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

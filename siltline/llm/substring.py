"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, in blocks (documents) with global coordinates. It is indexed by
anchors: of the 18 runs of 18 words in each window of 35, the one with the least hash. Equal windows
have equal anchors, so anchors that occur twice name every place where a repeat can be.

Each document is parsed greedily against the block in which an anchor occurs first (against the last
for that first occurrence itself). Consecutive anchors at one distance from the same block prolong a factor:
their runs touch or overlap, so the factor is equal text, word by word. A factor of 35 words or more
is a duplicate span here and in its block. What remains are the windows at factor boundaries, those
with a repeated anchor that stick out of their factor: they are held against each other, and against
all windows around first occurrences, by a 96-bit hash.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import ODD, Rolling, slices, split_words, word_hashes
from siltline.session import cut, ship, written

def owners(run_hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` runs, the place of its least hash (the first of equals)."""
    least = np.lib.stride_tricks.sliding_window_view(run_hashes, width)
    out = np.empty(len(least), np.int64)
    for lo in range(0, len(least), 1 << 16):
        out[lo : lo + (1 << 16)] = least[lo : lo + (1 << 16)].argmin(1)
    return out + np.arange(len(least))


def _based(batches, column: str):
    """Slices with the coordinate of each text's first word: the scan's partition, then bytes before it."""
    at = TaskContext.get().partitionId() << 36
    for b in slices(batches, column):
        size = pc.add(pc.fill_null(pc.binary_length(b.column(column)), 0), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = at + np.cumsum(size)
        yield ends - size, b
        at = int(ends[-1]) if len(ends) else at


class SubstringDedup:
    """Removes every word covered by a window of `window` words that also starts elsewhere in the corpus.

    docs must be a scan or a checkpoint (the same rows in the same order when it is read twice).
    Null and blank texts have no words and lose none; repeated rows are repeats of each other; texts of
    fewer than `window` words lose none; only the two named columns are read; no rows give no rows.
    Results: id, n_words, n_removed, spans (array of start, end in words), kept (the remaining text).
    """

    def __init__(self, window: int = 35):
        self.window, self.run = window, (window + 1) // 2
        self.width = window - self.run + 1

    def _parts(self, texts: pa.Array):
        """(index, word hashes, rolling hash of runs, owners) of each text with a window."""
        at, words = split_words(texts)
        hashes = word_hashes(words)
        for i, (lo, hi) in enumerate(pairwise(at.tolist())):
            if hi - lo >= self.window:
                rolling = Rolling(hashes[lo:hi], ODD[0])
                yield i, rolling, owners(rolling.of(np.arange(hi - lo - self.run + 1), self.run), self.width)

    def anchors(self, docs: DataFrame) -> DataFrame:
        """Rows (h, base, pos): the hash, document and word of each anchor."""

        def run(batches):
            for bases, b in _based(batches, "t"):
                h, base, pos = [], [], []
                for i, rolling, owner in self._parts(b.column("t")):
                    p = np.unique(owner)
                    h.append(rolling.of(p, self.run).view(np.int64))
                    base.append(np.full(len(p), bases[i]))
                    pos.append(p)
                if h:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(h)), pa.array(np.concatenate(base)), pa.array(np.concatenate(pos).astype(np.int32))], ["h", "base", "pos"])

        return docs.mapInArrow(run, "h long, base long, pos int")

    def factors(self, docs: DataFrame, refs: DataFrame) -> DataFrame:
        """The parse: kind 0 a document with the spans of its factors, 1 a boundary window, 3 a window of a first occurrence, 2 a span of a reference block."""

        def packed(batches):
            z = zstandard.ZstdCompressor(level=3)
            for bases, b in _based(batches, "t"):
                texts = pc.fill_null(b.column("t"), "").cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(bases), pa.array([z.compress(x) for x in texts.to_pylist()], pa.binary())], ["id", "base", "z"])

        def parse(batches):
            unz = zstandard.ZstdDecompressor()
            for b in slices(batches, "z", 2 << 20):
                z = b.column("z").to_pylist()
                texts = pa.array([unz.decompress(x) for x in z], pa.binary()).cast(pa.string())
                refs = b.column("refs").to_pylist()
                bases = b.column("base").to_numpy()
                out = _Rows(self.window)
                parts = {}
                marked = pc.is_valid(b.column("refs")).to_numpy(zero_copy_only=False)
                pending = np.flatnonzero(marked)
                for i, rolling, owner in self._parts(texts.take(pa.array(pending))):
                    parts[int(pending[i])] = (rolling, owner)
                second = {}
                if len(pending):
                    at, words = split_words(texts.take(pa.array(pending)))
                    other = word_hashes(words, 1)
                    second = {int(pending[i]): other[lo:hi] for i, (lo, hi) in enumerate(pairwise(at.tolist()))}
                for i, (key, base) in enumerate(zip(b.column("id").to_pylist(), bases.tolist(), strict=True)):
                    spans = self._parse_one(base, refs[i], *parts[i], second[i], out) if marked[i] else []
                    if marked[i]:
                        out.doc(key, base, z[i], spans)
                    else:
                        out.plain(key, base, z[i])
                yield out.batch()

        text = docs.mapInArrow(packed, "id long, base long, z binary")
        marks = refs.groupBy("base").agg(F.collect_list(F.struct("pos", "rplace", "rbase", "first")).alias("refs"))
        return text.join(marks.hint("merge"), "base", "left").mapInArrow(parse, _Rows.SCHEMA)

    def _parse_one(self, base: int, refs: list[dict], rolling: Rolling, owner: np.ndarray, second: np.ndarray, out: _Rows) -> list[tuple[int, int]]:
        refs.sort(key=lambda r: r["pos"])
        pos, place, rbase = (np.array([r[k] for r in refs], np.int64) for k in ("pos", "rplace", "rbase"))
        first = np.array([r["first"] for r in refs], bool)
        shift = place - pos
        breaks = np.flatnonzero((np.diff(pos) > self.run) | (np.diff(shift) != 0) | (np.diff(rbase) != 0)) + 1
        starts, ends = pos[np.r_[0, breaks]], pos[np.r_[breaks - 1, len(pos) - 1]] + self.run
        blocks, moved = rbase[np.r_[0, breaks]], shift[np.r_[0, breaks]]
        # windows of repeated anchors: those inside their factor are settled, the others and those of first occurrences are compared
        windows = np.flatnonzero(np.isin(owner, pos))
        mine = np.searchsorted(pos, owner[windows])
        factor = np.searchsorted(breaks, mine, side="right")
        inside = (windows >= starts[factor]) & (windows + self.window <= ends[factor])
        offered = first[mine]
        keep = ~inside | offered
        shown = windows[keep]
        out.windows(base, shown, rolling.of(shown, self.window), Rolling(second, ODD[1]).of(shown, self.window), offered[keep])
        long = ends - starts >= self.window
        for s, e, r, m in zip(starts[long].tolist(), ends[long].tolist(), blocks[long].tolist(), moved[long].tolist(), strict=True):
            out.span(r, s + m - r, e + m - r)
        return list(zip(starts[long].tolist(), ends[long].tolist(), strict=True))

    def run_on(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        ship(docs.sparkSession)
        docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
        places = self.anchors(docs)
        place = F.col("base") + F.col("pos")
        index = (
            places.groupBy("h")
            .agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("base").alias("lo_base"), F.max("base").alias("hi_base"))
            .where("n > 1")
        )
        # cut off here, so that the join below has plain exchanges on both sides and a hot anchor can be split
        index = cut(index)
        first = place == F.col("lo")
        refs = places.join(index.hint("merge"), "h").select(
            "base", "pos", F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("rplace"), F.when(first, F.col("hi_base")).otherwise(F.col("lo_base")).alias("rbase"), first.alias("first")
        )
        parsed = written(self.factors(docs, refs), "factors")
        # asks: windows that stick out of a factor; offers: those around first occurrences, one per hash. A window is repeated
        # if two ask for it, or one asks and one offers; what is offered in vain, the most, moves once.
        asks, offers = (parsed.where(F.col("kind") == k).select("h1", "h2", "base", "start") for k in (1, 3))
        asked = cut(asks.groupBy("h1", "h2").count())
        met = cut(offers.join(asked.select("h1", "h2").hint("merge"), ["h1", "h2"]))
        found = asked.where("count > 1").select("h1", "h2").unionByName(met.select("h1", "h2")).distinct()
        flagged = asks.join(cut(found).hint("merge"), ["h1", "h2"]).unionByName(met).select("base", "start", (F.col("start") + self.window).cast("int").alias("end"))
        spans = flagged.unionByName(parsed.where("kind = 2").select("base", "start", "end"))
        more = spans.groupBy("base", "start").agg(F.max("end").alias("end")).groupBy("base").agg(F.collect_list(F.struct("start", "end")).alias("more"))
        held = parsed.where("kind = 0 AND spans IS NOT NULL").select("id", "base", "z", "spans").join(more.hint("merge"), "base", "left")
        plain = parsed.where("kind = 0 AND spans IS NULL").select("id", "base", "z", "spans", F.lit(None).cast("array<struct<start:int,end:int>>").alias("more"))
        return plain.select("id", "z", "spans", "more").unionByName(held.select("id", "z", "spans", "more")).mapInArrow(_cut_out, "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


class _Rows:
    """Rows of several kinds in one batch."""

    SCHEMA = "kind int, id long, base long, z binary, spans array<struct<start:int,end:int>>, h1 long, h2 int, start int, end int"
    SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def __init__(self, window: int):
        self.window, self.docs, self.more, self.shown = window, [], [], []

    def doc(self, key, base, z, spans):
        self.docs.append((key, base, z, [{"start": s, "end": e} for s, e in spans]))

    def plain(self, key, base, z):
        self.docs.append((key, base, z, None))

    def span(self, base, start, end):
        self.more.append((base, start, end))

    def windows(self, base, starts, h1, h2, offered):
        self.shown.append((np.full(len(starts), base), starts, h1, h2, offered))

    def batch(self) -> pa.RecordBatch:
        n, m = len(self.docs), len(self.more)
        shown = [np.concatenate(x) for x in zip(*self.shown, strict=True)] if self.shown else [np.zeros(0, np.int64)] * 5
        w = len(shown[0])
        more = np.array(self.more, np.int64).reshape(-1, 3)
        none = lambda k, t: pa.nulls(k, t)
        join = lambda *x: pa.concat_arrays(x)
        columns = [
            pa.array(np.concatenate([np.zeros(n), np.where(shown[4], 3, 1), np.full(m, 2)]).astype(np.int32)),
            join(pa.array([d[0] for d in self.docs], pa.int64()), none(w + m, pa.int64())),
            join(pa.array([d[1] for d in self.docs], pa.int64()), pa.array(shown[0].astype(np.int64)), pa.array(more[:, 0].copy())),
            join(pa.array([d[2] for d in self.docs], pa.binary()), none(w + m, pa.binary())),
            join(pa.array([d[3] for d in self.docs], self.SPANS), none(w + m, self.SPANS)),
            join(none(n, pa.int64()), pa.array(shown[2].astype(np.uint64).view(np.int64)), none(m, pa.int64())),
            join(none(n, pa.int32()), pa.array((shown[3].astype(np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)), none(m, pa.int32())),
            join(none(n, pa.int32()), pa.array(shown[1].astype(np.int32)), pa.array(more[:, 1].astype(np.int32))),
            join(none(n + w, pa.int32()), pa.array(more[:, 2].astype(np.int32))),
        ]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in self.SCHEMA.split(", ")])


def _cut_out(batches):
    unz = zstandard.ZstdDecompressor()
    for b in slices(batches, "z", 2 << 20):
        n_words, n_removed, spans, kept = [], [], [], []
        for z, one, two in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), b.column("more").to_pylist(), strict=True):
            words = unz.decompress(z).split()
            joined: list[list[int]] = []
            for s, e in sorted((x["start"], x["end"]) for x in [*(one or []), *(two or [])]):
                if joined and s <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], e)
                else:
                    joined.append([s, e])
            at, left = 0, []
            for s, e in joined:
                left += words[at:s]
                at = e
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            spans.append([{"start": s, "end": e} for s, e in joined])
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, _Rows.SPANS), pa.array(kept, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "spans", "kept"],
        )

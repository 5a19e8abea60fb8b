"""Language-model scores from a weighted backoff automaton.

Smoothed n-grams (to order 3) become states; a state's arcs are the n-grams that continue it, and a
failure arc leads to its longest proper suffix at the cost of a backoff weight. One traversal from left to right
carries the state and adds up log-probabilities.

Every n-gram of the training texts is in the model. Smoothing is by hierarchical Dirichlet priors,

    p(w | h) = (n(hw) + k p(w | h')) / (n(h) + k),

with h' the longest proper suffix of h, the add-one unigram at the end, and k by order (KAPPA). That is a
distribution for each h, it needs the counts alone, and it is a backoff automaton: an arc where n(hw) > 0, else
the failure arc of weight k / (n(h) + k).

The counts are spread over partitions by the hash of the n-gram itself, so no context is a hot key. Each slice of
texts asks for the n-grams it holds, every different one once, with how often its training texts hold it; a
partition adds up what all slices bring and answers in the order of the asking. Answers meet the slice's texts
again, and the automaton restricted to the slice's own n-grams is built and run. Nothing is broadcast and no
n-gram is cut off. Words are told apart by 64-bit hashes, bigrams and trigrams by 56-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.text import mixed, slices, split_words, word_hashes
from siltline.session import ship, written

#: Text of one slice, and text whose n-grams are counted in one partition, about.
SLICE, PART_BYTES = 8 << 20, 16 << 20
#: Stands for the end of a text, and for what comes before its first word; no word holds a space.
END = " "
#: Weight of the shorter context's distribution, in tokens, for bigrams and trigrams.
KAPPA = (1000.0, 8.0)
#: Bits of the hashes of words, bigrams and trigrams.
BITS = (64, 56, 56)
#: Tokens that are hashed at once.
CHUNK = 1 << 16
#: Texts that are traversed in step; the last few go one by one.
FEW = 16


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id, as text, leaves that remainder; null ids are never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(mixed(a) * np.uint64(0x9E3779B97F4A7C15) + b)


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted different values, rank of each value), with small work arrays."""
    order = np.argsort(values).astype(np.int32)
    values = values[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    rank = np.empty(len(values), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return values[new], rank


class Grams:
    """The n-grams of a slice of texts; every text ends with END, and END leads it as a context.

    keys[k]: sorted different hashes of order k + 1; which[k]: by token, the n-gram that ends with it (-1: trigrams of
    first tokens); ends: by text.
    """

    def __init__(self, texts: pa.Array):
        at, words = split_words(texts, lower=True)
        coded = words.dictionary_encode()
        del words
        end = len(coded.dictionary)
        code = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), at[1:], end)
        self.ends = at[1:] + np.arange(1, len(at))
        x = word_hashes(pa.concat_arrays([coded.dictionary, pa.array([END], coded.dictionary.type)]))
        del coded
        one, place = _ranked(x if len(code) else x[:0])
        first = np.zeros(len(code), bool)
        first[np.concatenate([[0], self.ends[:-1]])[: len(self.ends)]] = True
        h = x[code]
        two, three = np.empty(len(code), np.uint64), np.empty(len(code), np.uint64)
        for lo in range(0, len(code), CHUNK):
            some = np.s_[lo : lo + CHUNK]
            two[some] = _pair(np.where(first[some], x[end], np.concatenate([h[lo - 1 : lo] if lo else x[end:], h[some][:-1]])), h[some])
            three[some] = _pair(np.concatenate([two[lo - 1 : lo] if lo else x[end:], two[some][:-1]]), h[some])
        del h
        two >>= np.uint64(64 - BITS[1])
        three >>= np.uint64(64 - BITS[2])
        two, inner = _ranked(two)
        three, third = _ranked(three[~first])
        trigram = np.full(len(code), -1, np.int32)
        trigram[~first] = third
        self.keys, self.which = (one, two, three), (place[code], inner, trigram)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def counts(self, learnt: np.ndarray) -> list[np.ndarray]:
        """How often the texts that are learnt from hold each n-gram."""
        real = learnt[self.doc]
        return [np.bincount(w[real & (w >= 0)], minlength=len(k)) for w, k in zip(self.which, self.keys, strict=True)]


def _edges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the keys of each of `parts` equal ranges begin, and the end."""
    bounds = np.array([(k << bits) // parts for k in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def _planes(values: np.ndarray, width: int) -> bytes:
    return values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unplaned(raw: memoryview, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def _packed(parts: list[bytes]) -> bytes:
    raw = np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> list[memoryview]:
    raw = memoryview(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    at = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], np.int64))])
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _slices(batches, size: int):
    """(key, slice): keys are unique over all partitions of the scan, and the same each time it is read."""
    n = 0
    for b in slices(batches, "t", size):
        if b.num_rows:
            yield (b.column("part")[0].as_py() << 32) + n, b.drop_columns(["part"])
            n += 1


ASKS = "bucket int, slice long, kind int, blob binary"


def _row(bucket: int, key: int, kind: int, blob: bytes) -> list:
    return [pa.array([bucket], pa.int32()), pa.array([key], pa.int64()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())]


def _each(batch: pa.RecordBatch, *names: str):
    """Rows, one at a time, as blobs are large."""
    for i in range(batch.num_rows):
        yield tuple(batch.column(c)[i].as_py() for c in names)


def _asks(batches, size: int, parts: int):
    """Rows of ASKS: the n-grams of each slice, by bucket: hashes (as differences) and counts of each order."""
    names = [c.split()[0] for c in ASKS.split(", ")]
    for key, b in _slices(batches, size):
        grams = Grams(b.column("t"))
        counts = grams.counts(pc.fill_null(b.column("learnt"), False).to_numpy(zero_copy_only=False).astype(bool))
        edges = [_edges(k, bits, parts) for k, bits in zip(grams.keys, BITS, strict=True)]
        for p in range(parts):
            blobs = []
            for k, n, e in zip(grams.keys, counts, edges, strict=True):
                blobs += [_planes(np.diff(k[e[p] : e[p + 1]], prepend=np.uint64(0)), 8), _planes(n[e[p] : e[p + 1]], 4)]
            if any(blobs):
                yield pa.RecordBatch.from_arrays(_row(p, key, 0, _packed(blobs)), names)


def _answers(batches):
    """Rows of ASKS, one per ask: the counts over all slices in the order of the asking (kind 0); and one (kind 2) with the
    number of training tokens and of different training words."""
    names = [c.split()[0] for c in ASKS.split(", ")]
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for row in _each(b, "bucket", "slice", "blob"):
            asked.setdefault(row[0], []).append(row[1:])
    for bucket, some in asked.items():
        answers: list[list[bytes]] = [[] for _ in some]
        tokens = distinct = 0
        opened = [_unpacked(blob) for _, blob in some]
        for order in range(len(BITS)):
            keys = [np.cumsum(_unplaned(o[2 * order], 8), dtype=np.uint64) for o in opened]
            at = np.cumsum([0, *map(len, keys)])
            different, which = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            # sums of whole numbers below 2**53 are exact
            total = np.bincount(which, np.concatenate([_unplaned(o[2 * order + 1], 4) for o in opened]), len(different)).astype(np.int64)
            if order == 0:
                tokens, distinct = int(total.sum()), int((total > 0).sum())
            for i in range(len(some)):
                answers[i].append(_planes(total[which[at[i] : at[i + 1]]], 4 if order else 8))
        for (key, _), parts in zip(some, answers, strict=True):
            yield pa.RecordBatch.from_arrays(_row(bucket, key, 0, _packed(parts)), names)
        yield pa.RecordBatch.from_arrays(_row(bucket, -1, 2, np.array([tokens, distinct], np.int64).tobytes()), names)


def _texts(batches, size: int):
    """Rows of ASKS, one per slice (kind 1): its rows as an Arrow stream."""
    names = [c.split()[0] for c in ASKS.split(", ")]
    for key, b in _slices(batches, size):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays(_row(0, key, 1, sink.getvalue().to_pybytes()), names)


@dataclass
class Automaton:
    """States: 0 the root, then one per word, then one per bigram that is a context. depth: words of the state's context.

    arcs[d][t] is the arc that token t follows out of the state of depth d + 1 that its predecessors lead to, -1 if that
    state has none for it: the lookup of an arc is done when the automaton is built.
    """

    depth: np.ndarray
    fail: np.ndarray
    fail_cost: np.ndarray
    cost: np.ndarray
    target: np.ndarray
    arcs: tuple[np.ndarray, np.ndarray]
    root_cost: np.ndarray
    root_target: np.ndarray
    start: int

    def traverse(self, ends: np.ndarray) -> np.ndarray:
        """Scores of texts (log10). They advance in step, the longest first; the last few go on one by one."""
        starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        starts, length = starts[order], length[order]
        state = np.full(len(order), self.start)
        total = np.zeros(len(order))
        t = 0
        while len(length) and t < length[0]:
            active = int(np.searchsorted(-length, -t, side="left"))
            if active <= FEW:
                break
            at, s, sums = starts[:active] + t, state[:active], np.zeros(active)
            reached, left = np.zeros(active, bool), np.arange(active)
            for d in (2, 1):
                here = left[self.depth[s[left]] == d]
                arc = self.arcs[d - 1][at[here]]
                hit = arc >= 0
                sums[here[hit]] += self.cost[arc[hit]]
                s[here[hit]] = self.target[arc[hit]]
                miss = here[~hit]
                sums[miss] += self.fail_cost[s[miss]]
                s[miss] = self.fail[s[miss]]
                reached[here[hit]] = True
                left = np.flatnonzero(~reached)
            sums[left] += self.root_cost[at[left]]
            s[left] = self.root_target[at[left]]
            total[:active] += sums
            t += 1
        for i in range(int(np.searchsorted(-length, -t, side="left"))):
            total[i] += self._one(int(state[i]), int(starts[i] + t), int(starts[i] + length[i]))
        out = np.empty(len(order))
        out[order] = total
        return out

    def _one(self, state: int, lo: int, hi: int) -> float:
        """The rest of one text, from a state."""
        total, depth, fail = 0.0, self.depth, self.fail
        first, second = (a[lo:hi].tolist() for a in self.arcs)
        root_cost, root_target = self.root_cost[lo:hi].tolist(), self.root_target[lo:hi].tolist()
        for i in range(hi - lo):
            while state:
                arc = second[i] if depth[state] == 2 else first[i]
                if arc >= 0:
                    total += self.cost[arc]
                    state = self.target[arc]
                    break
                total += self.fail_cost[state]
                state = fail[state]
            else:
                total += root_cost[i]
                state = root_target[i]
        return float(total)


def build(grams: Grams, counts: list[np.ndarray], tokens: int, distinct: int, kappa: tuple[float, float] = KAPPA) -> Automaton:
    """The automaton restricted to the n-grams of a slice; counts: over the whole training texts, in the order of grams.keys."""
    n1, n2, n3 = counts
    words = len(n1)
    one = (n1 + 1.0) / (tokens + distinct + 1)
    place, bigram, trigram = grams.which
    end = int(place[grams.ends[0] - 1]) if len(grams.ends) else 0
    # per bigram: its words
    at = _firsts(bigram, len(n2))
    u, v = np.where(at > 0, place[at - 1], end).astype(np.int32), place[at]
    p2 = (n2 + kappa[0] * one[v]) / (n1[u] + kappa[0])
    has2, has3 = n2 > 0, n3 > 0
    context = has2 & (v != end)
    state2 = np.where(context, words + np.cumsum(context, dtype=np.int32), 1 + v).astype(np.int32)
    arc2 = np.where(has2, np.cumsum(has2, dtype=np.int32) - 1, -1).astype(np.int32)
    # per trigram: its two bigrams
    at = _firsts(trigram, len(n3))
    head, tail = bigram[at - 1], bigram[at]
    p3 = ((n3 + kappa[1] * p2[tail]) / (n2[head] + kappa[1]))[has3]
    target = np.concatenate([state2[has2], state2[tail[has3]]])
    del at, u, head, tail, state2
    arc3 = np.append(np.where(has3, has2.sum() + np.cumsum(has3, dtype=np.int32) - 1, -1), -1).astype(np.int32)  # the last is that of no trigram
    depth = np.concatenate([[0], np.ones(words, np.int8), np.full(context.sum(), 2, np.int8)]).astype(np.int8)
    fail = np.concatenate([np.zeros(1 + words, np.int32), 1 + v[context]])
    fail_cost = np.concatenate([[0.0], np.log10(kappa[0] / (n1 + kappa[0])), np.log10(kappa[1] / (n2[context] + kappa[1]))])
    cost = np.log10(np.concatenate([p2[has2], p3]))
    return Automaton(depth, fail, fail_cost, cost, target, (arc2[bigram], arc3[trigram]), np.log10(one)[place], 1 + place, 1 + end)


def _firsts(which: np.ndarray, size: int) -> np.ndarray:
    """A token of each n-gram."""
    out = np.zeros(size, np.int32)
    some = np.flatnonzero(which >= 0).astype(np.int32)
    out[which[some]] = some
    return out


def _scores(batches, size: int, tokens: int, distinct: int, kappa: tuple[float, float], names: list[str]):
    """Rows of scores; the answers of a slice come before its texts, in the order of their buckets."""
    held: list[bytes] = []
    now = None
    for b in batches:
        for key, kind, blob in _each(b, "slice", "kind", "blob"):
            if key != now:
                held, now = [], key
            if kind == 0:
                held.append(blob)
                continue
            with pa.ipc.open_stream(blob) as source:
                rows = pa.Table.from_batches(list(source)).combine_chunks().to_batches()[0]
            grams = Grams(rows.column("t"))
            opened = [_unpacked(x) for x in held]
            counts = [np.concatenate([np.zeros(0, np.uint32 if k else np.uint64), *(_unplaned(o[k], 4 if k else 8) for o in opened)]) for k in range(len(BITS))]
            if [len(c) for c in counts] != [len(k) for k in grams.keys]:
                raise RuntimeError("the texts came in another order: give a scan or a checkpoint")
            del opened
            model = build(grams, counts, tokens, distinct, kappa)
            starts = np.concatenate([[0], grams.ends[:-1]])
            known = np.add.reduceat((counts[0] > 0)[grams.which[0]].astype(np.int64), starts)
            del counts
            base = np.add.reduceat(model.root_cost, starts)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("learnt"), pa.array(np.diff(grams.ends, prepend=0)), pa.array(known), pa.array(np.full(len(known), tokens)), pa.array(base), pa.array(model.traverse(grams.ends))],
                names,
            )


class BackoffScorer:
    """Learns from the rows where `learn` holds and scores every row.

    kappa: see KAPPA. slice_bytes: text that is scored with one automaton; part_bytes: text whose n-grams are counted in one
    partition; both bound memory and decide nothing about the rows (at 100 TB raise both, as there is a block per
    slice and part). Null and blank texts hold one token, the end. Null ids are learnt from unless `learn` says otherwise;
    where it is null, nothing is learnt. Repeated rows count as often as they occur. Without rows
    to learn from every token costs log10(1). Only the named columns are read; they are read more than once and must
    come in the same order each time, as from a scan or a checkpoint (what comes otherwise is an error).
    """

    def __init__(self, kappa: tuple[float, float] = KAPPA, slice_bytes: int = SLICE, part_bytes: int = PART_BYTES):
        self.kappa, self.slice_bytes, self.part_bytes = kappa, slice_bytes, part_bytes

    def score(self, docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (id, learnt, n_tokens, n_known, train_tokens, base_score, score), one per row of docs.

        base_score: the add-one unigram log10 probability; score: the backoff automaton's.
        """
        spark = docs.sparkSession
        ship(spark)
        docs = docs.select(F.col(id_col).alias("id"), F.coalesce(learn, F.lit(False)).alias("learnt"), F.col(text_col).alias("t"), F.spark_partition_id().alias("part"))
        total = docs.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
        cores = spark.sparkContext.defaultParallelism
        size, parts, kappa = self.slice_bytes, max(cores, math.ceil(total / self.part_bytes)), self.kappa
        asks = docs.select("learnt", "t", "part").mapInArrow(lambda x: _asks(x, size, parts), ASKS)
        answers = written(asks.repartitionById(parts, F.col("bucket")).mapInArrow(_answers, ASKS), "answers")
        stats = answers.where("kind = 2").select("blob").toArrow().column("blob").to_pylist()  # one row per part
        tokens, distinct = (int(x) for x in np.sum([np.frombuffer(x, np.int64) for x in stats] or [[0, 0]], axis=0))
        texts = docs.mapInArrow(lambda x: _texts(x, size), ASKS)
        met = answers.where("kind = 0").unionByName(texts).repartition(max(cores, math.ceil(total / size)), "slice").sortWithinPartitions("slice", "kind", "bucket")
        kind = docs.schema["id"].dataType.simpleString()
        schema = f"id {kind}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        names = ["id", "learnt", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return met.mapInArrow(lambda x: _scores(x, size, tokens, distinct, kappa, names), schema)

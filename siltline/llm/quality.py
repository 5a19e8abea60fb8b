"""Quality: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features is shared by all grades; ordered thresholds cut the
linear predictor: P(grade <= k) = sigmoid(threshold_k - w x). The expected grade and the tail
probability P(grade >= k) follow, and selection takes the latter.
Features: hashed words and hashed word shapes, averaged over the text, and the text's length class and share classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.labelled import sample
from siltline.llm.text import mixed, slices, split_words
from siltline.session import ship

BUCKETS = 1 << 16
#: Slots behind the hashed buckets: text length (log2 of words) and ten classes each of five shares.
LENGTHS, SHARES = 24, 5
SIZE = BUCKETS + LENGTHS + 11 * SHARES
#: Texts are turned into features so many at a time in training.
CHUNK = 500


def word_buckets(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its shape) for different words."""
    import xxhash

    lowered = pc.utf8_lower(words).cast(pa.binary()).to_pylist()
    shapes = pc.replace_substring_regex(pc.replace_substring_regex(pc.replace_substring_regex(words, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), r"\p{N}+", "0").cast(pa.binary()).to_pylist()
    hashed = lambda many, seed: np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in many), np.uint64, len(many))
    slot = lambda h: (mixed(h) % np.uint64(BUCKETS)).astype(np.int64)
    return slot(hashed(lowered, 1)), slot(hashed(shapes, 2))


def shares(texts: pa.Array, at: np.ndarray, ids: np.ndarray, words: pa.Array) -> np.ndarray:
    """Per text, from 0 to 1: letters among characters, distinct among words, shortest words, longest words, distinct among lines."""
    n = np.maximum(np.diff(at), 1)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = pc.utf8_length(pc.replace_substring_regex(words, r"[^\p{L}]", "")).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    total = lambda x: np.bincount(doc, x, len(at) - 1)
    different = np.bincount(np.unique(doc * max(1, len(words)) + ids) // max(1, len(words)), minlength=len(at) - 1) if len(ids) else np.zeros(len(at) - 1)
    lines = [x.split("\n") for x in pc.fill_null(texts, "").to_pylist()]
    distinct = np.array([len(set(x)) / len(x) for x in lines])
    chars = np.maximum(total(size[ids]), 1)
    return np.stack([total(letters[ids]) / chars, different / n, total(size[ids] <= 2) / n, total(size[ids] > 14) / n, distinct], 1)


def features(texts: pa.Array):
    """(row, slot, value) of the features of each text."""
    texts = pc.fill_null(texts, "")
    at, words = split_words(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    word, shape = word_buckets(coded.dictionary)
    rows = np.arange(len(texts))
    doc, n = np.repeat(rows, np.diff(at)), np.diff(at)
    value = 1.0 / np.sqrt(np.maximum(n, 1))[doc] / np.sqrt(np.maximum(n, 1))[doc]
    length = BUCKETS + np.minimum(np.log2(n + 1).astype(np.int64), LENGTHS - 1)
    classes = (shares(texts, at, ids, coded.dictionary) * 10).astype(np.int64).clip(0, 10) + BUCKETS + LENGTHS + 11 * np.arange(SHARES)
    row = np.concatenate([doc, doc, rows, np.repeat(rows, SHARES)])
    slot = np.concatenate([word[ids], shape[ids], length, classes.ravel()])
    value = np.concatenate([value * 4, value * 4, np.full(len(rows), 0.5), np.full(len(rows) * SHARES, 0.5)])
    # one entry per text and slot
    keys, place = np.unique(row * SIZE + slot, return_inverse=True)
    return (keys // SIZE).astype(np.int32), (keys % SIZE).astype(np.int32), np.bincount(place, value, len(keys)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class OrdinalModel:
    """grades in order; thresholds between them (one less)."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def predictor(self, texts: pa.Array) -> np.ndarray:
        row, slot, value = features(texts)
        return np.bincount(row, self.weights[slot] * value, len(texts))

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= grades[k + 1]) per text and threshold."""
        return sigmoid(self.predictor(texts)[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if len(self.grades) else np.zeros(len(tails))


def train(texts: pa.Array, grades: np.ndarray, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-6, batch: int = 256, seed: int = 3) -> OrdinalModel:
    """Maximum likelihood by Adam. The thresholds are a first one and positive steps, so that they keep their order."""
    levels = np.unique(grades)
    if len(levels) < 2:
        return OrdinalModel(levels.astype(float), np.zeros(SIZE), np.zeros(0))
    rank, k = np.searchsorted(levels, grades), len(levels) - 1
    balance = (len(rank) / (len(levels) * np.bincount(rank)))[rank]
    parts = [features(texts.slice(i, CHUNK)) for i in range(0, len(texts), CHUNK)]
    row = np.concatenate([p[0] + k * CHUNK for k, p in enumerate(parts)])
    slot, value = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    params = [np.zeros(SIZE), np.concatenate([[0.0], np.zeros(k - 1)])]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            size = ends[some + 1] - ends[some]
            inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[some], size)
            owner = np.repeat(np.arange(len(some)), size)
            eta = np.bincount(owner, params[0][slot[inner]] * value[inner], len(some))
            cuts = np.cumsum(np.concatenate([params[1][:1], np.exp(params[1][1:])]))
            below = np.concatenate([np.zeros((len(some), 1)), sigmoid(cuts[None, :] - eta[:, None]), np.ones((len(some), 1))], 1)
            at = np.arange(len(some))
            lo, hi = below[at, rank[some]], below[at, rank[some] + 1]
            p = np.maximum(hi - lo, 1e-9)
            w = balance[some] / len(some)
            # derivatives of -log p by the two cuts around the grade
            d_hi, d_lo = -hi * (1 - hi) / p * w, lo * (1 - lo) / p * w
            d_eta = -(d_hi + d_lo)
            grads = [np.bincount(slot[inner], d_eta[owner] * value[inner], SIZE) + ridge * params[0]]
            by_cut = np.bincount(rank[some], d_hi, k + 1)[:k] + np.bincount(rank[some], d_lo, k + 1)[1:]
            by_step = np.cumsum(by_cut[::-1])[::-1]
            grads.append(np.concatenate([by_step[:1], by_step[1:] * np.exp(params[1][1:])]))
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(levels.astype(float), params[0], np.cumsum(np.concatenate([params[1][:1], np.exp(params[1][1:])])))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Trains on the bounded sample of labelled.sample: per grade MAX_PER_CLASS texts, MAX_BYTES in all."""
    texts, grades = sample(docs, labels, "quality", learn, id_col, text_col)
    return train(texts, grades)


def graded(docs: DataFrame, model: OrdinalModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, expected_grade, tail_probability, kept), one per row of docs.

    tail_probability: that the grade is the best one; kept: it is at the threshold or above. Null
    texts count as empty. With labels of one grade only every text has that grade and is kept; without
    labels the expected grade is 0 and all are kept. Repeated rows and null ids stay; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model: OrdinalModel = shared.value
        for b in slices(batches, "t"):
            tails = model.tails(b.column("t"))
            top = tails[:, -1] if tails.shape[1] else np.ones(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(model.expected(tails)), pa.array(top), pa.array(top >= threshold)], ["id", "expected_grade", "tail_probability", "kept"])

    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")

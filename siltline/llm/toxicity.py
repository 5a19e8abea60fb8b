"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A passage is WINDOW consecutive words (a shorter text is one passage). Its bag holds, word by word, the character
n-grams (3 to 5, with marked ends) and the word itself, hashed to buckets. The bag's embeddings are averaged and a linear
softmax over two classes gives the passage's probability; embeddings and softmax are trained jointly in NumPy. A text
scores what its most toxic passage does (multiple-instance learning: a toxic text has such a passage, a clean one has
none), so one insult in a long text is not averaged away. Unseen misspellings share n-gram vectors with the words they come from.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltline.llm.labelled import sample
from siltline.llm.text import mixed, slices, split_words
from siltline.session import ship

BUCKETS, DIM, SIZES = 1 << 16, 8, (3, 4, 5)
EDGE = ".,;:!?()[]{}<>\"'`#*$%&|_~^+=/\\-"


#: Words of a passage; the passages of a clean text that are learnt from, the most toxic ones.
WINDOW, HARD = 5, 3
#: Texts whose passages are held at once in training; steps of a round, at least.
TEXTS, STEPS = 128, 24
#: Words are cut into bags so many at a time, which bounds the work arrays.
CHUNK = 1 << 15


def bags(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the subword buckets of each word, one after the other; every word has one at least."""
    parts = [_bags(words.slice(i, CHUNK)) for i in range(0, len(words), CHUNK)]
    if not parts:
        return np.zeros(0, np.uint16), np.zeros(0, np.int64)
    before = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + n for p, n in zip(parts, before, strict=True)])


def _bags(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = pc.utf8_trim(pc.utf8_lower(words), characters=EDGE)
    marked = pc.binary_join_element_wise("<", words, ">", "")
    length = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.cumsum(length)
    word = np.repeat(np.arange(len(length)), length)
    room = ends[word] - np.arange(len(points)) if len(points) else np.zeros(0, np.int64)
    found, owner = [], []
    with np.errstate(over="ignore"):
        for n in SIZES:
            at = np.flatnonzero(room >= n)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) ^ points[at + j]
            found.append(mixed(h) % np.uint64(BUCKETS))
            owner.append(word[at])
        power = np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(points)) - (ends - length)[word]).astype(np.uint64)
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(points * power, out=prefix[1:])
        whole = prefix[ends] - prefix[ends - length]
    found.append(mixed(whole) % np.uint64(BUCKETS))
    owner.append(np.arange(len(length)))
    owner, found = np.concatenate(owner), np.concatenate(found).astype(np.uint16)
    order = np.argsort(owner, kind="stable")
    return found[order], np.cumsum(np.bincount(owner, minlength=len(length)))


@dataclass
class ToxicityModel:
    """margin: per bucket, the difference of the two class logits that its embedding makes; bias: that of the softmax.

    The average of embeddings and the linear layer commute, so a passage's margin is an average of bucket margins.
    """

    margin: np.ndarray
    bias: float
    constant: float | None = None

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the margins, number) of each word's buckets."""
        total, size = np.zeros(len(words)), np.zeros(len(words))
        for i in range(0, len(words), CHUNK):
            buckets, ends = _bags(words.slice(i, CHUNK))
            starts = np.concatenate([[0], ends[:-1]])
            total[i : i + CHUNK] = np.add.reduceat(self.margin[buckets], starts, dtype=float)
            size[i : i + CHUNK] = ends - starts
        return total, size

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        at, words = split_words(texts)
        coded = words.dictionary_encode()
        total, size = self.words(coded.dictionary)
        ids = coded.indices.to_numpy(zero_copy_only=False)
        margin, first = passages(total[ids], size[ids], at)
        return softmax(largest(margin + self.bias, first, -30.0))


def softmax(margin: np.ndarray) -> np.ndarray:
    """The second class's probability for a difference of logits."""
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def passages(total: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(average over each passage, first passage of each text and the end); at: first word of each text and the end."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(1, n - WINDOW + 1), 0)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], count) + np.repeat(at[:-1], count)
    end = np.minimum(start + WINDOW, np.repeat(at[1:], count))
    sums, sizes = np.concatenate([[0.0], np.cumsum(total)]), np.concatenate([[0.0], np.cumsum(size)])
    return (sums[end] - sums[start]) / np.maximum(1.0, sizes[end] - sizes[start]), first


def largest(values: np.ndarray, at: np.ndarray, none: float) -> np.ndarray:
    """The largest value of each text; `none` for one without."""
    out = np.full(len(at) - 1, none)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.maximum.reduceat(values, at[full])
    return out


class _Trainer:
    """Adam over embeddings and softmax, on the bags of passages."""

    def __init__(self, words: pa.Array, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.buckets, self.ends = bags(words)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.params = [rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]
        self.steps = 0

    def gathered(self, some: np.ndarray):
        """Buckets, their passage, and their number per passage; some: words of each passage, -1 beyond its end."""
        word, owner = some[some >= 0], np.repeat(np.arange(len(some)), (some >= 0).sum(1))
        size = self.ends[word] - self.starts[word]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        buckets = self.buckets[np.repeat(self.starts[word], size) + inner]
        return buckets, np.repeat(owner, size), np.bincount(owner, size, len(some)).astype(np.int64)

    def step(self, some: np.ndarray, target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One step on passages, with the share of class 1 and the weight of each."""
        embed, linear, bias = self.params
        buckets, owner, size = self.gathered(some)
        edges = np.cumsum(size) - size
        mean = np.add.reduceat(embed[buckets], edges, axis=0) / size[:, None]
        logits = mean @ linear + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        delta = (p - np.stack([1 - target, target], 1)) * (weight / weight.sum())[:, None]
        back = (delta @ linear.T / size[:, None]).astype(np.float32)
        different, place = np.unique(buckets, return_inverse=True)
        grad = np.stack([np.bincount(place, back[owner, d], len(different)) for d in range(DIM)], 1).astype(np.float32)
        self.steps += 1
        self._adam(0, grad, rate, different)
        self._adam(1, (mean.T @ delta).astype(np.float32), rate, slice(None))
        self._adam(2, delta.sum(0).astype(np.float32), rate, slice(None))

    def _adam(self, k: int, grad: np.ndarray, rate: float, rows) -> None:
        m, v = self.moments[k]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        at = min(self.steps, 400)
        self.params[k][rows] -= rate * (m[rows] / (1 - 0.9**at)) / (np.sqrt(v[rows] / (1 - 0.99**at)) + 1e-8)

    def margins(self) -> tuple[np.ndarray, float]:
        embed, linear, bias = self.params
        return embed @ (linear[:, 1] - linear[:, 0]), float(bias[1] - bias[0])

    def of_words(self) -> tuple[np.ndarray, np.ndarray]:
        margin, _ = self.margins()
        return np.add.reduceat(margin[self.buckets], self.starts, dtype=float), (self.ends - self.starts).astype(float)


def train(texts: pa.Array, labels: np.ndarray, epochs: int = 3, rounds: int = 10, batch: int = 8192, seed: int = 7) -> ToxicityModel:
    """First passages of one word each, by how often the texts that hold them are toxic; then the passages that score highest: those
    of toxic texts are toxic, those of clean texts are not."""
    if len(labels) == 0 or labels.min() == labels.max():
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    at, words = split_words(texts)
    coded = words.dictionary_encode()
    del words
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    n = len(coded.dictionary)
    held, toxic = np.zeros(n, np.int64), np.zeros(n)
    for block in range(0, len(texts), TEXTS):
        inner = at[block : block + TEXTS + 1]
        owner = np.repeat(np.arange(len(inner) - 1), np.diff(inner))
        pairs = np.unique(owner * n + ids[inner[0] : inner[-1]])
        held += np.bincount(pairs % n, minlength=n)
        toxic += np.bincount(pairs % n, labels[block : block + TEXTS][pairs // n].astype(float), n)
    toxic /= held
    trainer = _Trainer(coded.dictionary, seed)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(n), max(1, n // batch)):
            trainer.step(some[:, None], toxic[some], np.minimum(held[some], 50).astype(float), 0.02)
    for k in range(rounds):
        total, size = trainer.of_words()
        top, clean = [], []
        for block in range(0, len(texts), TEXTS):
            inner = at[block : block + TEXTS + 1]
            some = ids[inner[0] : inner[-1]]
            margin, first = passages(total[some], size[some], inner - inner[0])
            for i, (lo, hi) in enumerate(pairwise(first.tolist()), block):
                if lo == hi:
                    continue
                most = min(1 if labels[i] else HARD, hi - lo)
                best = (np.argpartition(-margin[lo:hi], most - 1)[:most] + at[i]).tolist()
                (top if labels[i] else clean).extend((b, int(at[i + 1])) for b in best)
        if not top or not clean:
            break
        start, stop = np.array(top + clean).T
        place = start[:, None] + np.arange(WINDOW)
        some = np.where(place < stop[:, None], ids[np.minimum(place, len(ids) - 1)], -1)
        target = np.repeat([1.0, 0.0], [len(top), len(clean)])
        weight = np.repeat([1.0, max(0.2, len(top) / len(clean))], [len(top), len(clean)])
        parts = max(1, len(some) // 1024)
        for _ in range(-(-STEPS // parts)):
            for part in np.array_split(rng.permutation(len(some)), parts):
                trainer.step(some[part], target[part], weight[part], 0.02 if k < rounds // 2 else 0.01)
    model = ToxicityModel(*trainer.margins())
    del trainer, coded
    pa.default_memory_pool().release_unused()
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Trains on the bounded sample of labelled.sample: per class MAX_PER_CLASS texts, MAX_BYTES in all."""
    texts, y = sample(docs, labels, "toxic", learn, id_col, text_col)
    return train(texts, (y > 0).astype(np.int64))


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each whole text; null and blank texts have no passage and score next to 0.

    An input column of that name is replaced. Without labels of both classes the score is the share of
    toxic ones (0 without labels). Repeated rows and null ids are scored like any other.
    """
    columns = [c for c in docs.columns if c != name]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(shared.value.score(b.column(text_col)), pa.float64())], [*columns, name])

    ship(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, f"{kinds}, {name} double")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores at the threshold or above."""
    name = "toxicity__"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return scored(docs, model, text_col, name).where(F.col(name) < threshold).select(*docs.columns)

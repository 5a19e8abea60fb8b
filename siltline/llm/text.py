"""Words of texts, in Arrow and NumPy.

A word is a run of characters other than space and TAB..CR, `[^\x20\x09-\x0D]+`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Odd factors of rolling hashes; words of a wide fingerprint.
ODD, LANES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 4


def slices(batches, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut to about max_bytes of text (one row at least), so that work arrays stay small."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array]:
    """(first word of each text and the end, all words); null and blank texts have none. lower: A-Z only."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, at = parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))])
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        at = np.concatenate([[0], np.cumsum(full)])[at]
        flat = flat.filter(pa.array(full))
    return at, flat


def raw_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null: empty."""
    return pc.fill_null(texts, "").cast(pa.binary()).to_pylist()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash per word, by distinct word."""
    import xxhash

    coded = words.dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in known), np.uint64, len(known))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.uint64)


class Rolling:
    """Hashes of runs of words: polynomials modulo 2**64 over prefix sums."""

    def __init__(self, hashes: np.ndarray, odd: int = ODD[0]):
        with np.errstate(over="ignore"):
            n = len(hashes) + 1
            factors = np.full(n, odd, np.uint64)
            factors[0] = 1
            power = np.multiply.accumulate(factors)
            factors[1:] = pow(odd, -1, 1 << 64)
            self.back = np.multiply.accumulate(factors)
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(hashes * power[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, words: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.sums[starts + words] - self.sums[starts]) * self.back[starts])


def wide_simhash(shingles: np.ndarray) -> np.ndarray:
    """64 * LANES bits, as LANES words, of shingle hashes: a bit is set if it is in over half of them."""
    with np.errstate(over="ignore"):
        h = np.stack([mixed(shingles + np.uint64((lane + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for lane in range(LANES)], 1)
    bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8 * LANES), axis=1, bitorder="little")
    total = np.zeros(64 * LANES, np.int64)
    for lo in range(0, len(bits), 255):
        total += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h), bitorder="little").view(np.uint64)

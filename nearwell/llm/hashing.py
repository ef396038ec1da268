"""Word and shingle hashes of whole Arrow batches of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
CHUNK_BYTES = 4 << 20
#: Chunks whose arrays, of eight bytes and more a byte of text, stay in a core's cache.
CACHED_BYTES = 256 << 10

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_OTHER_BYTES = np.random.default_rng(21).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values; another order for every salt."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & (1 << 64) - 1)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        x ^= x >> np.uint64(32)
        return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those of a usual chunk are kept."""
    if n <= CACHED_BYTES + 1:
        return _kept_powers(base)[:n]
    return _new_powers(base, n)


def _new_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


@cache
def _kept_powers(base: np.uint64) -> np.ndarray:
    out = _new_powers(base, CACHED_BYTES + 1)
    out.setflags(write=False)
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, joined, and the n + 1 offsets; null is an empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of ``data[i:i + size]`` for every i, cut off at the end."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * _powers(_MULT, n + 1)[:n], out=total[1:])
        sums = np.full(n, total[n])
        sums[:max(0, n - size)] = total[size:n]
        sums -= total[:n]
        sums *= _powers(_INVERSE, n + 1)[:n]
        return mix(sums, 2)


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each ``data[begin:end]``, of other byte values than those of ``rolling``."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_OTHER_BYTES[data] * _powers(_MULT, n + 1)[:n], out=total[1:])
        return mix((total[end] - total[begin]) * _powers(_INVERSE, n + 1)[begin], 20)


def content_hashes(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function (begin, end) to hashes of ``values[begin:end]``, which must be hashes themselves."""
    n = len(values)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(_MULT, n + 1)[:n], out=total[1:])

    def of(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((total[end] - total[begin]) * _powers(_INVERSE, n + 1)[begin], 30)
    return of


class Words:
    """Words of a chunk of texts: where each starts and ends, its hash, and words per text."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = text_bytes(texts)
        n = len(self.data)
        space = _SPACE[self.data]
        edge = np.ones(n + 1, bool)  # a word may begin here: after a space or at a text's start
        edge[1:] = np.append(space, True)[:n]
        edge[self.offsets] = True
        inner = ~space
        self.starts = np.flatnonzero(inner & edge[:n])
        self.ends = np.flatnonzero(inner & np.append(edge[1:n] | space[1:n], True)[:n]) + 1
        with np.errstate(over="ignore"):
            powers = _powers(_MULT, n + 1)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.data] * powers[:n], out=total[1:])
            raw = (total[self.ends] - total[self.starts]) * _powers(_INVERSE, n + 1)[self.starts]
        self.hashes = mix(raw)
        #: offsets of each text's words among all words
        self.bounds = np.searchsorted(self.starts, self.offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words, text by text, and the offsets of each text's runs.

    A text of fewer words, but at least one, has one shingle: all its words.
    """
    h, counts = words.hashes, words.counts
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(per_text)))
    first = words.bounds[:-1]
    at = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], per_text)
    left = np.repeat(words.bounds[1:], per_text) - at
    out = np.zeros(len(at), np.uint64)
    padded = np.append(h, np.zeros(size, np.uint64))
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0xA0761D6478BD642F) + np.where(k < left, padded[at + k],
                                                               np.uint64(1))
    return mix(out, 1), bounds

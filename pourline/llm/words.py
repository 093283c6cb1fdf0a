"""Texts cut into words a batch at a time, with numpy, and 64-bit keys of the words.

A batch's texts are joined into one buffer, so that a cut costs a few passes over
bytes and no work per word in Python.  A key depends on the word's bytes alone: a
polynomial over fixed random values of the bytes, modulo 2 ** 64, and a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import LOWER

#: Bytes of text that one vectorized step takes at most, unless one text is longer, and bytes whose keys are made at a time.
STEP_BYTES, PART = 1_500_000, 1 << 17
_LOWER = bytes(LOWER.get(c, c) for c in range(256))
#: The six white-space characters that end a word.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240531)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def steps(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Cut a batch into parts of bounded text (one text at least), and let go of what the last part needed."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        limit = (ends[start - 1] if start else 0) + STEP_BYTES
        stop = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        part = batch.slice(start, stop - start)
        yield part, part.column(column).to_pylist()
        start = stop
    pa.default_memory_pool().release_unused()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            factors = np.full(max(n, PART), base, np.uint64)
            factors[0] = 1
            _POWERS[i] = np.multiply.accumulate(factors)
    return _POWERS[0], _POWERS[1]


class Words:
    """Where the words of some texts are: ``data`` is the joined buffer, ``counts`` how many words each text has."""

    def __init__(self, texts: list[bytes], blank: np.ndarray = BLANK):
        self.data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
        white = blank[self.data]
        edges = np.flatnonzero(white[1:] != white[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        begins = 1 + np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        self.begins = begins  # of each text in the buffer, and one past the last
        self.bounds = np.searchsorted(self.starts, begins)  # the words of text k are bounds[k]:bounds[k + 1]
        self.counts = np.diff(self.bounds)

    def keys(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            low = int(self.starts[at])
            stop = max(at + 1, int(np.searchsorted(self.ends, low + PART, "right")))
            high = int(self.ends[stop - 1])
            up, down = _powers(high - low)
            total = np.cumsum(_VALUE[self.data[low:high]] * up[: high - low])
            first = self.starts[at:stop] - low
            key = total[self.ends[at:stop] - low - 1]
            key[1:] -= total[first[1:] - 1]
            key *= down[first]
            key = (key ^ (key >> np.uint64(29))) * _M2
            out[at:stop] = key ^ (key >> np.uint64(32))
            at = stop
        return out

    def dictionary(self) -> tuple[np.ndarray, list[bytes]]:
        """(number of each word among the different words, the different words)."""
        lengths = self.ends - self.starts
        inside = np.zeros(len(self.data) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        packed = self.data[np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        return words.indices.to_numpy(), words.dictionary.to_pylist()


def lower_words(texts: list[str | None]) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a null text is empty."""
    return Words([(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts])

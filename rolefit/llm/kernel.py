"""Numeric helpers for one Arrow batch of texts: words, their hashes, hashes of word runs.

Bytes are hashed by a polynomial modulo 2**64 with prefix sums, so a batch costs a fixed number of numpy passes
whatever its words are. Slices bound the memory: it grows with the longest word, not with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that end a word: the ASCII white space.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and all other ASCII characters but letters and digits.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[c for c in range(128) if not chr(c).isalnum()]] = True

SLICE = 1 << 20
#: Bytes that are hashed at a time: eight times as many, in a few arrays, stay in a core's cache.
HASHED = 1 << 16
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))
#: The same for upper and lower case A-Z.
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[65:91] = BYTE[97:123]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span; `values` are unsigned 64-bit numbers."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` consecutive values."""
    n = len(values) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(values, starts, starts + size)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of `width`."""
    n, span = len(x) - width + 1, 1
    if n < 1:
        return x[:0]
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


def word_spans(data: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([False], ~ends_word[data], [False])).view(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASHED, side="right")))
        low, high = starts[i], ends[j - 1]
        out[i:j] = span_hashes(table[data[low:high]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


class Words:
    """Words of some texts: bytes, spans, hashes, and first[k]:first[k + 1] the words of text k."""

    def __init__(self, texts: pa.Array, ends_word: np.ndarray = SPACE, table: np.ndarray = BYTE):
        ended = pc.binary_join_element_wise(texts.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
        if isinstance(ended, pa.ChunkedArray):
            ended = ended.combine_chunks()
        offsets = np.frombuffer(ended.buffers()[1], np.int64)[ended.offset : ended.offset + len(ended) + 1]
        raw = np.frombuffer(ended.buffers()[2], np.uint8) if ended.buffers()[2] else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.starts, self.ends = word_spans(self.data, ends_word)
        self.hashes = word_hashes(self.data, self.starts, self.ends, table)
        self.first = np.searchsorted(self.starts, self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, size: int = 4 * SLICE) -> Iterator[tuple[int, pa.Array]]:
    """Parts of `texts` of about `size` bytes (one text at least), with the index of their first text; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j


class Generations(dict):
    """A cache of at most 2 * `size` entries: what was asked for lately stays."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def whole_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that no run of equal values in the first `keys` columns (64-bit numbers) is divided."""
    pieces: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        if pieces and last != tuple(c[0] for c in columns):
            yield pa.concat_batches(pieces)
            pieces = []
        last = tuple(c[-1] for c in columns)
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        if len(change):
            yield pa.concat_batches([*pieces, batch.slice(0, change[-1])])
            pieces = [batch.slice(change[-1])]
        else:
            pieces.append(batch)
    if pieces:
        yield pa.concat_batches(pieces)

"""Byte-level BPE: texts to token ids and back, by the merge ranks of a vocabulary file.

Within one match of the split pattern the rank of every adjacent pair stands in a segment tree over the byte positions,
whose root is the leftmost pair of least rank. A merge changes the tree at three places at most, so a match of n bytes
costs O(n log n), which keeps a text that is one long run of letters cheap. Short matches are merged together, each with a
tree of its own, one merge of every match at a time; long ones by themselves. A batch is cut into chunks that no match
crosses, and each distinct chunk is encoded once.

Null and empty texts have no tokens. Ids are packed as little-endian unsigned 32-bit integers in a binary column.
Columns of the same name as a result are replaced; all others pass through. Every row is worked on by itself, so
repeated rows and ties need no rule, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import STRETCH, Bytes, Lookup
from .common import release, with_new

#: Matches that are merged at once.
ROWS = 1 << 14


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64, a blank, the rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one match."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    parts = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(0, n - 2).bit_length()
    none = 1 << 62  # no pair here; a leaf is else rank * n + position, so that the least is also the leftmost
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * n + i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    while (least := tree[1]) != none:
        i = least % n
        j = after[i]
        parts[i] += parts[j]
        after[i] = end = after[j]
        changed = []
        if end < n:
            before[end] = i
            rank = get(parts[i] + parts[end])
            changed.append((i, none if rank is None else rank * n + i))
            changed.append((j, none))
        else:
            changed.append((i, none))
            if j < n - 1:
                changed.append((j, none))
        if (p := before[i]) >= 0:
            rank = get(parts[p] + parts[i])
            changed.append((p, none if rank is None else rank * n + p))
        for k, value in changed:
            k += size
            tree[k] = value
            k >>= 1
            while k:
                left, right = tree[2 * k], tree[2 * k + 1]
                least = left if left < right else right
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1
    ids, i = [], 0
    while i < n:
        ids.append(ranks[parts[i]])
        i = after[i]
    return ids


class Pairs:
    """Ranks of pairs of token ids, by a sorted table of all pairs whose bytes together are a token."""

    def __init__(self, ranks: dict[bytes, int]):
        get = ranks.get
        found = array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (left := get(token[:k])) is not None and (right := get(token[k:])) is not None:
                    found.extend((left, right, rank))
        table = np.array(found, np.int64).reshape(-1, 3)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], table[order, 2]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none."""
        if not len(self.keys):
            return np.full(left.shape, NONE)
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)


#: No pair here; above every rank, and with a place still a 64-bit number.
NONE = np.int64(1 << 40)
#: Bytes of the longest match that is merged among others.
TOGETHER = 64


def merge_many(pieces: list[bytes], first: np.ndarray, pairs: Pairs) -> list[bytes]:
    """Packed token ids of matches of 2 to TOGETHER bytes: the trees of all of them, one merge of each at a time.

    `first` holds the ids of the single bytes. A tree is a row; the leaves of a row are its byte positions.
    """
    if not pieces:
        return []
    n, lengths = len(pieces), np.array([len(p) for p in pieces])
    size = 1 << int(lengths.max() - 1).bit_length()
    flat = first[np.frombuffer(b"".join(pieces), np.uint8)]
    inside = np.arange(size) < lengths[:, None]
    token = np.full((n, size), -1, np.int64)
    token[inside] = flat
    after = np.tile(np.arange(1, size + 1), (n, 1))
    before = np.tile(np.arange(-1, size), (n, 1))  # one place more, for the end of a full row
    leaves = np.full((n, size), NONE * size)
    both = inside[:, 1:]
    place = np.broadcast_to(np.arange(size - 1), (n, size - 1))[both]
    leaves[:, :-1][both] = pairs.of(token[:, :-1][both], token[:, 1:][both]) * size + place
    tree = [leaves]
    while tree[-1].shape[1] > 1:
        tree.append(np.minimum(tree[-1][:, ::2], tree[-1][:, 1::2]))

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
        tree[0][rows, at] = values
        for below, level in zip(tree[:-1], tree[1:]):
            at = at >> 1
            level[rows, at] = np.minimum(below[rows, 2 * at], below[rows, 2 * at + 1])

    live = np.flatnonzero(tree[-1][:, 0] < NONE * size)
    while len(live):
        least = tree[-1][live, 0]
        i, merged = least % size, least // size  # the rank of a pair is the id of its token
        j = after[live, i]
        end = after[live, j]
        token[live, i], token[live, j] = merged, -1
        after[live, i] = end
        before[live, end] = i
        put(live, j, NONE * size)
        more = end < lengths[live]
        rank = np.full(len(live), NONE)
        rank[more] = pairs.of(merged[more], token[live[more], end[more]])
        put(live, i, rank * size + i)
        has = before[live, i] >= 0
        rows, left = live[has], before[live[has], i[has]]
        put(rows, left, pairs.of(token[rows, left], merged[has]) * size + left)
        live = live[tree[-1][live, 0] < NONE * size]
    kept = token >= 0
    packed, ends = token[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(axis=1))
    return [packed[low:high] for low, high in zip([0, *ends[:-1].tolist()], ends.tolist())]


class Codec:
    """What a task keeps between batches: the split pattern, the ranks and the chunks met lately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        # Chunks are cut where the pattern of public byte-level vocabularies never matches across.
        self.lookup = Lookup(self.pack_many) if pattern == public_tokenizers.PATTERN else None
        tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens, self.pairs = Bytes(tokens), Pairs(ranks)
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def pack_many(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of each chunk, from its matches; each distinct match is merged once."""
        matches = list(map(self.find, chunks))
        done: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        for match in {m for own in matches for m in own}:
            piece = match.encode()
            if (whole := self.ranks.get(piece)) is not None:
                done[match] = struct.pack("<I", whole)
            elif len(piece) <= TOGETHER:
                by_size.setdefault((len(piece) - 1).bit_length(), []).append(match)
            else:
                ids = merge(piece, self.ranks)
                done[match] = struct.pack(f"<{len(ids)}I", *ids)
        for own in by_size.values():
            for i in range(0, len(own), ROWS):
                some = own[i : i + ROWS]
                done.update(zip(some, merge_many([m.encode() for m in some], self.first, self.pairs)))
        return [done[own[0]] if len(own) == 1 else b"".join(map(done.__getitem__, own)) for own in matches]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return self.lookup.encode(texts) if self.lookup else self.pack_many(texts)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of the tokens of each text, gathered for some texts at a time."""
        out: list[bytes] = []
        i = 0
        while i < len(packed):
            j, size = i, 0
            while j < len(packed) and (j == i or size + len(packed[j]) <= STRETCH):
                size += len(packed[j])
                j += 1
            ids = np.frombuffer(b"".join(packed[i:j]), "<u4")
            ends = np.concatenate(([0], np.cumsum(self.tokens.lengths[ids], dtype=np.int64)))[np.cumsum([0, *map(len, packed[i:j])]) // 4]
            flat = self.tokens.of(ids).tobytes()
            out += [flat[low:high] for low, high in zip(ends[:-1].tolist(), ends[1:].tolist())]
            i = j
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]


def vocabulary(spark, path: str, pattern: str):
    """The ranks as a broadcast value: a vocabulary file is small (some MB) whatever the corpus is."""
    return spark.sparkContext.broadcast((read_ranks(path), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the binary column `ids`: the token ids of the whole text."""
    shared = vocabulary(df.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(*shared.value)
        for texts in batches:
            yield pa.array(codec.encode_all([t or "" for t in texts.to_pylist()]), pa.binary())
        del codec
        release()

    return with_new(df, {ids: encoded(F.col(text))})


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with the binary column `out`: the bytes of the tokens in `ids` (null ids: empty)."""
    shared = vocabulary(df.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(*shared.value)
        for packed in batches:
            yield pa.array(codec.decode_all([b or b"" for b in packed.to_pylist()]), pa.binary())
        del codec
        release()

    return with_new(df, {out: decoded(F.col(ids))})


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encode` and `decode` in one Python worker for each task: `df` with `ids` and `out`."""
    shared = vocabulary(df.sparkSession, path, pattern)

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(*shared.value)
        texts = packed = None
        for texts in batches:
            packed = codec.encode_all([t or "" for t in texts.to_pylist()])
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(codec.decode_all(packed), pa.binary())], ["ids", "decoded"])
        del codec, texts, packed
        release()

    pair = both(F.col(text))
    return with_new(df, {ids: pair["ids"], out: pair["decoded"]})

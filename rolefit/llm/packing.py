"""Packing of documents into sequences of a fixed number of tokens, as few as can be, by patterns of lengths.

1. Documents become pieces of token ids with an end token; only a longer one is cut, and only its first piece is short.
2. The histogram of lengths, which is as large as a sequence whatever the corpus is, is fitted on the driver: patterns of up
   to three lengths that fill a sequence are the columns of a non-negative least-squares problem, their repeat counts its
   unknowns. Columns with the best gradients enter together, and those that turn negative leave again. Lengths weigh as
   much as they fill, since short pieces find a place anyway.
3. Repeat counts are rounded down, never beyond what is there. The residual histogram is packed longest first into the fullest
   sequence that takes it; equal sequences are one entry with a count, so this too depends on lengths only.
4. Pieces are numbered by length over range partitions. The plan names, for each stretch of these numbers, the first
   sequence and the place in it, so every piece finds its place by itself, however many share a length.

Null and empty texts are one end token. Repeated rows are packed each. An empty table gives an empty one. A very long text
is cut into as many pieces as it needs; it is tokenized in stretches. Of other columns, only those named are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, numbered
from .tokens import encoder

#: Columns that enter the least-squares problem in one round, and rounds at most.
ENTER, ROUNDS = 256, 40
#: Shares of the fitted repeat counts that are tried.
SHARES = (1.0, 0.9, 0.7, 0.4, 0.1)


def fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], float]]:
    """Patterns of two or three lengths that sum to `size`, with their fitted repeat counts.

    `histogram[k]` is the number of pieces of length k, up to `size`.
    """
    h = histogram.astype(float)
    weight = (np.arange(size + 1) / size) ** 2
    # All pairs of lengths a >= b with the rest c = size - a - b <= b; c = 0 is a pattern of two.
    a, b = np.meshgrid(np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32), indexing="ij")
    c = size - a - b
    there = h > 0
    there[0] = True
    ok = (b >= 1) & (a >= b) & (c >= 0) & (c <= b) & there[a] & there[b] & there[np.maximum(c, 0)]
    columns = np.stack([a[ok], b[ok], c[ok]])  # length 0 is an empty place
    if not columns.shape[1]:
        return []
    chosen = np.zeros(columns.shape[1], bool)
    x = np.zeros(columns.shape[1])
    residual = h.copy()
    for _ in range(ROUNDS):
        pull = weight * residual
        pull[0] = 0
        gradient = pull[columns].sum(axis=0)
        gradient[chosen] = 0
        best = np.argpartition(-gradient, min(8 * ENTER, len(gradient) - 1))[: 8 * ENTER]
        best = best[np.argsort(-gradient[best], kind="stable")]
        used, entered = np.zeros(size + 1, bool), 0
        for k in best[gradient[best] > 1e-3]:
            lengths = columns[:, k]
            lengths = lengths[lengths > 0]
            if entered < ENTER and not used[lengths].any():
                used[lengths] = chosen[k] = True
                entered += 1
        if not entered:
            break
        while True:
            active = np.flatnonzero(chosen)
            x[active] = _least_squares(columns[:, active], h, weight, x[active])
            wrong = active[x[active] < 0]
            if not len(wrong):
                break
            x[wrong], chosen[wrong] = 0, False
        residual = h - np.bincount(columns.ravel(), np.tile(x, 3), minlength=size + 1)
        residual[0] = 0
    return [(tuple(int(v) for v in columns[:, k] if v), float(x[k])) for k in np.argsort(-x, kind="stable") if x[k] > 0]


def _least_squares(columns: np.ndarray, h: np.ndarray, weight: np.ndarray, x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Repeat counts of these columns that fit `h` best, by conjugate gradients from `x`."""
    n = len(weight)
    weight = weight.copy()
    weight[0] = 0

    def forward(v: np.ndarray) -> np.ndarray:
        return np.bincount(columns.ravel(), np.tile(v, 3), minlength=n)

    r = (weight * (h - forward(x)))[columns].sum(axis=0)
    p, norm = r.copy(), r @ r
    for _ in range(steps):
        if norm < 1e-12:
            break
        q = (weight * forward(p))[columns].sum(axis=0)
        along = p @ q
        if along <= 0:
            break
        x = x + norm / along * p
        r = r - norm / along * q
        new = r @ r
        p, norm = r + new / norm * p, new
    return x


def plan(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) and how many sequences each fills; together they hold the whole histogram.

    Fitted counts are rounded down after some shares of them, which leave more or less for the residual; the plan with the
    fewest sequences is kept.
    """
    left = histogram.astype(np.int64)
    left[0] = 0
    out = [((size,), int(left[size]))] if left[size] else []
    left[size] = 0
    patterns = fit(left, size)
    plans = []
    for share in SHARES if patterns else (0.0,):
        rest, repeated = left.copy(), []
        for lengths, repeats in patterns:
            take = min(int(repeats * share), *(int(rest[v]) // lengths.count(v) for v in lengths))
            if take > 0:
                repeated.append((lengths, take))
                np.subtract.at(rest, list(lengths), take)
        plans.append(repeated + best_fit(rest, size))
    return out + min(plans, key=lambda p: sum(count for _, count in p))


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first into the fullest sequence that takes it; sequences of equal content are one entry with a count."""
    open_by_space: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces = np.zeros(size + 1, bool)
    full: list[tuple[tuple[int, ...], int]] = []

    def put(content: tuple[int, ...], count: int, space: int) -> None:
        if not count:
            return
        if space:
            open_by_space.setdefault(space, []).append((content, count))
            spaces[space] = True
        else:
            full.append((content, count))

    for length in range(size, 0, -1):
        count = int(histogram[length])
        while count:
            space = length + int(np.argmax(spaces[length:])) if spaces[length:].any() else 0
            if space:
                content, there = open_by_space[space].pop()
                if not open_by_space[space]:
                    spaces[space] = False
            else:
                content, there, space = (), count, size
            each = space // length
            whole = min(there, count // each)
            put(content + (length,) * each, whole, space - each * length)
            count -= whole * each
            there -= whole
            if there and count:  # the last one takes what is left, which is less than would fit
                put(content + (length,) * count, 1, space - count * length)
                there, count = there - 1, 0
            if there and content:
                put(content, there, space)
    return full + [group for groups in open_by_space.values() for group in groups]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces numbered by length: the first number of each stretch, the sequence of that piece, its offset there."""
    lengths, repeats, sequences, offsets, base = [], [], [], [], 0
    for content, count in patterns:
        offset = 0
        for length in content:
            lengths.append(length)
            repeats.append(count)
            sequences.append(base)
            offsets.append(offset)
            offset += length
        base += count
    order = np.argsort(lengths, kind="stable")
    counts = np.array(repeats, np.int64)[order]
    return np.cumsum(counts) - counts, np.array(sequences, np.int64)[order], np.array(offsets, np.int64)[order]


def pieces(df: DataFrame, path: str, size: int = 2048, keep: tuple[str, ...] = ("doc_id",), text: str = "text", end: int = 0) -> DataFrame:
    """The columns `keep` and piece, start, length, ids (packed, little-endian unsigned 32-bit) of every piece."""
    with open(path, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value)
        for batch in batches:
            rows, numbers, starts, lengths, ids = [], [], [], [], []
            for row, t in enumerate(batch.column(0)):
                whole = np.append(encode([t.as_py() or ""])[0], np.uint32(end)).astype("<u4")
                first = len(whole) % size or min(size, len(whole))
                edges = [0, *range(first, len(whole) + 1, size)]
                for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                    rows.append(row)
                    numbers.append(k)
                    starts.append(low)
                    lengths.append(high - low)
                    ids.append(whole[low:high].tobytes())
            kept = batch.select(range(1, 1 + len(keep))).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary())],
                [*keep, "piece", "start", "length", "ids"],
            )

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(F.col(text), *keep).mapInArrow(built, f"{kinds}, piece int, start bigint, length bigint, ids binary")


def pack(found: DataFrame, size: int = 2048) -> DataFrame:
    """Pieces with a column `length` (1 to `size`), and the sequence_id and offset of each."""
    row, at = free_name(found, "row"), free_name(found, "at")
    written = cut(found.withColumn(row, F.monotonically_increasing_id()), "pieces")
    histogram = np.zeros(size + 1, np.int64)
    for r in written.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `size` rows
        histogram[r["length"]] = r["n"]
    shared = written.sparkSession.sparkContext.broadcast(places(plan(histogram, size)))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def placed(numbers: pa.Array) -> pa.Array:
        firsts, sequences, offsets = shared.value
        given = numbers.to_numpy()
        k = np.searchsorted(firsts, given, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[k] + given - firsts[k]), pa.array(offsets[k])], ["sequence_id", "offset"])

    place = free_name(found, "place")
    ordered = numbered(written, ["length", row], at).withColumn(place, placed(at))
    return ordered.select(*found.columns, F.col(place)["sequence_id"].alias("sequence_id"), F.col(place)["offset"].alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id and the ids of its pieces, packed in order (at most `size` tokens)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))

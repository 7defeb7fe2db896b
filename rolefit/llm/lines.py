"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words (words end at ASCII white space, lines at a line feed). A line is removed if a line
with a Jaccard similarity of `share` or more stands earlier: in a document of smaller id (null ids last), or above it in the
same document. Lines without words are never removed.

1. Words are counted over all texts in a table of fixed size by their hash. Every line's tokens are ordered by that count,
   rarest first, then by the hash: one order for all lines.
2. Lines with the same tokens form a class, which its first line stands for; the others are removed.
3. Prefix filter: two similar lines share a token among the first n - ceil(share * n) + 1 of each; each first line goes to
   each token of its prefix. Where they meet, pairs are dropped by length, by the position of the shared token, and by a
   sketch of parity bits, about as many as tokens (bits that differ cannot be more than tokens that differ). All three
   lose no similar pair. The lines of many tokens travel together, as arrays in a row for each bucket of tokens; the
   number of buckets grows with the prefixes.
4. Of the pairs that are left, each line keeps the earliest for each token: one similar line is enough. The tokens of both
   are fetched once, from the texts that have a line asked for, and the Jaccard similarity is worked out. Lines without
   success try all the candidates that were left out.
5. The removed lines' numbers go back to the texts that lose lines; the others are not shuffled.

A prefix token above `limit` lines is dealt in blocks that meet in pairs, so no task gets a hot token whole. The tables that
say which texts and lines are asked for grow with these, from 2**22 up to 2**28 bits (32 MB); beyond, more lines than asked for
are fetched and fall out in the join.

Lines with the same id and number (repeated rows) do not stand earlier than each other, so both stay; texts that share an
id are told apart by 32 bits of a hash. Null texts stay null,
with no lines; an empty text has none either. Columns of the same name as a result are replaced, others pass through; an
empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .kernel import Words, mix, slices, whole_runs

#: Bits of the table of word counts, and the most that a table of marks may have.
COUNT_BITS, MARK_BITS = 18, 28
CHUNK = 1 << 14
#: Prefix tokens in a bucket, about, and those made at a time.
BUCKET, COPIES = 1 << 17, 1 << 20
#: Neighbours in a token's list that are compared in one numpy pass each; longer lists are compared in blocks.
LAGS = 128
LAST_ID = (1 << 63) - 1


def slots(df: DataFrame, bits: int, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """How many hashes begin with each value of their first `bits` bits: a table of fixed size, summed in parts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for h in hashes(batch):
                total += np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        parts = total.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        kind = "<i4" if total.max(initial=0) < 1 << 31 else "<i8"
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[k].astype(kind).tobytes() for k in some], pa.binary())], ["part", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kind = "<i4" if len(counts) == 4 * CHUNK else "<i8"
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.astype("<i8").tobytes() for x in sums.values()], pa.binary())], ["part", "counts"])

    shape = "part bigint, counts binary"
    table = np.zeros((max(1, (1 << bits) // CHUNK), CHUNK), np.int64)
    for row in df.mapInArrow(counted, shape).repartition("part").mapInArrow(summed, shape).collect():
        table[row["part"]] = np.frombuffer(row["counts"], "<i8")
    return table.ravel()[: 1 << bits]


def spot_hashes(o: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return mix(o.view(np.uint64) ^ mix(spot.view(np.uint64)))


def text_hashes(o: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """The same for all spots of one text, which end in 32 bits of its hash."""
    return spot_hashes(o, spot & 0xFFFFFFFF)


class Marks:
    """Which hashes are marked: a table of bits by the first bits of a hash, at least 64 for each marked one up to
    2**MARK_BITS in all. A few others are marked too."""

    def __init__(self, df: DataFrame, rows: int, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        """`df` has columns o and spot, and about `rows` rows."""
        self.bits = bits = min(MARK_BITS, max(22, (64 * rows).bit_length()))
        part = 20

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at = np.unique(hashes(batch.column(0).to_numpy(), batch.column(1).to_numpy()) >> np.uint64(64 - bits)).astype(np.int64)
                    parts, first = np.unique(at >> part, return_index=True)
                    ends = (np.append(first, len(at)) * 4).astype(np.int32)
                    low = (at & ((1 << part) - 1)).astype("<u4")
                    yield pa.RecordBatch.from_arrays([pa.array(parts), binaries(ends, low)], ["part", "places"])

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tables.setdefault(k, np.zeros(1 << part, bool))[np.frombuffer(found, "<u4")] = True
            yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int64()), pa.array([np.packbits(t).tobytes() for t in tables.values()], pa.binary())], ["part", "places"])

        shape = "part bigint, places binary"
        table = np.zeros((1 << (bits - part), (1 << part) >> 3), np.uint8)
        for row in df.select("o", "spot").mapInArrow(places, shape).repartition("part").mapInArrow(joined, shape).collect():
            table[row["part"]] = np.frombuffer(row["places"], np.uint8)
        self.table = df.sparkSession.sparkContext.broadcast(table.ravel())
        self.hashes = hashes

    def of(self, o: np.ndarray, spot: np.ndarray) -> np.ndarray:
        at = (self.hashes(o, spot) >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.table.value[at >> 3] << (at & 7).astype(np.uint8)) & 128 > 0


def binaries(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that are the stretches of `data` between the byte positions `ends`."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data))])


def sorted_within(token: np.ndarray, of: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of each line in order; one sort by the line and the first bits of the token where these tell them apart."""
    bits = max(1, lines.bit_length())
    key = of.astype(np.uint64) << np.uint64(64 - bits) | token >> np.uint64(bits)
    order = np.argsort(key)
    key, found = key[order], token[order]
    if ((key[1:] == key[:-1]) & (found[1:] != found[:-1])).any():
        order = np.lexsort((token, of))
        found = token[order]
    return found, of[order]


class Lines:
    """Distinct tokens of the lines of some texts, rarest first: for line k the values[first[k]:first[k + 1]]."""

    def __init__(self, texts: pa.Array, rank: np.ndarray, wanted: Callable[["Lines"], np.ndarray] | None = None):
        words = Words(texts)
        feeds = np.flatnonzero(words.data == 10)
        line = np.searchsorted(feeds, words.starts)
        self.top = np.searchsorted(feeds, words.offsets[:-1])  # each text's first line
        keep = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))[: len(line)])
        self.line = line[keep]  # those that have words
        self.text = np.searchsorted(words.offsets, words.starts[keep], side="right") - 1
        self.number = self.line - self.top[self.text]
        of = np.repeat(np.arange(len(keep)), np.diff(np.append(keep, len(line))))
        h = words.hashes
        if wanted is not None:
            pick = wanted(self)
            h, of = h[pick[of]], of[pick[of]]
        low = np.uint64(64 - COUNT_BITS)
        token = (rank[(h >> low).astype(np.int64)] << low) | (h & ((np.uint64(1) << low) - np.uint64(1)))
        token, of = sorted_within(token, of, len(keep))
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (of[1:] != of[:-1])))[: len(of)]
        self.values, of = token[new], of[new]
        self.first = np.searchsorted(of, np.arange(len(keep) + 1))


def _order_of(column) -> F.Column:
    return F.coalesce(column.cast("bigint"), F.lit(LAST_ID))


def _spots(number: np.ndarray, body: np.ndarray) -> np.ndarray:
    return number.astype(np.int64) << 32 | (body & 0xFFFFFFFF)


def _parity(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """32 bits of each line, each the parity of the tokens that fall on it."""
    return np.bitwise_xor.reduceat(np.uint32(1) << (values & np.uint64(31)).astype(np.uint32), first) if len(first) else np.zeros(0, np.uint32)


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the sketch of a line of n tokens."""
    return 1 << np.maximum(0, np.ceil(np.log2(np.maximum(1, 0.75 * n / 64))).astype(np.int64))


def _sketches(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Parity bits of each line: 64 or a larger power of two, at least three for four tokens."""
    n = np.diff(first)
    words = sketch_words(n)
    ends = np.concatenate(([0], np.cumsum(words)))
    of = np.repeat(np.arange(len(n)), n)
    bit = (values & (words[of].astype(np.uint64) * np.uint64(64) - np.uint64(1))).astype(np.int64)
    flat = np.zeros(ends[-1], "<u8")
    np.bitwise_xor.at(flat, ends[of] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return binaries(ends * 8, flat)


LEADING = "o bigint, spot bigint, s1 bigint, s2 bigint, sketch binary, prefix array<int>, later array<struct<o:bigint,spot:bigint>>"


def _rows(docs: DataFrame, rank, share: float) -> DataFrame:
    """A row for the first line of each class in a part of a batch: its place, a hash of the tokens (s1), their number and
    parity (s2), the sketch, the prefix, and the places of the part's other lines of that class."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            os, bodies = (batch.column(k).to_numpy() for k in range(2))
            for first, part in slices(batch.column(2)):
                lines = Lines(part, rank.value)
                if not len(lines.line):
                    continue
                n = np.diff(lines.first)
                o, spot = os[first + lines.text], _spots(lines.number, bodies[first + lines.text])
                start = lines.first[:-1]
                s1 = np.add.reduceat(mix(lines.values), start).view(np.int64)
                s2 = n.astype(np.int64) << 32 | _parity(lines.values, start)
                order = np.lexsort((spot, o, s2, s1))
                lead = np.flatnonzero(np.concatenate(([True], (s1[order][1:] != s1[order][:-1]) | (s2[order][1:] != s2[order][:-1]))))
                mine = order[lead]
                size = n[mine] - np.ceil(share * n[mine] - 1e-9).astype(np.int64) + 1
                at = np.repeat(start[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(lines.values[at].astype(np.uint32).view(np.int32)))
                rest = np.delete(order, lead)
                ends = np.append(lead, len(order)) - np.arange(len(lead) + 1)  # without the leading lines themselves
                places = pa.StructArray.from_arrays([pa.array(o[rest]), pa.array(spot[rest])], ["o", "spot"])
                later = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), places)
                sketches = _sketches(lines.values, lines.first).take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in (o, spot, s1, s2)] + [sketches, prefix, later], ["o", "spot", "s1", "s2", "sketch", "prefix", "later"])

    return docs.select("o", "body", "text").mapInArrow(found, LEADING)


def _prefix_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield batch.column(0).flatten().to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32)


ENTRIES = "bucket bigint, route binary, o binary, spot binary, shape binary, sketch binary"


def _entries(firsts: DataFrame, crowds, limit: int, wanted=None) -> DataFrame:
    """A row for each bucket of routes in a part of a batch, with the route, o, spot, shape and sketch of each prefix token
    of each first line as arrays. Tokens that no other line can have are left out.

    route is the token and a pair of its blocks; shape is the line's number of tokens, the place of the token, and the
    side in a pair of different blocks. Only the tokens marked in `wanted`, if it is given.
    """
    buckets = max(1, -(-int(crowds.value.sum()) // BUCKET))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks_of = np.minimum(-(-crowds.value // limit), 1 << 15)
        met = crowds.value > 1 if wanted is None else (crowds.value > 1) & wanted.value
        for batch in batches:
            o, spot, s2 = (batch.column(k).to_numpy() for k in range(3))
            sketches, lists = batch.column(3), batch.column(4)
            size = lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(o)), size)
            i = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            token = lists.flatten().to_numpy().view(np.uint32).astype(np.int64)
            keep = np.flatnonzero(met[token >> (32 - COUNT_BITS)])
            row, i, token = row[keep], i[keep], token[keep]
            blocks = blocks_of[token >> (32 - COUNT_BITS)]
            own = ((spot_hashes(o, spot) >> np.uint64(20)).astype(np.int64) & 0xFFFFFFF)[row] % blocks
            total, a = np.cumsum(blocks), 0
            while a < len(row):
                b = max(a + 1, int(np.searchsorted(total, total[a] - blocks[a] + COPIES, side="right")))
                copies = a + np.repeat(np.arange(b - a), blocks[a:b])
                other = np.arange(len(copies)) + total[a] - blocks[a] - (total - blocks)[copies]
                mine = own[copies]
                low, high = np.minimum(mine, other), np.maximum(mine, other)
                side = (mine == high) & (low != high)
                route = ((token[copies] - (1 << 31)) << 32) + (low << 16) + high
                shape = s2[row[copies]] >> 32 << 32 | i[copies] << 1 | side
                bucket = (mix(route.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, line = bucket[order], row[copies[order]]
                first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                ends = np.append(first, len(line))
                taken = sketches.take(pa.array(line))
                offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset :]
                columns = [binaries(ends * 8, x) for x in (route[order], o[line], spot[line], shape[order])]
                sketch = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets[ends].tobytes()), taken.buffers()[2]])
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *columns, sketch], ["bucket", "route", "o", "spot", "shape", "sketch"])
                a = b

    return firsts.select("o", "spot", "s2", "sketch", "prefix").mapInArrow(found, ENTRIES)


def _flat(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all values of a binary column, one after the other."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], kind, (ends[-1] - ends[0]) >> 3, ends[0])


class Meeting:
    """Entries of whole buckets, sorted by route and place, and the filters on pairs of them."""

    def __init__(self, batch: pa.RecordBatch, share: float):
        route, o, spot, shape = (_flat(batch.column(k), "<i8") for k in range(1, 5))
        order = np.lexsort((spot, o, route))
        self.route, self.o, self.spot, shape = route[order], o[order], spot[order], shape[order]
        self.share = share
        self.n, self.i, self.side = shape >> 32, (shape >> 1) & 0x7FFFFFFF, shape & 1
        self.crossed = (self.route & 0xFFFF) != ((self.route >> 16) & 0xFFFF)
        self.words = _flat(batch.column(5), "<u8")
        size = np.empty(len(order), np.int64)
        size[order] = self.size = sketch_words(self.n)
        at = np.cumsum(size) - size
        self.at = at[order]
        self.short = np.bitwise_xor.reduceat(self.words, at)[order]
        # Twice the bits that may differ, rounded up; a sum of two fits into a byte, and at most 128 are compared with it.
        self.most = np.minimum(np.ceil(2 * self.n * ((1 - share) / (1 + share)) + 1e-3), 127).astype(np.uint8)

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the short sketches of x and y leave a pair possible: far fewer than all pairs have to be looked at closer."""
        return np.bitwise_count(self.short[x] ^ self.short[y]) << np.uint8(1) <= self.most[x] + self.most[y]

    def may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether row x can be an earlier similar line of row y."""
        nx, ny, ix, iy, t = self.n[x], self.n[y], self.i[x], self.i[y], self.share
        earlier = (self.o[x] < self.o[y]) | (self.spot[x] >> 32 < self.spot[y] >> 32)  # in one route, x stands before y
        blocks = ~self.crossed[y] | (self.side[x] != self.side[y])
        both = nx + ny
        length = np.minimum(nx, ny) >= t * np.maximum(nx, ny) - 1e-9
        # At the first shared token of a pair nothing is shared before it, so what follows has to suffice.
        place = np.minimum(nx - ix, ny - iy) >= t / (1 + t) * both - 1e-9
        most = both * ((1 - t) / (1 + t)) + 1e-9
        ok = earlier & blocks & length & place & (np.bitwise_count(self.short[x] ^ self.short[y]) <= most)
        left = np.flatnonzero(ok & ((self.size[x] > 1) & (self.size[y] > 1)))
        sizes = self.size[x[left]] << 32 | self.size[y[left]]
        for pair in np.unique(sizes).tolist():
            mine = left[sizes == pair]
            size = min(pair >> 32, pair & 0xFFFFFFFF)
            for k in range(0, len(mine), max(1, (1 << 20) // (2 * size))):
                some = mine[k : k + max(1, (1 << 20) // (2 * size))]
                bits = np.bitwise_count(self._folded(x[some], pair >> 32, size) ^ self._folded(y[some], pair & 0xFFFFFFFF, size))
                ok[some] &= bits.sum(axis=1, dtype=np.int64) <= most[some]
        return ok

    def _folded(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        """Sketches of `size` words, as the sketches of `to` words that the same tokens have."""
        words = self.words[self.at[rows][:, None] + np.arange(size)]
        return np.bitwise_xor.reduce(words.reshape(len(rows), size // to, to), axis=1)

    def pairs(self, every: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, whether y has more): the earliest x of each y, or every x of the rows marked in `every`."""
        total = len(self.route)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.route)) + 1, [total]))
        size = np.diff(cuts)
        best, number = np.full(total, -1), np.zeros(total, np.int64)
        place = np.arange(total) - np.repeat(cuts[:-1], size)
        place[np.repeat(size > LAGS + 1, size)] = 0
        ys = np.flatnonzero(place if every is None else place * every)
        for lag in range(1, LAGS + 1):
            ys = ys[place[ys] >= lag]
            if not len(ys):
                break
            y = ys[self.near(ys - lag, ys)]
            y = y[self.may(y - lag, y)]
            if every is None:
                best[y] = y - lag
                number[y] += 1
            else:
                yield y - lag, y, np.zeros(len(y), bool)
        for a, b in zip(cuts[:-1][size > LAGS + 1].tolist(), cuts[1:][size > LAGS + 1].tolist()):
            left = np.arange(a + 1, b) if every is None else a + 1 + np.flatnonzero(every[a + 1 : b])
            step = 256
            for low in range(a, b, step):  # the earliest first; a line that has two needs no more
                left = left[left > low]
                if not len(left):
                    break
                x = np.arange(low, min(b, low + step))
                for z in range(0, len(left), 1024):
                    y = left[z : z + 1024]
                    close = self.near(x[None, :], y[:, None])
                    if y[0] <= x[-1]:
                        close &= x[None, :] < y[:, None]
                    of_y, of_x = np.divmod(np.flatnonzero(close), len(x))
                    xs, ys = x[of_x], y[of_y]
                    ok = self.may(xs, ys)
                    xs, ys = xs[ok], ys[ok]
                    if every is not None:
                        yield xs, ys, np.zeros(len(xs), bool)
                        continue
                    new, at, count = np.unique(ys, return_index=True, return_counts=True)
                    best[new] = np.where(best[new] < 0, xs[at], best[new])
                    number[new] += count
                if every is None:
                    left = left[number[left] < 2]
        if every is None:
            y = np.flatnonzero(best >= 0)
            yield best[y], y, number[y] > 1


def _pairs(entries: DataFrame, share: float, asked: Marks | None = None) -> DataFrame:
    """(o, spot, x_o, x_spot, more), once for each token: candidates of the later line (o, spot), all of them for the lines
    marked in `asked`."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 1):
            rows = Meeting(batch, share)
            every = None if asked is None else asked.of(rows.o, rows.spot)
            for x, y, more in rows.pairs(every):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(z) for z in (rows.o[y], rows.spot[y], rows.o[x], rows.spot[x], more)], ["o", "spot", "x_o", "x_spot", "more"])

    met = entries.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(found, "o bigint, spot bigint, x_o bigint, x_spot bigint, more boolean")


def _similar(docs: DataFrame, pairs: DataFrame, rank, share: float) -> DataFrame:
    """(o, spot) of the later lines with a candidate that is similar by the exact Jaccard similarity."""
    ids = pairs.select("o", "spot").union(pairs.select("x_o", "x_spot"))
    rows = 2 * pairs.count()
    asked, texts = Marks(ids, rows, spot_hashes), Marks(ids, rows, text_hashes)

    @F.arrow_udf("boolean")
    def has_some(o: pa.Array, body: pa.Array) -> pa.Array:
        return pa.array(texts.of(o.to_numpy(), body.to_numpy()))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            os, bodies = (batch.column(k).to_numpy() for k in range(2))
            for first, part in slices(batch.column(2)):
                mine: list[np.ndarray] = []

                def wanted(lines: Lines) -> np.ndarray:
                    o, spot = os[first + lines.text], _spots(lines.number, bodies[first + lines.text])
                    pick = asked.of(o, spot)
                    mine.extend((o, spot, pick))
                    return pick

                lines = Lines(part, rank.value, wanted)
                o, spot, pick = mine
                if not pick.any():
                    continue
                ends = np.append(lines.first[:-1][pick], lines.first[-1]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines.values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(o[pick]), pa.array(spot[pick]), tokens], ["o", "spot", "tokens"])

    having = docs.select("o", "body", "text").where(has_some("o", "body"))
    sets = cut(having.mapInArrow(found, "o bigint, spot bigint, tokens array<bigint>"), "sets")
    x = sets.select(F.col("o").alias("x_o"), F.col("spot").alias("x_spot"), F.col("tokens").alias("x_tokens"))
    both = pairs.select("o", "spot", "x_o", "x_spot").join(sets, ["o", "spot"]).join(x, ["x_o", "x_spot"])
    shared = F.size(F.array_intersect("tokens", "x_tokens"))
    return both.where(shared >= share * (F.size("tokens") + F.size("x_tokens") - shared) - 1e-9).select("o", "spot").distinct()


RESULT = "struct<n_lines:bigint,n_removed:bigint,kept:string>"


def remove_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.8, kept: str = "kept", limit: int = 50_000) -> DataFrame:
    """`df` with n_lines, n_removed and the remaining lines joined by line feeds."""
    source = {f"in{i}": c for i, c in enumerate(df.columns)}
    mine, key = (next(k for k, c in source.items() if c.lower() == name.lower()) for name in (text, doc_id))
    named = df.select(*[F.col(f"`{c}`").alias(k) for k, c in source.items()]).withColumnRenamed(mine, "text")
    docs = named.select("*", _order_of(F.col(key)).alias("o"), F.xxhash64("text").alias("body"))
    spark = df.sparkSession

    def word_hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, part in slices(batch.column(0)):
            yield Words(part).hashes

    counts = slots(docs.select("text"), COUNT_BITS, word_hashes)
    rank = np.empty(1 << COUNT_BITS, np.uint64)
    rank[np.argsort(counts, kind="stable")] = np.arange(1 << COUNT_BITS, dtype=np.uint64)
    rank = spark.sparkContext.broadcast(rank)

    # Of equal token sets the first line leads; a class has one row for each part of a batch at most.
    order = Window.partitionBy("s1", "s2").orderBy("o", "spot")
    led = _rows(docs, rank, share).withColumn("first", F.struct("o", F.shiftright("spot", 32).alias("number")))
    led = led.withColumn("later_than", F.first("first").over(order))
    # Two different lines of n and n + 1 tokens can only be similar if n / (n + 1) >= share.
    shortest = math.ceil(share / (1 - share) - 1e-9) if share < 1 else 1 << 31
    leads = (F.row_number().over(order) == 1) & (F.shiftright("s2", 32) >= shortest)
    led = led.select("o", "spot", "s2", F.when(leads, F.col("sketch")).alias("sketch"), F.when(leads, F.col("prefix")).alias("prefix"), "later", (F.col("first") > F.col("later_than")).alias("gone"), "later_than")
    led = cut(led, "lines")
    firsts = led.where("prefix is not null").select("o", "spot", "s2", "sketch", "prefix")
    crowds = spark.sparkContext.broadcast(slots(firsts.select("prefix"), COUNT_BITS, _prefix_hashes))
    entries = _entries(firsts, crowds, limit)
    line = ["o", "spot"]
    met = _pairs(entries, share).groupBy(*line, "x_o", "x_spot").agg(F.max("more").alias("more"))
    pairs = cut(met, "pairs")
    flagged = cut(_similar(docs, pairs, rank, share), "similar")
    open_ = cut(pairs.where("more").select(*line).distinct().join(flagged, line, "left_anti"), "open")
    if open_.limit(1).count():
        again = Marks(open_, open_.count(), spot_hashes)
        tokens = slots(firsts.join(open_, line, "left_semi").select("prefix"), COUNT_BITS, _prefix_hashes)
        entries = _entries(firsts, crowds, limit, spark.sparkContext.broadcast(tokens > 0))
        rest = _pairs(entries, share, again).select(*line, "x_o", "x_spot").distinct()
        rest = rest.join(open_, line, "left_semi").join(pairs, [*line, "x_o", "x_spot"], "left_anti")
        flagged = flagged.union(cut(_similar(docs, cut(rest, "rest"), rank, share), "similar"))

    # A line that follows in its part is later than its class's first one, unless both have one place (repeated rows).
    follows = led.select(F.inline("later"), "later_than").where(F.struct("o", F.shiftright("spot", 32).alias("number")) > F.col("later_than"))
    lost = cut(led.where("gone").select(*line).union(follows.select(*line)).union(flagged), "lost")
    touched = Marks(lost, lost.count(), text_hashes)
    # Texts of one o (all rows with a null id) are told apart, so that a group is the lines of one text.
    half = F.lit(0xFFFFFFFF)
    gone = lost.groupBy(F.col("o").alias("gone_o"), F.col("spot").bitwiseAND(half).alias("gone_body")).agg(F.collect_set("spot").alias("spots"))

    @F.arrow_udf("boolean")
    def loses(o: pa.Array, body: pa.Array) -> pa.Array:
        return pa.array(touched.of(o.to_numpy(), body.to_numpy()))

    @F.arrow_udf(RESULT)
    def dropped(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spots in batches:
            total, removed, left = [], [], []
            for t, found in zip(texts, spots):
                t = t.as_py()
                lines = t.split("\n") if t else []
                n = len(lines)
                if found.is_valid and n:
                    numbers = {s >> 32 for s in found.values.to_pylist()}
                    lines = [x for k, x in enumerate(lines) if k not in numbers]
                    t = "\n".join(lines)
                total.append(n)
                removed.append(n - len(lines))
                left.append(t)
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], ["n_lines", "n_removed", "kept"])

    asked = docs.withColumn("loses", loses("o", "body"))
    own_lines = (F.col("o") == F.col("gone_o")) & (F.col("body").bitwiseAND(half) == F.col("gone_body"))
    cutting = asked.where("loses").join(gone, own_lines, "left").withColumn("result", dropped("text", "spots"))
    count = F.when(F.col("text") != "", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    whole = asked.where(~F.col("loses")).withColumn("result", F.struct(count.cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_removed"), F.col("text").alias("kept")))
    new = {"n_lines", "n_removed", kept.lower()}
    own = [F.col("text" if k == mine else k).alias(c) for k, c in source.items() if c.lower() not in new]
    results = [F.col("result.n_lines").alias("n_lines"), F.col("result.n_removed").alias("n_removed"), F.col("result.kept").alias(kept)]
    return cutting.select(*own, *results).union(whole.select(*own, *results))

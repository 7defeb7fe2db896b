"""Alignment of two tokenizers over the same texts: overlapping tokens, equal ends, and how often ids meet.

1. A batch of texts is encoded by both vocabularies, A as byte-level BPE of a blank and the text, B by sentencepiece, which
   adds the blank. Texts whose tokens do not spell the blank and the text, byte for byte, have no tokens.
2. `pandas.merge_asof`, keyed by document, finds the token of B that covers the start of each token of A, and the other way
   round; the union of both is every overlap, since of two overlapping tokens one starts within the other. Ends that both
   share cut the tokens into groups.
3. Overlaps are written as distinct id pairs with their number for each document, and added up over the corpus, first in
   each task. Each pair gets its count and whether it is the highest of its B id.
4. Every document adds up its pairs' counts. The counts come as broadcasts of at most `SHARD` pairs each; a larger table
   is cut by ranges of pairs, and each range meets every document in its own pass over the narrow rows.

Null and empty texts have no tokens, no groups and zeros. Repeated rows are aligned, and counted, each. Very long texts are
encoded in stretches that no token crosses; their tokens are merged at once, so a worker's memory grows with the longest
text. An empty table gives an empty one. Only the columns in `keep` pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import CUT_BLANKS, Bytes, stretches
from .common import cut, free_name, numbered
from .kernel import slices
from .tokens import encoder, token_bytes

#: Pairs of one broadcast (some 20 MB), and pairs that a task holds before it hands on its sums.
SHARD, HELD = 1 << 20, 1 << 20
BLANK = "▁"


class Pieces:
    """Ids and bytes of a sentencepiece vocabulary."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        #: Without a piece that holds a blank after another character, no token reaches over a blank's start.
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[str] = []
        counts = []
        for t in texts:
            # Each stretch begins with the blank that the library would add.
            own = [s[1:] for s in stretches(" " + t, CUT_BLANKS)] if self.cuts else [t]
            parts += own
            counts.append(len(own))
        ids, out = self.library.encode(parts, num_threads=1), []
        for n in counts:
            out.append(np.array([i for p in ids[:n] for i in p] if n > 1 else ids[0], np.uint32))
            del ids[:n]
        return out


def vocabulary_size(path: str) -> int:
    """Pieces of a sentencepiece file."""
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


class Aligned(NamedTuple):
    """Numbers of one batch, for each document, and the pairs of ids that overlap, as `a * size_b + b`, by document."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    pair_doc: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, model_a: str, model_b: bytes):
        self.encode_a, tokens_a = encoder(model_a), token_bytes(model_a)
        self.b = Pieces(model_b)
        self.bytes_a, self.bytes_b = Bytes(tokens_a), Bytes(self.b.tokens)
        self.size_b = len(self.b.tokens)
        self.inner_a, self.last_a = (np.array([f"{i}{end}" for i in range(len(tokens_a))], object) for end in (",", "|"))
        self.inner_b, self.last_b = (np.array([f"{i}{end}" for i in range(self.size_b)], object) for end in (",", ";"))

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by A and by B of each text; none where the bytes of either differ from the blank and the text."""
        none = np.zeros(0, np.uint32)
        all_a, all_b = self.encode_a([" " + t for t in texts]), self.b.encode(texts)
        for k, text in enumerate(texts):
            spelled = np.frombuffer(f" {text}".encode(), np.uint8)
            if not text or not all(np.array_equal(t.of(ids), spelled) for t, ids in ((self.bytes_a, all_a[k]), (self.bytes_b, all_b[k]))):
                all_a[k] = all_b[k] = none
        return all_a, all_b

    def align(self, texts: list[str]) -> Aligned:
        all_a, all_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (all_a, all_b))
        a, b = (np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64) for ids in (all_a, all_b))
        doc_a, doc_b = np.repeat(np.arange(len(texts)), n_a), np.repeat(np.arange(len(texts)), n_b)
        end_a, end_b = np.cumsum(self.bytes_a.lengths[a], dtype=np.int64), np.cumsum(self.bytes_b.lengths[b], dtype=np.int64)
        start_a, start_b = end_a - self.bytes_a.lengths[a], end_b - self.bytes_b.lengths[b]
        left = pd.DataFrame({"at": start_a, "doc": doc_a, "a": np.arange(len(a))})
        right = pd.DataFrame({"at": start_b, "doc": doc_b, "b": np.arange(len(b))})
        # Documents lie behind each other, so starts ascend over the whole batch.
        if len(a):
            cover_b = pd.merge_asof(left, right, on="at", by="doc")["b"].to_numpy().astype(np.int64)
            cover_a = pd.merge_asof(right, left, on="at", by="doc")["a"].to_numpy().astype(np.int64)
        else:
            cover_b = cover_a = np.zeros(0, np.int64)
        new = start_a[cover_a] != start_b  # equal starts are found from both sides
        link_a, link_b = np.concatenate((np.arange(len(a)), cover_a[new])), np.concatenate((cover_b, np.flatnonzero(new)))
        link_doc = doc_a[link_a]
        width = len(self.bytes_a.lengths) * self.size_b
        keys, times = np.unique(link_doc * width + a[link_a] * self.size_b + b[link_b], return_counts=True)
        last_a, last_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        count = lambda docs, flags=None: np.bincount(docs, flags, len(texts)).astype(np.int64)
        return Aligned(
            n_a, n_b, count(doc_a, last_a), count(link_doc), self._groups(a, b, n_a + n_b, last_a, last_b), keys // width, keys % width, times
        )

    def _groups(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each document."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a = np.searchsorted(group_a, np.arange(last_a.sum()), side="right")  # tokens of A up to the end of each group
        before_b = np.searchsorted(group_b, np.arange(last_b.sum()), side="left")
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + before_b[group_a]] = np.where(last_a, self.last_a[a], self.inner_a[a])
        out[np.arange(len(b)) + before_a[group_b]] = np.where(last_b, self.last_b[b], self.inner_b[b])
        ends = np.cumsum(sizes)
        return ["".join(out[end - n : end].tolist())[:-1] for end, n in zip(ends, sizes)]


def align(df: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns `keep` and n_a, n_b, n_groups, n_links, groups (text), pairs and times of each document.

    `pairs` holds the distinct pairs of linked ids as ascending 64-bit numbers, `times` how often each is linked (32-bit).
    """
    with open(path_a, encoding="utf-8") as file_a, open(path_b, "rb") as file_b:
        shared = df.sparkSession.sparkContext.broadcast((file_a.read(), file_b.read()))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            for i, texts in slices(batch.column(0), 1 << 20):
                found = aligner.align(texts.to_pylist())
                edges = np.searchsorted(found.pair_doc, np.arange(len(texts) + 1))
                pairs, times = found.pair.astype("<i8"), found.times.astype("<u4")
                numbers = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                cuts = list(zip(edges[:-1], edges[1:]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, len(texts)).columns[1:], *numbers, pa.array(found.groups, pa.string()),
                     pa.array([pairs[x:y].tobytes() for x, y in cuts], pa.binary()), pa.array([times[x:y].tobytes() for x, y in cuts], pa.binary())],
                    [*keep, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"],
                )

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    return df.select(F.col(text), *keep).mapInArrow(built, f"{kinds}n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary")


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): the links of each pair of ids over all documents, and whether no pair of that B id has more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def row_batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

        for batch in batches:
            given, many = _joined(batch.column(0), "<i8"), _joined(batch.column(1), "<u4")
            pairs, place = np.unique(np.concatenate((pairs, given)), return_inverse=True)
            times = np.bincount(place, np.concatenate((times, many)), len(pairs)).astype(np.int64)  # exact below 2**53
            if len(pairs) > HELD:
                yield row_batch()
                pairs, times = pairs[:0], times[:0]
        yield row_batch()

    counts = cut(aligned.select("pairs", "times").mapInArrow(summed, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.pmod("pair", F.lit(size_b)).alias("b")
    highest = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.select("pair", "n", b).join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, size_b: int, shard: int | None = None) -> DataFrame:
    """`aligned` without pairs and times, with n_best (links of a best pair) and count_sum (counts added up over links)."""
    spark, row = aligned.sparkSession, free_name(aligned, "row")
    written = cut(aligned.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = cut(pair_counts(written, size_b), "counts")
    shard = shard or SHARD
    total = counts.count()
    # Ranges of pairs with at most `shard` each, from the order of the pairs: one range in all but huge vocabularies.
    edges = [None, *_edges(counts, total, shard), None]

    def part(low: int | None, high: int | None):
        here = counts
        here = here if low is None else here.where(F.col("pair") >= low)
        here = here if high is None else here.where(F.col("pair") < high)
        found = here.toArrow().combine_chunks()
        order = np.argsort(found["pair"].to_numpy())
        shared = spark.sparkContext.broadcast(tuple(found[c].to_numpy()[order] for c in ("pair", "n", "best")))

        @F.arrow_udf("struct<n_best:bigint,count_sum:bigint>")
        def sums(pairs: pa.Array, times: pa.Array) -> pa.Array:
            known, n, best = shared.value
            sizes = np.array([len(p) // 8 for p in pairs.to_pylist()], np.int64)
            given, many = _joined(pairs, "<i8"), _joined(times, "<u4")
            if not len(known):
                zero = pa.array(np.zeros(len(sizes), np.int64))
                return pa.StructArray.from_arrays([zero, zero], ["n_best", "count_sum"])
            k = np.minimum(np.searchsorted(known, given), len(known) - 1)
            many = np.where(known[k] == given, many, 0)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            add = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
            return pa.StructArray.from_arrays([pa.array(add(many * best[k])), pa.array(add(many * n[k]))], ["n_best", "count_sum"])

        return sums("pairs", "times")

    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    if len(edges) == 2:
        both = free_name(aligned, "both")
        out = written.withColumn(both, part(None, None))
        return out.select(*names, F.col(both)["n_best"].alias("n_best"), F.col(both)["count_sum"].alias("count_sum"))
    passes = [cut(written.select(row, part(low, high).alias("both")), "shard") for low, high in zip(edges[:-1], edges[1:])]
    whole = passes[0]
    for other in passes[1:]:
        whole = whole.union(other)
    whole = whole.groupBy(row).agg(F.sum("both.n_best").alias("n_best"), F.sum("both.count_sum").alias("count_sum"))
    return written.select(row, *names).join(whole, row).drop(row)


def _edges(counts: DataFrame, total: int, shard: int) -> list[int]:
    """First pairs of all ranges but the first: every `shard`-th pair in order."""
    if total <= shard:
        return []
    picked = numbered(counts.select("pair"), ["pair"], "number").where(F.col("number") % shard == 0)
    return sorted(r["pair"] for r in picked.collect())[1:]

"""Substring dedup by repeated anchor phrases, located by a hash join.

A window is `size` consecutive words (words end at ASCII white space) of one text. Every word is removed that a window covers
whose words also start anywhere else, in the same text or another. Windows are judged on the input.

1. Each window has an anchor: of its phrases of PHRASE words the one with the least hash, the leftmost of equals. Equal
   windows have equal anchors at the same place, so a window can only be repeated if its anchor phrase is.
2. Phrases that are anchors at two places or more are the recurring ones. They go back to the texts that hold them.
3. Texts arrive in batches, each with its recurring phrases from the hash join of step 2, and only texts that have some.
   In each part of a batch these are looked up by hash among the anchors, which locates every occurrence. An Aho-Corasick
   automaton over words is then compiled from the places found and streams the same texts; but for collisions of its 32-bit
   word codes it names the same places again, so it locates nothing that the join has not.
4. The windows around the occurrences of an anchor are compared where all of them meet; windows that start at two places
   are confirmed by a hash of 64 bits besides the 64 of the anchor. Windows of equal surroundings are counted before they
   are sent, so a passage that a third of all texts share is sent once from each batch.
5. The confirmed window starts go back to the texts, and the covered words are dropped.

The texts are shuffled once, by a hash, for steps 3 and 5 together. Null and empty texts have no words, nothing is removed
from them and `kept` is empty. Rows with equal texts are different places, so all their windows are repeats. Columns of the
same name as a result are replaced, others pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .kernel import Words, run_hashes, slices, sliding_min, whole_runs

PHRASE = 8
HIGH = np.uint64(0xFFFFFFFF00000000)


class Windows:
    """Windows of some texts: number of the first word, place of the anchor, and all phrases' hashes."""

    def __init__(self, texts: pa.Array, size: int):
        phrase = min(PHRASE, size)
        self.size, self.phrase, self.words = size, phrase, Words(texts)
        self.of = self.words.text_of_word()
        self.phrases = run_hashes(self.words.hashes, phrase)
        # Half of the hash, then the place: the least is the leftmost of the least, in every text alike.
        at = (self.phrases & HIGH) | np.arange(len(self.phrases), dtype=np.uint64)
        least = sliding_min(at, size - phrase + 1)
        start = np.flatnonzero(self.of[: len(least)] == self.of[size - 1 :][: len(least)]) if len(least) else np.zeros(0, int)
        self.start, self.anchor = start, (least[start] & ~HIGH).astype(np.int64)


def _once(batch: pa.RecordBatch, key: int, text: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(rows, keys, number of rows, texts) of the distinct keys of a batch."""
    keys, rows, n = np.unique(batch.column(key).to_numpy(), return_index=True, return_counts=True)
    return rows, keys, n, batch.column(text).take(pa.array(rows))


def _phrases(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, key, n) of each text; n is 2 where the anchor stands at two places or more."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, keys, n, texts = _once(batch, 0, 1)
            for first, part in slices(texts):
                w = Windows(part, size)
                place = np.unique(w.anchor)
                of, phrase = w.of[place] + first, w.phrases[place]
                order = np.lexsort((phrase, of))
                of, phrase = of[order], phrase[order]
                new = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (phrase[1:] != phrase[:-1])))[: len(of)])
                count = np.diff(np.append(new, len(of))) * n[of[new]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(phrase[new].view(np.int64)), pa.array(keys[of[new]]), pa.array(np.minimum(count, 2).astype(np.int32))], ["anchor", "key", "n"]
                )

    return docs.select("key", "text").mapInArrow(found, "anchor bigint, key bigint, n int")


def _locate(recurring: np.ndarray, w: Windows) -> np.ndarray:
    """Whether a recurring phrase stands at each word: anchors are looked up by hash, an automaton over the words repeats it."""
    there = np.zeros(len(w.words.hashes) + 1, bool)
    place = np.unique(w.anchor)
    mine = np.sort(recurring)
    at = np.minimum(np.searchsorted(mine, w.phrases[place]), max(0, len(mine) - 1))
    known = place[mine[at] == w.phrases[place]] if len(mine) else place[:0]
    if not len(known):
        return there[:-1]
    _, one = np.unique(w.phrases[known], return_index=True)
    codes = (w.words.hashes >> np.uint64(32)).tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in known[one].tolist():
        automaton.add_word(tuple(codes[p : p + w.phrase]), 1)
    automaton.make_automaton()
    first = w.words.first.tolist()
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= w.size:
            for end, _ in automaton.iter(tuple(codes[a:b])):
                there[a + end] = True
    return np.concatenate((there[w.phrase - 1 : -1], np.zeros(w.phrase - 1, bool)))


def _occurrences(docs: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Rows about the windows of each occurrence of a recurring phrase: (route, key, check, start, n, windows).

    A row with windows asks whether they are repeated (n: how often it has been seen, key null if its own windows need no
    answer); a row without tells that its n windows from `start` on are.
    """
    key, check, text, near = (columns.index(c) for c in ("key", "check", "text", "near"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, copies, texts = _once(batch, key, text)
            checks = batch.column(check).to_numpy()[rows]
            lists = batch.column(near).take(pa.array(rows))
            for first, part in slices(texts):
                w = Windows(part, size)
                there = _locate(lists.slice(first, len(part)).flatten().to_numpy().view(np.uint64), w)
                hit = np.flatnonzero(there[w.anchor]) if len(w.anchor) else np.zeros(0, int)
                if not len(hit):
                    continue
                start, anchor = w.start[hit], w.anchor[hit]
                hashes = run_hashes(w.words.hashes, size)[start]
                new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1))))
                ends = np.append(new[1:], len(hit))
                of = w.of[start[new]] + first
                whole = np.stack([w.phrases[anchor[new]], hashes[new], hashes[ends - 1], (ends - new).astype(np.uint64)], 1)
                _, group = np.unique(whole, axis=0, return_inverse=True)
                group = group.ravel()
                seen = np.bincount(group, copies[of])
                _, one = np.unique(group, return_index=True)
                asks = np.zeros(len(new), bool)
                asks[one] = True
                told = seen[group] >= 2
                row = np.flatnonzero(asks | told)
                begin = start[new] - w.words.first[w.of[start[new]]]
                phrase = w.phrases[anchor[new]].view(np.int64)
                # Told rows first, then those that ask.
                tell, ask = row[told[row]], row[asks[row]]
                offsets = np.concatenate(([0], np.cumsum(ends[ask] - new[ask])))
                each = np.repeat(new[ask] - offsets[:-1], ends[ask] - new[ask]) + np.arange(offsets[-1])
                windows = pa.ListArray.from_arrays(
                    pa.array(np.concatenate((np.zeros(len(tell), np.int64), offsets)).astype(np.int32), mask=np.concatenate((np.ones(len(tell), bool), np.zeros(len(ask) + 1, bool)))),
                    pa.array(hashes[each].view(np.int64)),
                )
                both = np.concatenate((tell, ask))
                silent = np.concatenate((np.zeros(len(tell), bool), told[ask]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((keys[of[tell]], phrase[ask]))),
                        pa.array(keys[of[both]], mask=silent),
                        pa.array(checks[of[both]]),
                        pa.array(begin[both]),
                        pa.array(np.concatenate((ends[tell] - new[tell], np.minimum(seen[group[ask]], 2))).astype(np.int64)),
                        windows,
                    ],
                    ["route", "key", "check", "start", "n", "windows"],
                )

    return docs.select(*columns).mapInArrow(found, "route bigint, key bigint, check bigint, start bigint, n bigint, windows array<bigint>")


def _confirmed(asked: DataFrame) -> DataFrame:
    """(key, check, start, n, mask): bit b of the mask stands for the window at start + b; null: all n windows."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(judged, whole_runs(batches, 1))

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, lists = rows.column(4).to_numpy(), rows.column(5)
        count = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(), 0)
        row = np.repeat(np.arange(len(rows)), count)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        window = np.stack([rows.column(0).to_numpy()[row], lists.flatten().to_numpy()], 1)
        # One window of an anchor at a time: sorted pairs, the sum of their sightings.
        order = np.lexsort((window[:, 1], window[:, 0]))
        ordered = window[order]
        new = np.flatnonzero(np.concatenate(([True], (ordered[1:] != ordered[:-1]).any(1)))[: len(ordered)])
        sums = np.add.reduceat(n[row][order], new) if len(new) else np.zeros(0, int)
        twice = np.zeros(len(row), bool)
        twice[order] = np.repeat(sums >= 2, np.diff(np.append(new, len(ordered))))
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, row, np.where(twice, np.int64(1) << np.minimum(bit, 62), 0))
        full = count == 0
        kept = np.flatnonzero((full | (mask != 0)) & rows.column(1).is_valid().to_numpy(zero_copy_only=False))
        at = pa.array(kept)
        return pa.RecordBatch.from_arrays(
            [rows.column(1).take(at), rows.column(2).take(at), rows.column(3).take(at), rows.column(4).take(at), pa.array(mask[kept], mask=full[kept])], ["key", "check", "start", "n", "mask"]
        )

    sent = asked.repartition("route").sortWithinPartitions("route")
    return sent.mapInArrow(found, "key bigint, check bigint, start bigint, n bigint, mask bigint")


def drop_words(words: list[bytes], spans: list[tuple[int, int, int | None]], size: int) -> tuple[int, list[bytes]]:
    """Number of removed words and the kept ones; spans: first window start, number of windows, mask."""
    edge = np.zeros(len(words) + 1, np.int32)
    for start, n, mask in spans:
        for b in range(n) if mask is None else (b for b in range(63) if mask >> b & 1):
            edge[start + b] += 1
            edge[start + b + size] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return len(words) - int(kept.sum()), list(compress(words, kept.tolist()))


RESULT = "struct<n_words:bigint,n_removed:bigint,kept:string>"


def remove_repeats(df: DataFrame, text: str = "text", size: int = 35, kept: str = "kept") -> DataFrame:
    """`df` with n_words, n_removed and the kept words joined by one blank."""
    if not 1 <= size <= 62 + min(PHRASE, size):
        raise ValueError("a window has 1 to 70 words")
    new = {"n_words", "n_removed", kept.lower()}
    # Names of its own for the input columns, so that none of them clashes with those used here.
    source = {f"in{i}": c for i, c in enumerate(df.columns)}
    mine = next(k for k, c in source.items() if c.lower() == text.lower())
    base = df.select(*[F.col(f"`{c}`").alias(k) for k, c in source.items()]).select(
        "*", F.xxhash64(F.coalesce(mine, F.lit(""))).alias("key"), F.xxhash64(F.lit(1), F.coalesce(mine, F.lit(""))).alias("check")
    )
    named = base.withColumnRenamed(mine, "text")
    phrases = cut(_phrases(named, size), "phrases")
    recurring = phrases.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    near = phrases.join(recurring, "anchor", "left_semi").groupBy(F.col("key").alias("near_key")).agg(F.collect_set("anchor").alias("near"))
    held = named.join(near, F.col("key") == F.col("near_key")).drop("near_key")
    marks = _confirmed(_occurrences(held, held.columns, size))
    lists = marks.groupBy(F.col("key").alias("mark_key")).agg(F.collect_set(F.struct("check", "start", "n", "mask")).alias("marks"))
    marked = named.join(lists, F.col("key") == F.col("mark_key"), "left")

    @F.arrow_udf(RESULT)
    def dropped(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, checks, lists in batches:
            total, removed, left = [], [], []
            for t, check, spans in zip(texts, checks.to_pylist(), lists):
                words = t.as_py().encode().split() if t.is_valid else []
                gone, stay = 0, words
                if spans.is_valid:
                    own = [(s["start"], s["n"], s["mask"]) for s in spans.as_py() if s["check"] == check]
                    gone, stay = drop_words(words, own, size)
                total.append(len(words))
                removed.append(gone)
                left.append(b" ".join(stay))
            yield pa.StructArray.from_arrays([pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    done = marked.withColumn("result", dropped("text", "check", "marks"))
    own = [F.col("text" if k == mine else k).alias(c) for k, c in source.items() if c.lower() not in new]
    return done.select(*own, F.col("result.n_words").alias("n_words"), F.col("result.n_removed").alias("n_removed"), F.col("result.kept").alias(kept))

"""Benchmark decontamination: size-partitioned MinHash containment search.

Shingles are `size` consecutive words (A-Z folded, words end at ASCII white space) as a set; an item of fewer words is one
shingle, a text without words has none. A document contains an item if it holds at least `share` of the item's shingles; so
an item of two to `size` - 1 words is looked for among the document's runs of as many words, anywhere in it. A single word
says nothing inside a longer text, so an item of one word is only contained in documents that are that word.

Items are partitioned by size: partition k holds the items of 2**k to 2**(k+1) - 1 shingles. An item's sketch is its
least MinHash values, as many as the largest size of its partition allows a containing document to miss, plus one; so any
containing document, however long, holds at least one of them and no candidate is lost. Each document's shingles are
looked up in the sketches, and candidates are verified by comparing the shingles' bytes.

The items' sketches and shingles are broadcast while they are at most `broadcast_bytes` of text; a larger benchmark is
searched in parts of that size, one after the other, so memory is bounded either way.

Null and empty texts contain nothing and empty items are in nothing. Repeated rows and ties each get their own pairs.
Empty tables give no pairs. Extra columns of either table are not read; ids are returned under the given names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from .common import free_name
from .kernel import BYTE_FOLDED, SPACE, Words, run_hashes, slices

FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingles(text: bytes, size: int) -> set[bytes]:
    words = text.translate(FOLD).split()
    if len(words) <= size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def runs(words: list[bytes], length: int) -> set[bytes]:
    """The runs of `length` words; of one word only if it is all."""
    if length == 1:
        return set(words) if len(words) == 1 else set()
    return set(map(b" ".join, zip(*(words[k:] for k in range(length)))))


def shingle_hashes(texts: pa.Array, size: int, shorter: Iterable[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles, repeats included; a shorter text is one shingle, and all its runs of the `shorter`
    lengths (two words or more) are besides."""
    words = Words(texts, SPACE, BYTE_FOLDED)
    n, of = np.diff(words.first), words.text_of_word()
    runs = run_hashes(words.hashes, size)
    at = np.flatnonzero(of[: len(runs)] == of[size - 1 :]) if len(runs) else np.zeros(0, int)
    hashes, owner = [runs[at]], [of[at]]
    for length in range(1, size):
        short = np.flatnonzero(n == length)
        if len(short):
            hashes.append(run_hashes(words.hashes, length)[words.first[short]])
            owner.append(short)
    for length in shorter:
        runs_ = run_hashes(words.hashes, length)
        at = np.flatnonzero((of[: len(runs_)] == of[length - 1 :]) & (n[of[: len(runs_)]] > length)) if len(runs_) else np.zeros(0, int)
        hashes.append(runs_[at])
        owner.append(of[at])
    return np.concatenate(hashes), np.concatenate(owner)


@dataclass
class Sketches:
    """Sorted sketch values, the item of each, and all items' ids and shingles."""

    values: np.ndarray
    item: np.ndarray
    ids: list
    sets: list[set[bytes]]
    lengths: list[int]  # words of an item's shingles

    @classmethod
    def of(cls, ids: list, texts: list[bytes], size: int, share: float) -> "Sketches":
        hashes, owner = shingle_hashes(pa.array(texts, pa.binary()).cast(pa.string()), size)
        values, items = [], []
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = np.unique(hashes[cuts[k] : cuts[k + 1]])
            largest = (1 << len(own).bit_length()) - 1 if len(own) else 0
            least = own[: largest - int(np.ceil(share * largest - 1e-9)) + 1]
            values.append(least)
            items.append(np.full(len(least), k))
        values, items = np.concatenate(values or [np.zeros(0, np.uint64)]), np.concatenate(items or [np.zeros(0, int)])
        order = np.argsort(values, kind="stable")
        return cls(values[order], items[order], ids, [shingles(t, size) for t in texts], [min(size, len(t.split())) for t in texts])

    def shorter(self, size: int) -> list[int]:
        return sorted({n for n in self.lengths if 1 < n < size})

    def table(self) -> np.ndarray:
        """Whether any value begins with these 16 bits: a fast first test."""
        out = np.zeros(1 << 16, bool)
        out[self.values >> np.uint64(48)] = True
        return out

    def candidates(self, hashes: np.ndarray, owner: np.ndarray, may: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs that share a sketch value."""
        some = may[hashes >> np.uint64(48)]
        hashes, owner = hashes[some], owner[some]
        low, high = np.searchsorted(self.values, hashes), np.searchsorted(self.values, hashes, side="right")
        n = high - low
        at = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.unique(np.stack([np.repeat(owner, n), self.item[at]], 1), axis=0) if len(at) else np.zeros((0, 2), int)


def _search(docs: DataFrame, items: Sketches, doc_type: str, item_type: DataType, size: int, share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        may, shorter = known.table(), known.shorter(size)
        item_ids = pa.array(known.ids, to_arrow_type(item_type))
        for batch in batches:
            texts, docs_at, items_at, hits = batch.column(1), [], [], []
            for first, part in slices(texts):
                last, words, held = -1, [], {}
                for t, k in known.candidates(*shingle_hashes(part, size, shorter), may).tolist():
                    if t != last:
                        last, words, held = t, part[t].as_py().encode().translate(FOLD).split(), {}
                    length = known.lengths[k]
                    if length not in held:
                        held[length] = runs(words, length)
                    need = known.sets[k]
                    both = len(need & held[length])
                    if both >= share * len(need) - 1e-9:
                        docs_at.append(first + t)
                        items_at.append(k)
                        hits.append(both)
            if docs_at:
                of = pa.array(items_at)
                need = np.array([len(known.sets[k]) for k in items_at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(docs_at)), item_ids.take(of), pa.array(hits, pa.int64()), pa.array(need, pa.int64())], ["doc", "item", "n_shared", "n_shingles"]
                )

    return docs.mapInArrow(searched, f"doc {doc_type}, item {item_type.simpleString()}, n_shared bigint, n_shingles bigint")


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", item_text: str = "text",
              size: int = 5, share: float = 0.8, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for each document and item it contains."""
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text is not null")
    kept = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    doc_type, item_type = texts.schema[0].dataType.simpleString(), kept.schema[0].dataType
    found, ids, bodies, held = None, [], [], 0

    def search() -> DataFrame:
        part = _search(texts, Sketches.of(ids, bodies, size, share), doc_type, item_type, size, share)
        return part if found is None else found.union(part)

    for row in kept.toLocalIterator():  # one partition of the benchmark at a time
        body = row["text"].encode()
        if held and held + len(body) > broadcast_bytes:
            found, ids, bodies, held = search(), [], [], 0
        ids.append(row["item"])
        bodies.append(body)
        held += len(body)
    if ids or found is None:
        found = search()
    return found.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id if item_id != doc_id else free_name(texts, item_id + "_item")), "n_shared", "n_shingles")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 5, share: float = 0.8) -> DataFrame:
    """The rows of `docs` that contain no item; all columns pass through."""
    body = F.md5(F.col(text).cast("binary"))
    found = contained(docs.select(body.alias("body"), F.col(text).alias("text")), items, "body", item_id, "text", item_text, size, share)
    gone = free_name(docs, "gone")
    return docs.join(found.select(F.col("body").alias(gone)).distinct(), body == F.col(gone), "left_anti")

"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees.

A-Z are lower-cased; words end at ASCII white space; a shingle is `size` words joined by one space, repeats included (a
shorter text is one shingle). A bit of the fingerprint is set if it is set in more than half of the shingles' XXH64
values (seed 42). A text without words, and a null one, has fingerprint 0 and is linked like any other.

Two fingerprints within `radius` bits agree in at least `blocks - radius` of `blocks` blocks of bits. For every choice of
that many blocks the fingerprints with equal blocks form a shard, so no pair is missed. Each shard's BK-tree (children
keyed by their Hamming distance to the parent) is grown member by member; a search follows only edges within the radius.
A shard above `limit` members is dealt to several trees, and its members search the trees after their own. Trees are built
where their shard is, not broadcast: all shards together are as large as the corpus. Links leave a task as a spanning
forest, so large groups of near copies cost no quadratic output.

Groups are the connected components. Repeated rows and equal texts share a fingerprint; null ids never stand for a group
unless all of its ids are null. An empty table gives an empty one. Other columns pass through, replaced where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, with_new
from .components import connected

SEED = 42


def fingerprint(text: str, size: int) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - size + 1
    for i in range(0, n, 1 << 16):
        runs = zip(*(words[i + k : min(n, i + (1 << 16)) + k] for k in range(size)))
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, runs)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", size: int = 4, out: str = "fp") -> DataFrame:
    """`df` with the fingerprint as a signed 64-bit number."""

    @F.arrow_udf("bigint")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint(t.as_py(), size) if t.is_valid else 0 for t in texts]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return with_new(df, {out: prints(F.col(text))})


class BkTree:
    """Nodes as [number, children by distance]."""

    def __init__(self):
        self.root = None

    def add(self, number: int) -> None:
        if self.root is None:
            self.root = (number, {})
            return
        node = self.root
        while True:
            distance = (number ^ node[0]).bit_count()
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (number, {})
                return
            node = child

    def near(self, number: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            other, children = todo.pop()
            distance = (number ^ other).bit_count()
            if distance <= radius:
                found.append(other)
            if children:
                low, high = distance - radius, distance + radius
                todo += [c for d, c in children.items() if low <= d <= high]
        return found


class Shard:
    """A tree that grows, and the links found so far that joined two parts."""

    def __init__(self, radius: int):
        self.radius, self.tree, self.parent = radius, BkTree(), {}

    def _top(self, x: int) -> int:
        parent = self.parent
        while (up := parent[x]) != x:
            parent[x] = x = parent[up]
        return x

    def ask(self, x: int) -> list[tuple[int, int]]:
        """One link of `x` to each part of the tree that it is near to; these parts then are one."""
        parts = {self._top(y): y for y in self.tree.near(x, self.radius)}
        first = next(iter(parts), None)
        for part in parts:
            self.parent[part] = first
        return [(x, y) for y in parts.values()]

    def add(self, x: int) -> list[tuple[int, int]]:
        links = self.ask(x)
        self.tree.add(x)
        self.parent[x] = self._top(links[0][1]) if links else x
        return links


def near_links(prints: DataFrame, fp: str, radius: int, blocks: int = 6, limit: int = 4096) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of `prints` within `radius` bits; `fp` has no repeats."""
    width = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    masks = [((1 << w) - 1) << sum(width[:k]) for k, w in enumerate(width)]
    keys = [
        F.xxhash64(F.lit(i), F.col(fp).bitwiseAND(F.lit(np.uint64(sum(masks[k] for k in chosen)).astype(np.int64).item())))
        for i, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ]
    rows = prints.select(F.col(fp).alias("fp"), F.explode(F.array(*keys)).alias("shard"))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("m"))
    trees = F.ceil(F.col("m") / limit).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    shared = rows.join(sizes.where("m > 1"), "shard").select("shard", "fp", trees.alias("trees")).select("*", own.alias("own"))
    sent = shared.select("shard", "fp", "own", F.explode(F.sequence("own", F.col("trees") - 1)).alias("tree")).select("shard", "tree", (F.col("tree") != F.col("own")).alias("asks"), "fp")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard(radius)
        for batch in batches:
            links: list[tuple[int, int]] = []
            numbers = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64).tolist()
            for key, tree, asks, number in zip(*(batch.column(k).to_pylist() for k in range(3)), numbers):
                if (key, tree) != now:
                    now, shard = (key, tree), Shard(radius)
                links += shard.ask(number) if asks else shard.add(number)
            if links:
                ends = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_pydict({"a": pa.array(ends[:, 0]), "b": pa.array(ends[:, 1])})

    return sent.repartition("shard", "tree").sortWithinPartitions("shard", "tree", "asks").mapInArrow(linked, "a bigint, b bigint")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, body, fp, component_id) for each row of `df`: body is a hash of the text, component_id the group's least id."""
    named = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text"))
    prints = cut(with_fingerprint(named, "text", size, "fp").select("doc_id", "body", "fp"), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected(near_links(classes.select("fp"), "fp", radius), "a", "b")
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "body", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `df` that stand for their group: those with its least id.

    Rows equal in id and text are one document and stay or go together; a group with only null ids stays whole.
    """
    found = groups(df, doc_id, text, size, radius)
    lost = found.where("doc_id <> component_id or (doc_id is null and component_id is not null)")
    name, body = free_name(df, "gone"), free_name(df, "body")
    gone = lost.select(F.col("doc_id").alias(name), F.col("body").alias(body)).distinct()
    return df.join(gone, F.col(doc_id).eqNullSafe(gone[name]) & (F.xxhash64(df[text]) == gone[body]), "left_anti")

"""Merkle manifest of a dataset: a hash for each row, a tree of them for each group, a tree of the groups' roots.

A parent is the SHA-256 of its children's hexadecimal digests, three by three in order. It keeps a copy of its hash
state before each child slot; to fold a changed child, the state before its slot is resumed with the replacement and
the siblings to its right, and what stands to its left is not hashed again. A digest's text is one block of the hash, so
these states are 32 bytes each and are rows of the tables of upper nodes.

1. Each row's leaf digest is computed by SQL functions; only ids, groups and digests go on.
2. Range partitions by (group, order) give every row its place in its group, so no group is ever in one task.
3. `SPAN` consecutive leaves make a block. A task builds the trees of its blocks, all levels of many blocks at once, and
   folds the replaced leaves up to their block's root.
4. The blocks' roots are the next round's nodes, until each group has one; the same rounds over the groups' roots follow.
   Upper nodes keep their siblings, states and right siblings; joined downwards, these are the paths of the blocks.
5. Every row resumes the states of its block's path with the digest it has there.

Rows of equal group and order follow each other by their digest. Null groups are one group, the first. An empty table
gives an empty result. A null value and an empty one have different leaves. Very long texts only meet the leaf's hash.
Other columns of the table, whatever they are called, go into the leaf if they are listed as fields, and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sha
from .common import cut, numbered
from .kernel import whole_runs

#: Children of a parent, levels of a block, leaves of a block.
ARITY, LEVELS = 3, 5
SPAN = ARITY**LEVELS

#: One level of a path: the state before the slot, the number of children, of right siblings, and these.
STEP = 32 + 2 + 2 * 32


def leaf(fields: list[Column]) -> Column:
    """SHA-256 (hexadecimal) of all fields: `-` for null, else the length in bytes, a colon and the value."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _packed(parts: list[np.ndarray], masks: list[np.ndarray]) -> pa.Array:
    """A binary column from columns of equal width, of which each row takes those its mask names, in order."""
    n = len(masks[0]) if masks else 0
    if not parts or not n:
        return pa.array([b""] * n, pa.binary())
    width = parts[0].shape[1]
    mask = np.stack(masks, axis=1)
    data = np.stack(parts, axis=1)[mask]
    offsets = np.concatenate(([0], np.cumsum(mask.sum(axis=1) * width))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


class Blocks:
    """Trees of some blocks: nodes sorted by block and place; `levels` of each node is the height of its block's tree."""

    def __init__(self, block: np.ndarray, place: np.ndarray, digests: np.ndarray, levels: np.ndarray):
        first = np.concatenate(([True], block[1:] != block[:-1])) if len(block) else np.zeros(0, bool)
        self.block = np.cumsum(first) - 1
        self.top = np.zeros((int(first.sum()), 32), np.uint8)
        self.steps: list[dict[str, np.ndarray]] = []
        at = np.arange(len(block))  # the node above each leaf
        block, place, height = self.block, place - np.repeat(place[first], np.diff(np.append(np.flatnonzero(first), len(place)))), levels
        for level in range(int(levels.max(initial=0)) + 1):
            done = height == level
            self.top[block[done]] = digests[done]
            up = np.flatnonzero(~done)
            if not len(up):
                break
            b, parent = block[up], place[up] // ARITY
            begins = np.concatenate(([True], (b[1:] != b[:-1]) | (parent[1:] != parent[:-1])))
            number = np.cumsum(begins) - 1
            head = np.flatnonzero(begins)
            children = np.diff(np.append(head, len(up)))
            given, written = digests[up], sha.texts(digests[up])
            states = [sha.start(len(head))]
            for slot in range(ARITY):
                has = children > slot
                after = states[-1].copy()
                after[has] = sha.absorb(after[has], written[head[has] + slot])
                states.append(after)
            new = sha.finish(states[ARITY], children)
            to = np.full(len(block), -1)
            to[up] = np.arange(len(up))
            here = np.where(at >= 0, to[at], -1)  # of each leaf among the nodes that have a parent; -1: its tree is done
            self.steps.append({"here": here, "number": number, "slot": np.arange(len(up)) - head[number], "children": children, "head": head, "given": given, "written": written, "states": np.stack(states[:ARITY])})
            at = np.where(here >= 0, number[here], -1)
            digests, block, place, height = new, b[head], parent[head], height[up][head]

    def siblings(self) -> pa.Array:
        """The digests of the siblings of each leaf and of what stands above it, from left to right, level by level."""
        parts, masks = [], []
        for s in self.steps:
            live, here = s["here"] >= 0, np.maximum(s["here"], 0)
            number, slot = s["number"][here], s["slot"][here]
            for k in range(ARITY):
                other = live & (slot != k) & (s["children"][number] > k)
                parts.append(s["given"][np.minimum(s["head"][number] + k, len(s["given"]) - 1)])
                masks.append(other)
        return _packed(parts, masks) if parts else pa.array([b""] * len(self.block), pa.binary())

    def paths(self) -> pa.Array:
        """The steps by which the digest of each leaf is folded to its block's root."""
        parts, masks = [], []
        for s in self.steps:
            live, here = s["here"] >= 0, np.maximum(s["here"], 0)
            number, slot = s["number"][here], s["slot"][here]
            step = np.zeros((len(here), STEP), np.uint8)
            step[:, :32] = s["states"][slot, number].astype(">u4").view(np.uint8).reshape(-1, 32)
            step[:, 32] = s["children"][number]
            step[:, 33] = right = s["children"][number] - slot - 1
            for k in range(ARITY - 1):
                has = right > k
                step[has, 34 + 32 * k : 66 + 32 * k] = s["given"][here[has] + 1 + k]
            parts.append(step)
            masks.append(live)
        return _packed(parts, masks) if parts else pa.array([b""] * len(self.block), pa.binary())


def fold(digests: np.ndarray, paths: pa.Array) -> np.ndarray:
    """Digests at the ends of the paths: each step resumes the kept state with the digest and its right siblings."""
    out = digests.copy()
    lengths = np.array([len(p) for p in paths.to_pylist()], np.int64) if len(paths) else np.zeros(0, np.int64)
    steps = np.frombuffer(b"".join(paths.to_pylist()), np.uint8).reshape(-1, STEP)
    many = lengths // STEP
    first = np.cumsum(many) - many
    for level in range(int(many.max(initial=0))):
        rows = np.flatnonzero(many > level)
        step = steps[first[rows] + level]
        states = np.ascontiguousarray(step[:, :32]).view(">u4").astype(np.uint32)
        states = sha.absorb(states, sha.texts(out[rows]))
        for k in range(ARITY - 1):
            has = step[:, 33] > k
            states[has] = sha.absorb(states[has], sha.texts(step[has, 34 + 32 * k : 66 + 32 * k]))
        out[rows] = sha.finish(states, step[:, 32])
    return out


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes (grp, pos, size, digest, ...) with their block, all rows of a block in one task and in order."""
    blocked = nodes.withColumn("block", F.floor(F.col("pos") / SPAN))
    return blocked.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")


def _heights(sizes: np.ndarray) -> np.ndarray:
    """Levels of the tree over so many nodes, at most those of a block."""
    return (sizes[:, None] > ARITY ** np.arange(LEVELS)[None, :]).sum(axis=1)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Blocks]]:
    """Batches (grp, block, pos, size, digest, ...) of whole blocks, with their trees."""
    for batch in whole_runs(batches, 2):
        grp, block, pos, size = (batch.column(k).to_numpy() for k in range(4))
        begins = np.concatenate(([True], (grp[1:] != grp[:-1]) | (block[1:] != block[:-1])))
        yield batch, Blocks(np.cumsum(begins), pos, _digests(batch.column(4)), _heights(size))


def _binary(digests: np.ndarray) -> pa.Array:
    return pa.array(digests.tobytes()[i : i + 32] for i in range(0, 32 * len(digests), 32)) if len(digests) else pa.array([], pa.binary())


def _upper(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(grp, pos, path, siblings): from each node to its group's root; and (grp, root)."""
    kind = "grp bigint, block bigint, pos bigint, size bigint, path binary, siblings binary, top binary"

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, trees in _trees(batches):
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(4)], trees.paths(), trees.siblings(), _binary(trees.top[trees.block])],
                ["grp", "block", "pos", "size", "path", "siblings", "top"],
            )

    rounds, roots = [], None
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while True:
        here = cut(_in_blocks(nodes).select("grp", "block", "pos", "size", "digest").mapInArrow(built, kind), f"{name}-{len(rounds)}")
        rounds.append(here)
        done = here.where(F.col("size") <= SPAN).where("pos = 0").select("grp", F.col("top").alias("root"))
        roots = done if roots is None else roots.union(done)
        if largest <= SPAN:
            break
        nodes = here.where((F.col("size") > SPAN) & (F.col("pos") % SPAN == 0)).select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / SPAN).alias("size"), F.col("top").alias("digest"))
        largest = -(-largest // SPAN)
    above = None
    for here in reversed(rounds):
        if above is not None:
            more = above.select("grp", F.col("pos").alias("block"), F.col("path").alias("more"), F.col("others"))
            here = here.join(more, ["grp", "block"], "left")
            path, others = F.concat("path", F.coalesce("more", F.lit(b""))), F.concat("siblings", F.coalesce("others", F.lit(b"")))
        else:
            path, others = F.col("path"), F.col("siblings")
        above = here.select("grp", "pos", path.alias("path"), others.alias("others"))
    return above.select("grp", "pos", "path", F.col("others").alias("siblings")), roots


def manifest(df: DataFrame, fields: list[str], group: str, order: str, replaced: Column | None = None) -> DataFrame:
    """One row for each of `df`: `order`, `group`, leaf, subroot, root, folded (hexadecimal) and siblings.

    `replaced` is the leaf (hexadecimal) that is folded in a row's place, else its own. `siblings` are the digests beside
    the row's path, 32 bytes each, from the leaf's level up through its group's root to the root, left to right.
    """
    own = leaf([F.col(f) for f in fields])
    rows = df.select(
        F.col(order).alias("ord"), F.col(group).alias("name"), F.unhex(own).alias("digest"),
        F.unhex(F.coalesce(replaced, own) if replaced is not None else own).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    ordered = numbered(cut(rows, "leaves"), ["name", "ord", "digest", "row"], "number").drop("row")
    sizes = ordered.groupBy("name").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("size"))
    groups = cut(numbered(sizes, ["first"], "grp"), "groups")
    total = groups.count()
    # A group's rows follow each other, so its pieces are numbered stretches; the key of a join is a stretch, not a group.
    stretch = F.floor(F.col("number") / (SPAN * 16))
    pieces = ordered.select("name", stretch.alias("stretch")).distinct()
    known = pieces.alias("p").join(groups.alias("g"), F.col("p.name").eqNullSafe(F.col("g.name"))).select("p.name", "p.stretch", "g.grp", "g.first", "g.size")
    left = ordered.withColumn("stretch", stretch).alias("o")
    nodes = left.join(known.alias("k"), (F.col("o.stretch") == F.col("k.stretch")) & F.col("o.name").eqNullSafe(F.col("k.name"))).select(
        "grp", (F.col("number") - F.col("first")).alias("pos"), "size", "digest", "other", "ord", F.col("o.name").alias("name")
    )
    order_type, group_type = df.schema[order].dataType.simpleString(), df.schema[group].dataType.simpleString()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, trees in _trees(batches):
            folded = fold(_digests(batch.column(5)), trees.paths())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in (0, 1, 2, 3, 4, 6, 7)], _binary(folded), trees.siblings(), _binary(trees.top[trees.block])],
                ["grp", "block", "pos", "size", "digest", "ord", "name", "folded", "siblings", "top"],
            )

    kind = f"grp bigint, block bigint, pos bigint, size bigint, digest binary, ord {order_type}, name {group_type}, folded binary, siblings binary, top binary"
    leaves = cut(_in_blocks(nodes).select("grp", "block", "pos", "size", "digest", "other", "ord", "name").mapInArrow(built, kind), "blocks")
    tops = leaves.where(F.col("pos") % SPAN == 0).select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / SPAN).alias("size"), F.col("top").alias("digest"))
    paths, roots = _upper(tops, "upper")
    roots = cut(roots, "subroots")
    over, root = _upper(roots.select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("pos"), F.lit(total).cast("bigint").alias("size"), F.col("root").alias("digest")), "root")
    found = root.first()
    root_text = found["root"].hex() if found else ""
    over = over.select(F.col("pos").alias("grp"), F.col("path").alias("path2"), F.col("siblings").alias("siblings2")).join(roots, "grp")
    whole = paths.join(over, "grp").select(
        "grp", F.col("pos").alias("block"), F.concat("path", "path2").alias("path"), F.concat("siblings", "siblings2").alias("above"), F.col("root").alias("subroot")
    )
    whole = cut(whole, "paths")

    @F.arrow_udf("binary")
    def resumed(digests: pa.Array, steps: pa.Array) -> pa.Array:
        return _binary(fold(_digests(digests), steps))

    joined = leaves.join(whole, ["grp", "block"])
    text = lambda c: F.lower(F.hex(c))
    return joined.select(
        F.col("ord").alias(order), F.col("name").alias(group), text("digest").alias("leaf"), text("subroot").alias("subroot"), F.lit(root_text).alias("root"),
        text(resumed("folded", "path")).alias("folded"), F.concat("siblings", "above").alias("siblings"),
    )

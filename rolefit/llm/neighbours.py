"""Near-duplicate vectors by NN-descent.

Equal vectors are one node. The neighbour graph starts from vectors that stand next to each other in orders by random
hyperplane signs, and is refined by neighbours-of-neighbours joins: the vectors that a node is near to, or that are near
to it, are compared with each other and keep whatever improves their lists. A node's list has `k` entries; a saturated one (all
its entries are links) is enlarged by every further link met. Since links of links may still be missing then, the lists
are at last enlarged to the whole component of found links, compared in double precision and in blocks, and only pairs
with a cosine of `least` or more stay. The number of orders grows with the number of nodes, so that a pair at the threshold
stands in one window of some order but for a share of `MISS`, whatever the joins add.

A sample of nodes, few of any one component, is compared with all vectors to audit the recall by node; below `target` more
orders are added, and if the last try still misses it, all vectors are compared in blocks, which is exact and quadratic.

A vector that is null or empty, all zero, or has null or non-finite components, and a row without an id link with nothing.
Vectors of different length do not link. Rows that share an id but not the vector are compared like any others. Equal
vectors link with each other. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .components import connected
from .kernel import whole_runs

#: Rows compared with each other in one block of an order, members of a node compared at once, rows of a block of a component.
WINDOW, TOGETHER, BLOCK = 64, 96, 512
#: Rows of a block when all vectors are compared.
WIDE = 2048
#: Share of the pairs at the threshold that all orders of a try may miss.
MISS = 0.01
#: Nodes of one component that may be audited (expected), and bytes of vectors that are audited at once.
EACH, ASKED_BYTES = 64, 32 << 20
#: Single precision may be wrong by so much; what is this close to the threshold is decided in double precision.
SLACK = 1e-5


def nodes_of(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(c, least, n, dim, vec): one row for each vector that can link, with its least id and its number of rows."""
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = F.col(embedding).isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v"), F.col(embedding)).where("id is not null").where(F.coalesce(good, F.lit(False)))
    grouped = rows.groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    return grouped.select(F.xxhash64("v", "least").alias("c"), "least", "n", F.size("v").alias("dim"), F.col("v").alias("vec"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, each of `dim` numbers, scaled to length 1."""
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def enough_tables(nodes: int, least: float) -> int:
    """Orders in which a pair with a cosine of `least` shares half a window in at least one, but for a share of MISS.

    A hyperplane leaves the pair on one side with probability 1 - angle / pi; half a window is what has the first
    log2(nodes / half a window) signs in common.
    """
    same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    chance = same ** max(0.0, math.log2(max(1, nodes) / (WINDOW / 2)))
    return 1 if chance >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-chance))


def _orders(nodes: DataFrame, tables: range, k: int) -> DataFrame:
    """(u, v, sim): the k best of those near in each of some orders by 62 hyperplane signs."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                x = matrix(batch.column(2).take(pa.array(rows)), dim)
                single = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(rows), [None, pa.py_buffer(x.astype("<f4").tobytes())]).cast(pa.binary())
                ids = batch.column(0).take(pa.array(rows))
                for t in tables:
                    planes = np.random.default_rng((t, dim)).standard_normal((dim, 62))
                    key = (x @ planes > 0) @ (1 << np.arange(62, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(key), ids, single], ["dim", "t", "key", "c", "x"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            ids = batch.column(3).to_numpy()
            us, vs, sims = [], [], []
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                x = np.frombuffer(b"".join(batch.column(4).slice(low, high - low).to_pylist()), "<f4").reshape(high - low, -1)
                for a in range(0, high - low, WINDOW * 3 // 4):
                    part = x[a : a + WINDOW]
                    if len(part) < 2:
                        continue
                    s = part @ part.T
                    np.fill_diagonal(s, -2)
                    best = np.argpartition(-s, min(k, len(part) - 1) - 1, axis=1)[:, :k]
                    own = np.repeat(np.arange(len(part)), best.shape[1])
                    us.append(ids[low + a + own])
                    vs.append(ids[low + a + best.ravel()])
                    sims.append(s[own, best.ravel()])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (us, vs, sims)], ["u", "v", "sim"])

    rows = nodes.select("c", "dim", "vec").mapInArrow(keyed, "dim int, t int, key bigint, c bigint, x binary")
    order = ["dim", "t", "key", "c"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, "u bigint, v bigint, sim float")


def _best(edges: DataFrame, k: int, least: float) -> DataFrame:
    """Each node's k best neighbours and all further links: a saturated list is enlarged."""
    one = edges.where("u <> v").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u").orderBy(F.col("sim").desc(), "v")
    ranked = one.withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= k) | (F.col("sim") >= least - SLACK))


def _improved(nodes: DataFrame, edges: DataFrame, k: int, least: float, salt: int) -> DataFrame:
    """(u, v, sim) that the members of one node's list would take into their own lists."""
    near = edges.where(F.col("rank") <= k)
    both = near.select(F.col("u").alias("centre"), F.col("v").alias("member")).union(near.select(F.col("v").alias("centre"), F.col("u").alias("member"))).distinct()
    parts = both.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("parts"))
    worst = near.groupBy("u").agg(F.min("sim").alias("low"))
    known = nodes.join(worst, nodes["c"] == worst["u"], "left").select(F.col("c").alias("member"), "dim", "vec", F.coalesce("low", F.lit(-2.0)).cast("float").alias("low"))
    dealt = both.join(parts, "centre").select("centre", F.pmod(F.xxhash64(F.lit(salt), "member"), "parts").alias("part"), "member")
    rows = dealt.join(known, "member").select("centre", "part", "member", "low", "dim", F.transform("vec", lambda x: x.cast("float")).alias("vec"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in whole_runs(batches, 2):
            centre, part = done.column(0).to_numpy(), done.column(1).to_numpy()
            change = np.flatnonzero((np.diff(centre) != 0) | (np.diff(part) != 0)) + 1
            cuts = np.concatenate(([0], change, [len(done)]))
            members, low, dims = done.column(2).to_numpy(), done.column(3).to_numpy(), done.column(4).to_numpy()
            us, vs, sims = [], [], []
            for dim in np.unique(dims).tolist():
                x = np.zeros((len(done), dim), "<f4")
                mine = np.flatnonzero(dims == dim)
                x[mine] = matrix(done.column(5).take(pa.array(mine)), dim)
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    if b - a < 2 or dims[a] != dim:
                        continue
                    s = x[a:b] @ x[a:b].T
                    np.fill_diagonal(s, -2)
                    i, j = np.nonzero(s > np.minimum(low[a:b], least - SLACK)[:, None])
                    us.append(members[a + i])
                    vs.append(members[a + j])
                    sims.append(s[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in (us, vs, sims)], ["u", "v", "sim"])

    return rows.repartition("centre", "part").sortWithinPartitions("centre", "part").mapInArrow(joined, "u bigint, v bigint, sim float")


def _compare(nodes: DataFrame, roots: DataFrame, least: float, size: int) -> DataFrame:
    """(c, other, links) within the components: links counts rows of linked vectors in one pair of blocks; other is a
    linked node (null for counts), and these links span each component's exact parts."""
    of = nodes.join(roots, nodes["c"] == roots["node"]).select("c", "n", "dim", "vec", "root")
    sizes = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    placed = of.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    # Block i meets the blocks j >= i: its rows go to (i, j) for these and to (j, i) for the others.
    sent = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = sent.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "c", "n", "dim", "vec")

    def exact(table: pa.RecordBatch) -> pa.RecordBatch:
        i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
        block, c, n = (table.column(k).to_numpy() for k in (3, 4, 5))
        x = matrix(table.column(7), table.column(6)[0].as_py())
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        linked = x[left] @ x[right].T >= least
        if i == j:
            np.fill_diagonal(linked, False)
        counts = np.zeros(len(c), np.int64)
        counts[left] += linked @ n[right]
        if i != j:
            counts[right] += linked.T @ n[left]
        span = _spanning(linked, left, right, len(c))
        links = np.array(span, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([c, c[links[:, 0]]])), pa.array(np.concatenate([c, c[links[:, 1]]])), pa.array(np.concatenate([counts, np.full(len(links), -1)]))], ["a", "b", "links"]
        )

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in whole_runs(batches, 3):
            keys = np.stack([done.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            yield from (exact(done.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:]))

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(compared, "a bigint, b bigint, links bigint")


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Links that join the same rows as `linked` does, fewer than there are rows."""
    seen, out = np.zeros(size, bool), []
    row_of, column_of = {r: k for k, r in enumerate(left.tolist())}, {r: k for k, r in enumerate(right.tolist())}
    for start in left.tolist():
        if seen[start]:
            continue
        seen[start] = True
        todo = [start]
        while todo:
            at = todo.pop()
            near = []
            if at in row_of:
                near.append(right[linked[row_of[at]]])
            if at in column_of and left is not right:
                near.append(left[linked[:, column_of[at]]])
            for other in np.concatenate(near).tolist():
                if not seen[other]:
                    seen[other] = True
                    out.append((at, other))
                    todo.append(other)
    return out


def audit(nodes: DataFrame, roots: DataFrame, least: float, sample: int = 512, enough: int = 256) -> tuple[int, int]:
    """(linked nodes, those with every link found) of a sample compared with every node; found means in one component.

    About EACH nodes of any one component can be asked, so that a large group of copies does not outvote the small ones.
    The sample grows until it holds `enough` linked nodes, where links are rare up to all nodes that can be asked.
    """
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rooted = nodes.join(roots.join(sizes, "root"), nodes["c"] == F.col("node"), "left")

    def drawn(salt: str):
        return F.pmod(F.xxhash64(F.lit(salt), "c"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    placed = cut(rooted.select("c", "dim", "vec", F.coalesce("root", "c").alias("root"), (drawn("pool") * F.coalesce("size", F.lit(1)) < EACH).alias("may"), drawn("audit").alias("at")), "placed")
    total, widest = placed.where("may").agg(F.count(F.lit(1)), F.max("dim")).first()
    most = max(1, ASKED_BYTES // (8 * (widest or 1)))
    linked = found = 0
    low, asked = 0.0, min(sample, most)
    while low < 1 and total and linked < enough:
        high = min(1.0, low + asked / total)
        more, hits = _asked(placed, placed.where(F.col("may") & (F.col("at") >= low) & (F.col("at") < high)), least)
        linked, found = linked + more, found + hits
        low, asked = high, min(4 * asked, most)
    return linked, found


def _asked(placed: DataFrame, some: DataFrame, least: float) -> tuple[int, int]:
    """(linked nodes, those with every link found) of `some` nodes."""
    asked = some.select("c", "dim", "vec", "root").toArrow().combine_chunks()
    by_dim = {}
    for dim in set(asked["dim"].to_pylist()):
        mine = asked.filter(pa.compute.equal(asked["dim"], dim))
        by_dim[dim] = (mine["c"].to_numpy(), mine["root"].to_numpy(), matrix(mine["vec"].combine_chunks(), dim))
    shared = placed.sparkSession.sparkContext.broadcast(by_dim)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, roots = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for dim, (c, root, q) in shared.value.items():
                rows = np.flatnonzero(dims == dim)
                if not len(rows):
                    continue
                x = matrix(batch.column(2).take(pa.array(rows)), dim)
                for a in range(0, len(c), BLOCK):
                    i, j = np.nonzero(q[a : a + BLOCK] @ x.T >= least)
                    i, j = i + a, rows[j]
                    other = c[i] != ids[j]
                    i, j = i[other], j[other]
                    links, hits = np.bincount(i, minlength=len(c)), np.bincount(i[root[i] == roots[j]], minlength=len(c))
                    met = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(c[met]), pa.array(links[met]), pa.array(hits[met])], ["a", "links", "hits"])

    each = placed.select("c", "dim", "vec", "root").mapInArrow(searched, "a bigint, links bigint, hits bigint").groupBy("a").agg(F.sum("links").alias("links"), F.sum("hits").alias("hits"))
    row = each.agg(F.count(F.lit(1)), F.sum((F.col("links") == F.col("hits")).cast("int"))).first()
    shared.destroy()
    return row[0], row[1] or 0


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, k: int = 8,
                    tables: int = 12, rounds: int = 2, target: float = 0.98, tries: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `df`. `tables` is the least number of orders of a try."""
    nodes = cut(nodes_of(df, vec_id, embedding), "nodes")
    edges, salt, size = None, 0, BLOCK
    tables = max(tables, enough_tables(nodes.count(), least))
    for attempt in range(tries):
        fresh = _orders(nodes, range(attempt * tables, (attempt + 1) * tables), k)
        edges = cut(_best(fresh if edges is None else fresh.union(edges.select("u", "v", "sim")), k, least), "edges")
        for _ in range(rounds):
            salt += 1
            more = _improved(nodes, edges, k, least, salt)
            edges = cut(_best(more.union(edges.select("u", "v", "sim")), k, least), "edges")
        roots = cut(connected(edges.where(F.col("sim") >= least - SLACK), "u", "v"), "roots")
        linked, found = audit(nodes, roots, least)
        if found >= target * linked:
            break
    else:  # what is still missing is found by comparing all vectors of a length, as one component
        roots, size = nodes.select(F.col("c").alias("node"), F.col("dim").cast("bigint").alias("root")), WIDE
    exact = cut(_compare(nodes, roots, least, size), "exact")
    counts = exact.where("links >= 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    parts = connected(exact.where("links < 0"), "a", "b")
    placed = nodes.join(counts, "c", "left").join(parts, nodes["c"] == parts["node"], "left")
    placed = placed.select("c", "least", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "c").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(firsts, "root").select("vec", F.col("links").alias("links"), "component_id")
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = df.select(F.col(vec_id).alias("vec_id"), v.alias("v"))
    out = rows.join(of, (F.col("v") == F.col("vec")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", F.col("vec_id").cast("bigint"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))

import numpy as np
from rolefit.llm import neighbours


def brute(rows, least):
    good = [v is not None and len(v) > 0 and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    unit = [np.array(v, float) / np.abs(v).max() if g else None for (_, v), g in zip(rows, good)]
    n = len(rows)
    near = [[a != b and good[a] and good[b] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= least for b in range(n)] for a in range(n)]
    out = []
    for a in range(n):
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            for b in range(n):
                if near[x][b] and b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[a][0], sum(near[a]), low, rows[a][0] is None or rows[a][0] == low))
    return out


def check(llm, rows, type_="float", **options):
    df = llm.createDataFrame([(i, v, "x", 1) for i, v in rows], f"vec_id bigint, embedding array<{type_}>, vec string, c int").repartition(3)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) if type_ == "float" else x for x in v]) for i, v in rows]
    found = [tuple(r) for r in neighbours.near_duplicates(df, **options).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(found, key=key) == sorted(brute(exact, 0.9), key=key)


def test_clusters(llm, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)  # some components are compared in several blocks
    rng = np.random.default_rng(4)
    rows = []
    for size in [1] * 150 + [2] * 30 + [60]:
        centre = rng.standard_normal(16)
        rows += [centre + rng.standard_normal(16) * rng.choice([0.02, 0.12, 0.25]) for _ in range(size)]
    check(llm, [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows)])


def test_odd_vectors(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]),
        (None, [1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.1, 0.0]), (12, [-1.0, 0.0]), (13, [1e300, 1e298]), (14, [0.9, 0.43588989435406735]),
    ]
    check(llm, rows, "double")
    assert neighbours.near_duplicates(llm.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0


def test_audit_sees_missing_links(llm):
    df = llm.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    nodes = neighbours.nodes_of(df, "vec_id", "embedding").cache()
    c = {r.least: r.c for r in nodes.collect()}
    assert neighbours.audit(nodes, llm.createDataFrame([], "node bigint, root bigint"), 0.9) == (2, 0)
    assert neighbours.audit(nodes, llm.createDataFrame([(c[1], c[1]), (c[2], c[1])], "node bigint, root bigint"), 0.9) == (2, 2)


def pairs(count, size, group, seed=5):
    """`count` isolated pairs with cosine 0.93 in `size` dimensions, and `group` near copies of one vector."""
    rng = np.random.default_rng(seed)
    x, e = (rng.standard_normal((count, size)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * e / np.linalg.norm(e, axis=1, keepdims=True)
    near = rng.standard_normal(size) + rng.standard_normal((group, size)) * 0.01
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y, near]))]


def test_audit_is_by_node(llm):
    """A large group of found copies does not hide lost pairs, and rare links are looked for until some are held."""
    rows = pairs(20, 32, 400)
    nodes = neighbours.nodes_of(llm.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding").cache()
    c = {r.least: r.c for r in nodes.collect()}
    roots = llm.createDataFrame([(c[i], c[40]) for i in range(40, 440)], "node bigint, root bigint")
    linked, found = neighbours.audit(nodes, roots, 0.9)
    assert linked - found == 40 and found < 0.9 * linked
    alone = neighbours.nodes_of(llm.createDataFrame(pairs(3, 32, 0) + [(i + 10, v) for i, v in pairs(300, 32, 0, 6)[:300]], "vec_id bigint, embedding array<double>"), "vec_id", "embedding").cache()
    assert neighbours.audit(alone, llm.createDataFrame([], "node bigint, root bigint"), 0.9, sample=4) == (6, 0)


def test_missed_target_is_compared_whole(llm, monkeypatch):
    monkeypatch.setattr(neighbours, "WINDOW", 4)
    monkeypatch.setattr(neighbours, "WIDE", 50, raising=False)
    check(llm, pairs(60, 16, 10), "double", tables=1, rounds=0, tries=1, target=1.1)


def test_tables_grow():
    sizes = [neighbours.enough_tables(n, 0.9) for n in (10, 10_000, 400_000, 100_000_000)]
    assert sizes[0] == 1 and sizes == sorted(set(sizes)) and neighbours.enough_tables(10**6, 0.95) < neighbours.enough_tables(10**6, 0.9)

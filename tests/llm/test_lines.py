import random

import numpy as np
import pyarrow as pa
import pytest
from rolefit.llm import lines
from rolefit.llm.kernel import Words


def brute(rows, share):
    every = [(i, k, t, set(x.encode().split())) for i, t in rows for k, x in enumerate(t.split("\n") if t else [])]
    every = [x for x in every if x[3]]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    return {y[:3] for y in every for x in every if order(x) < order(y) and len(x[3] & y[3]) >= share * len(x[3] | y[3]) - 1e-9}


def check(df, share=0.8, **options):
    rows = df.select("doc_id", "text").collect()
    gone = brute([(r.doc_id, r.text) for r in rows], share)

    def left(i, t):
        parts = t.split("\n") if t else []
        kept = [x for k, x in enumerate(parts) if (i, k, t) not in gone]
        return (len(parts), len(parts) - len(kept), "\n".join(kept) if t is not None else None)

    found = lines.remove_lines(df, share=share, **options).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed, r.kept) for r in found), key=key) == sorted(((r.doc_id, r.text, *left(r.doc_id, r.text)) for r in rows), key=key)


def varied(draw, line, words):
    out = line.split()
    for _ in range(draw.randrange(4)):
        at = draw.randrange(len(out) + 1)
        out[at : at + draw.randrange(2)] = [draw.choice(words)] * draw.randrange(2)
    return " ".join(out)


@pytest.mark.parametrize("share", [0.8, 0.6])
def test_random_lines(llm, share):
    draw = random.Random(5)
    words = [f"w{int(draw.expovariate(0.05))}" for _ in range(400)]
    bases = [" ".join(draw.choices(words, k=draw.choice([1, 3, 4, 5, 9, 20, 40]))) for _ in range(25)]
    texts = []
    for _ in range(60):
        parts = [varied(draw, draw.choice(bases), words) if draw.random() < 0.6 else " ".join(draw.choices(words, k=draw.randint(0, 25))) for _ in range(draw.randint(0, 8))]
        texts.append("\n".join(parts))
    texts += texts[:10]
    check(llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), share)


def test_hot_tokens_in_blocks(llm):
    """Many variants of one line: token lists longer than the compared neighbours, and dealt in blocks."""
    draw = random.Random(9)
    base = [f"b{i}" for i in range(12)]
    texts = []
    for i in range(150):
        mine = list(base)
        mine[draw.randrange(12)] = f"v{draw.randrange(9)}"
        if i % 3 == 0:
            mine += [f"z{draw.randrange(40)}", f"z{draw.randrange(40)}", f"y{draw.randrange(40)}"]
        texts.append(" ".join(mine))
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    check(df)
    check(df, limit=20)


def test_many_buckets(llm, monkeypatch):
    """Tokens dealt to many buckets, with blocks of hot ones, find the same lines."""
    draw = random.Random(3)
    words = [f"w{int(draw.expovariate(0.05))}" for _ in range(200)]
    bases = [" ".join(draw.choices(words, k=draw.choice([4, 9, 20, 200]))) for _ in range(12)]
    rows = [(i, "\n".join(varied(draw, draw.choice(bases), words) for _ in range(draw.randint(1, 5)))) for i in range(50)]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(lines, "BUCKET", 40)
    check(df)
    check(df, limit=4)


def test_marks(llm):
    """Every marked place is found again, and few others are."""
    draw = np.random.default_rng(2)
    o, spot = draw.integers(-(1 << 62), 1 << 62, (2, 3000))
    df = llm.createDataFrame(list(zip(o[:1500].tolist(), spot[:1500].tolist())), "o bigint, spot bigint").repartition(4)
    marks = lines.Marks(df, 1500, lines.spot_hashes)
    assert marks.of(o[:1500], spot[:1500]).all() and marks.of(o[1500:], spot[1500:]).mean() < 0.2
    none = lines.Marks(df.limit(0), 0, lines.text_hashes)
    assert not none.of(o, spot).any()


def test_lines_that_fail_try_the_rest(llm):
    """The earliest candidate passes all filters, since its tokens' parity bits cancel, but only a later one is similar."""
    names = [f"t{i}" for i in range(400)]
    bits = Words(pa.array([" ".join(names)])).hashes & np.uint64(63)
    pairs = [(names[a], names[b]) for a in range(400) for b in range(a) if bits[a] == bits[b]]
    (p, q), (r, s) = pairs[0], next(x for x in pairs if not set(x) & set(pairs[0]))
    rare = "k l m n o"
    texts = [f"{rare} {p} {q}", f"{rare} {r} {s} u", f"{rare} {r} {s}"] + [f"{p} {q} {r} {s} f{i} g{i} h{i}" for i in range(30)]
    df = llm.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(df)
    assert [x.n_removed for x in lines.remove_lines(df).orderBy("doc_id").limit(3).collect()] == [0, 0, 1]


def test_odd_rows(llm, no_texts):
    rows = [(1, "a b c d e\n\na b c d e\r"), (1, "a b c d e\n\na b c d e\r"), (2, None), (3, ""), (4, "\n \n"), (None, "a b c d e"), (None, "q r s t u"), (5, "e d c b a x"), (6, "only line é\nünï " + "w " * 30_000)]
    df = llm.createDataFrame([(*r, *["other"] * 6) for r in rows], "doc_id bigint, text string, kept string, n_lines string, o string, body string, spots string, result string")
    check(df)
    assert lines.remove_lines(df).columns == ["doc_id", "text", "o", "body", "spots", "result", "n_lines", "n_removed", "kept"]
    assert lines.remove_lines(no_texts).count() == 0


def test_null_ids_are_texts_of_their_own(llm):
    """Removed lines are gathered for each text, also where all ids are null."""
    draw = random.Random(4)
    rows = [(None, "\n".join(["one line that all texts share", *(" ".join(draw.choices("abcdefghijklmnop", k=9)) for _ in range(3))])) for _ in range(40)]
    rows += rows[:5] + [(1, rows[0][1])]
    df = llm.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    check(df)
    plan = lines.remove_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    keys = [x.split("Aggregate [", 1)[1].split("], [", 1)[0] for x in plan.splitlines() if "collect_set" in x]
    assert keys and all(", " in x for x in keys)


def test_lists_of_middling_length_are_compared_together(monkeypatch):
    """200 tokens of 60 lines each: passes over all lists at once, not some for each list, and the same pairs either way."""
    draw = np.random.default_rng(4)
    route = np.repeat(np.arange(200), 60)
    o, spot = draw.permutation(len(route)), draw.integers(0, 9, len(route)) << 32
    shape, sketch = np.full(len(route), 20 << 32), draw.integers(0, 8, len(route))
    batch = pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([x.astype("<i8").tobytes()]) for x in (route, o, spot, shape, sketch)]], ["bucket", "route", "o", "spot", "shape", "sketch"])
    calls, near = [], lines.Meeting.near

    def counted(self, x, y):
        calls.append(1)
        return near(self, x, y)

    def pairs():
        rows = lines.Meeting(batch, 0.9)
        return sorted((int(a), int(b), bool(m)) for x, y, more in rows.pairs(None) for a, b, m in zip(x, y, more))

    monkeypatch.setattr(lines.Meeting, "near", counted)
    found = pairs()
    assert found and len(calls) < 200
    monkeypatch.setattr(lines, "LAGS", 4)
    assert pairs() == found

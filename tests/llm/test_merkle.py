import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rolefit.llm import merkle, sha

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [None if v is None else str(v) for v in (*[row[c] for c in FIELDS[:4]], text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def runs(levels, i):
    """(place in the run, the run) of each level above node i."""
    for nodes in levels[:-1]:
        yield i % 3, nodes[i // 3 * 3 : i // 3 * 3 + 3]
        i //= 3


def tampered(row):
    odd = row.doc_id is None or zlib.crc32(str(row.doc_id).encode()) % 2
    return row.text if row.text is None or odd else row.text.replace("\n", "")


def plain(rows):
    """(doc_id, leaf, subroot, root, siblings, folded) of each row, by hashing everything."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    trees = [tree([leaf(r, r.text) for r in by[s]]) for s in names]
    over = tree([t[-1][0] for t in trees])
    out = []
    for k, (name, t) in enumerate(zip(names, trees)):
        for i, r in enumerate(by[name]):
            siblings, folded = "", leaf(r, tampered(r))
            for at, run in (*runs(t, i), *runs(over, k)):
                siblings += "".join(run[:at] + run[at + 1 :])
                folded = digest(*run[:at], folded, *run[at + 1 :])
            out.append((r.doc_id, t[0][i], t[-1][0], over[-1][0], siblings, folded))
    return out


def found(df):
    cut = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = merkle.manifest(df, FIELDS, "source", "doc_id", F.when(even, merkle.leaf(cut))).collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, bytes(r.siblings).hex(), r.folded) for r in rows]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=32, max_size=32), max_size=3), min_size=1, max_size=9))
def test_states_like_hashlib(messages):
    longest = max(map(len, messages))
    states, counts = sha.start(len(messages)), np.array(list(map(len, messages)))
    for k in range(longest):
        has = counts > k
        blocks = sha.texts(np.frombuffer(b"".join(m[k] for m in messages if len(m) > k), np.uint8).reshape(-1, 32))
        states[has] = sha.absorb(states[has], blocks)
    assert [bytes(d).hex() for d in sha.finish(states, counts)] == [hashlib.sha256(b"".join(m).hex().encode()).hexdigest() for m in messages]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 242, 243, 244, 730])
def test_blocks_fold_to_their_roots(n):
    leaves = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(n)]
    digests = np.frombuffer(b"".join(leaves), np.uint8).reshape(-1, 32)
    places = np.arange(n)
    trees = merkle.Blocks(places // merkle.SPAN, places, digests, merkle._heights(np.full(n, n)))
    folded = merkle.fold(digests, trees.paths())
    assert np.array_equal(folded, trees.top[trees.block])
    if n <= merkle.SPAN:
        assert bytes(folded[0]).hex() == tree([d.hex() for d in leaves])[-1][0]


def test_sources_of_many_sizes(llm):
    """Sources from one document to more than two rounds of blocks, one holding a third of all rows, one null."""
    rows, i = [], 0
    for source, n in [("big", 900), (None, 5), ("", 1), ("b", 3), ("ä", 4), ("Z", 250), *[(f"s{k:03}", 2 + k % 3) for k in range(260)]]:
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 100_003, f"line {i}\nnext" if i % 3 else (None if i % 2 else ""), None if i % 5 else "en", source, None if i % 7 else i))
    df = llm.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(7)
    assert sorted(found(df)) == sorted(plain(df.collect()))


def test_odd_rows(odd_texts, no_texts):
    """Repeated rows, null ids and texts, clashing columns; an empty table."""
    df = odd_texts.withColumns({"source": F.lit("one"), "lang": F.lit(None).cast("string"), "n_chars": F.lit(1), "grp": F.lit("x"), "digest": F.lit("x"), "pos": F.lit(1)})
    assert sorted(found(df), key=repr) == sorted(plain(df.collect()), key=repr)
    assert found(no_texts) == []


def test_single_document(llm):
    df = llm.createDataFrame([(1, "a\nb", "en", "s", 3)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    (row,) = found(df)
    assert row[1] == row[2] == row[3] and row[4] == ""

import random

import xxhash
from rolefit.llm import components, simhash


def plain(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.encode().split()]
    runs = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(numbers, radius):
    """Least member reachable from each number."""
    least = {}
    for x in sorted(numbers):
        if x in least:
            continue
        todo, least[x] = [x], x
        while todo:
            a = todo.pop()
            for b in numbers:
                if b not in least and (a ^ b).bit_count() <= radius:
                    least[b] = x
                    todo.append(b)
    return least


def test_fingerprints(odd_texts):
    for r in odd_texts.select("text").collect():
        assert simhash.fingerprint(r.text or "", 4) == plain(r.text)
    assert simhash.fingerprint("A É b", 4) == plain("a É b") != plain("a é b")


def test_links_span_all_near_pairs(llm):
    draw = random.Random(3)
    numbers = set()
    for _ in range(40):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 2, 30])):
            x = centre
            for _ in range(draw.randrange(7)):
                x ^= 1 << draw.randrange(64)
            numbers.add(x)
    want = classes(numbers, 4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = llm.createDataFrame([(signed(x),) for x in numbers], "fp bigint")
    for limit in (4096, 5):
        found = {(r.a, r.b) for r in simhash.near_links(df, "fp", 4, limit=limit).collect()}
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
        root = {r.node: r.root for r in components.connected(llm.createDataFrame(list(found), "a bigint, b bigint"), "a", "b").collect()}
        groups = {}
        for x in numbers:
            groups.setdefault(root.get(signed(x), signed(x)), set()).add(want[x])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_groups_and_kept_rows(llm, odd_texts, no_texts):
    rows = simhash.groups(odd_texts).collect()
    prints = [plain(r.text) for r in odd_texts.select("text").collect()]
    least = classes(set(prints), 4)
    members = {}
    for r in rows:
        members.setdefault(least[r.fp & (1 << 64) - 1], []).append(r.doc_id)
    for r in rows:
        ids = [i for i in members[least[r.fp & (1 << 64) - 1]] if i is not None]
        assert r.component_id == (min(ids) if ids else None)
    kept = simhash.keep_one(odd_texts)
    assert kept.columns == odd_texts.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert texts.count((1, "alpha beta gamma delta epsilon zeta")) == 2  # repeats of one row are one document
    assert (None, "alpha beta gamma delta epsilon zeta") not in texts and (2, None) in texts and (3, "") not in texts
    assert simhash.groups(no_texts).count() == 0 and simhash.keep_one(no_texts).count() == 0


def test_components_of_a_chain(llm):
    draw = random.Random(1)
    order = list(range(300))
    draw.shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(299) if i != 150] + [(5, 5), (None, 3)]
    found = components.connected(llm.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    left, right = set(order[:151]), set(order[151:])
    assert {r.node: r.root for r in found} == {x: min(left) if x in left else min(right) for x in order}
    assert components.connected(llm.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0

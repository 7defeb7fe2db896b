import random
from collections import Counter

import pytest
from rolefit.llm import repeats


def brute(texts, size):
    docs = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(d[i : i + size]) for d in docs for i in range(len(d) - size + 1))
    out = []
    for d in docs:
        gone = set()
        for i in range(len(d) - size + 1):
            if seen[tuple(d[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((len(d), len(gone), b" ".join(w for i, w in enumerate(d) if i not in gone).decode()))
    return out


def check(df, size):
    rows = repeats.remove_repeats(df, size=size).collect()
    texts = [r.text for r in df.collect()]
    assert len(rows) == len(texts)
    wanted = sorted((t or "\0", *x) for t, x in zip(texts, brute(texts, size)))
    assert sorted((r.text or "\0", r.n_words, r.n_removed, r.kept) for r in rows) == wanted


def test_odd_rows(odd_texts, no_texts):
    check(odd_texts, 5)
    assert "other" in {r.ids for r in repeats.remove_repeats(odd_texts, size=35).select("ids").collect()}
    assert repeats.remove_repeats(no_texts).count() == 0


@pytest.mark.parametrize("size,words", [(5, 3), (12, 4), (35, 30), (1, 6)])
def test_random_texts(llm, size, words):
    """Few words, so that phrases recur in many ways, also within a text and next to their copies."""
    draw = random.Random(size)
    passages = [" ".join(draw.choices("abcdefghijklmnopqrstuvwxyzäöü"[:words], k=draw.randint(size, 3 * size))) for _ in range(12)]
    texts = []
    for _ in range(150):
        parts = [draw.choice(passages) if draw.random() < 0.4 else " ".join(f"u{draw.randrange(10**6)}" for _ in range(draw.randint(0, size))) for _ in range(draw.randint(0, 5))]
        texts.append(draw.choice([" ", "\n", "\x0b  "]).join(parts))
    texts += texts[:60] + [texts[3]] * 40
    check(llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(7), size)


def test_windows_of_one_word_more(llm):
    """Only windows of the full length count, however long the common part is."""
    words = [f"w{i}" for i in range(80)]
    texts = [" ".join(words[:34] + ["x"] * 3), " ".join(words[:34] + ["y"] * 3), " ".join(words[40:75]), " ".join(["z"] + words[40:75])]
    check(llm.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), 35)


def test_size_is_checked(no_texts):
    with pytest.raises(ValueError):
        repeats.remove_repeats(no_texts, size=500)

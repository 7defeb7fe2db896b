import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from rolefit.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab é\n'st0ß", max_size=80)))
def test_like_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_matches():
    for text in ("ab" * 4000, "x" * 5001, " " * 3000 + "y", "Donaudampfschiff" * 300):
        assert ids(text) == LIBRARY.encode_ordinary(text)


def test_merges_by_plain_scan():
    """The leftmost pair of least rank, found by looking at every pair."""

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min((r, i) for i in range(len(parts) - 1) if (r := RANKS.get(parts[i] + parts[i + 1])) is not None) if any(
                parts[i] + parts[i + 1] in RANKS for i in range(len(parts) - 1)) else None
            if best is None:
                return [RANKS[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for piece in (b"qzxqzxv", b"thethethe", b"\xff\xfe\xff\xfe", b"a", b"aaaaaaaaaaaaaaaaaaaaaaa"):
        assert bpe.merge(piece, RANKS) == ([RANKS[piece]] if piece in RANKS else plain(piece))


def test_odd_rows(odd_texts, no_texts):
    encoded = bpe.encode(odd_texts, PATH, public_tokenizers.PATTERN)
    rows = bpe.decode(encoded, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == odd_texts.count() and sorted(encoded.columns) == sorted(odd_texts.columns)
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == LIBRARY.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    once = bpe.round_trip(odd_texts, PATH, public_tokenizers.PATTERN).collect()
    key = lambda r: (str(r.doc_id), r.text or "", bytes(r.ids), bytes(r.decoded))
    assert sorted(map(key, once)) == sorted(map(key, rows))
    assert bpe.encode(no_texts, PATH, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=2, max_size=64), st.text("thea ionés", min_size=2, max_size=20).map(str.encode)), min_size=1, max_size=20))
def test_merged_together_like_alone(pieces):
    found = bpe.merge_many(pieces, CODEC.first, CODEC.pairs)
    for piece, packed in zip(pieces, found):
        alone = np.frombuffer(packed, "<u4").tolist()
        assert piece in RANKS or alone == bpe.merge(piece, RANKS)
        assert b"".join(LIBRARY.decode_single_token_bytes(i) for i in alone) == piece


def test_few_cached(monkeypatch):
    monkeypatch.setattr(CODEC.lookup, "limit", 300)
    text = "one unheardofword two unheardofword three four unheardofwords five six " * 3
    assert ids(text) == LIBRARY.encode_ordinary(text) and ids(text[::-1]) == LIBRARY.encode_ordinary(text[::-1])
    assert ids(text) == LIBRARY.encode_ordinary(text) and len(CODEC.lookup.now) < 40


def test_texts_in_stretches(monkeypatch):
    monkeypatch.setattr("rolefit.llm.chunks.STRETCH", 50)
    texts = ["some words \n\n and more, " * 20, "x" * 200, "", " y" * 100]
    assert [np.frombuffer(p, "<u4").tolist() for p in CODEC.encode_all(texts)] == list(map(LIBRARY.encode_ordinary, texts))
    assert CODEC.decode_all(CODEC.encode_all(texts)) == [t.encode() for t in texts]


def test_other_patterns():
    """A pattern that matches across white space is applied to whole texts."""
    codec = bpe.Codec(RANKS, r"[\s\S]{1,7}")
    other = tiktoken.Encoding("other", pat_str=r"[\s\S]{1,7}", mergeable_ranks=RANKS, special_tokens={})
    text = "several words, cut anywhere \n at all"
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == other.encode_ordinary(text)

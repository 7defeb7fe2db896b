import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rolefit.llm import packing, tokens
from rolefit.llm.chunks import CHUNK, CUT, stretches
from rolefit.llm.queries import op11_pattern_packing
from tokenizers import Tokenizer

from .conftest import SF

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_str(MODEL)
LIBRARY.encode_special_tokens = True
ENCODE = tokens.encoder(MODEL)
ODD = "ab é\n\t\x0b\x1c\x1f\x85\xa0 ᠎​　'st0ß🙂<|endoftext|>"


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(ODD, max_size=80)), st.integers(1, 20))
def test_ids_like_the_library_in_stretches(text, size):
    assert ENCODE([text])[0].tolist() == library(text)
    cut = list(stretches(text, CUT, size))
    assert "".join(cut) == text and [i for s in cut for i in library(s)] == library(text)
    chunks = CHUNK.findall(text)
    assert "".join(chunks) == text and [i for c in chunks for i in library(c)] == library(text)


def test_bytes_of_tokens():
    read = tokens.token_bytes(MODEL)
    assert b"".join(read[i] for i in library("naïve 😀\n«x» <|endoftext|>")).decode() == "naïve 😀\n«x» <|endoftext|>"


def test_files_that_are_not_ranks():
    model = json.loads(MODEL)
    model["model"]["merges"] = model["model"]["merges"][::-1]
    assert tokens.ranked(MODEL) and not tokens.ranked(json.dumps(model))
    other = Tokenizer.from_str(json.dumps(model))
    assert tokens.encoder(json.dumps(model))(["some other text"])[0].tolist() == other.encode("some other text").ids


def histogram(lengths, size):
    return np.bincount(np.minimum(lengths, size), minlength=size + 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plans_hold_every_piece(lengths):
    h = histogram(np.array(lengths, int), 64)
    held = np.zeros(65, int)
    for content, count in packing.plan(h, 64):
        assert count > 0 and sum(content) <= 64
        np.add.at(held, list(content), count)
    assert np.array_equal(held, h)


@pytest.mark.parametrize("low, high, least", [(1, 60, 0), (300, 1500, 0.002), (100, 1900, 0.002), (1, 2048, 0.004)])
def test_close_to_the_bound(low, high, least):
    """Not more than this share above the number of sequences that the tokens fill, and never above plain best fit."""
    h = histogram(np.random.default_rng(3).integers(low, high, 60_000), 2048)
    made, bound = sum(n for _, n in packing.plan(h, 2048)), -(-int((h * np.arange(2049)).sum()) // 2048)
    assert made <= bound * (1 + least) + 1
    assert made <= 1.001 * sum(n for _, n in packing.best_fit(h, 2048))


def test_least_squares_finds_exact_patterns():
    """A histogram made of three patterns alone is fitted by patterns that leave nothing over."""
    h = np.zeros(65, int)
    for content, count in (((40, 24), 500), ((30, 20, 14), 300), ((33, 31), 200)):
        np.add.at(h, list(content), count)
    assert sum(n for _, n in packing.plan(h, 64)) == 1000
    assert all(sum(c) == 64 and x > 0 for c, x in packing.fit(h, 64))


def check(rows, texts, size):
    """Pieces of each text are whole, in order, and lie in their sequences without gap or overlap."""
    by_text, by_sequence = {}, {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    assert by_text.keys() == texts.keys()
    for key, text in texts.items():
        ids = [*library(text or ""), 0]
        own = sorted(by_text[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // size)
        assert own[0].length == (len(ids) % size or size) and all(r.length == size for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_query(llm):
    rows = op11_pattern_packing(llm, SF).collect()
    texts = {r.doc_id: r.text for r in llm.read.parquet(f"{SF}/documents.parquet").collect()}
    check(rows, texts, 2048)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 2048) * 1.01 + 1


def test_odd_rows(llm, odd_texts, no_texts):
    from pyspark.sql import functions as F

    df = odd_texts.withColumn("doc_id", F.monotonically_increasing_id()).withColumn("piece", F.lit("x"))
    texts = {r.doc_id: r.text for r in df.collect()}
    found = packing.pack(packing.pieces(df, PATH, size=64), size=64)
    check(found.withColumn("ids_crc32", F.crc32("ids")).collect(), texts, 64)
    joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(found).collect()}
    for r in found.collect():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(packing.pieces(odd_texts, PATH), 2048).count() > odd_texts.count()  # repeated rows and null ids too
    assert packing.pack(packing.pieces(no_texts, PATH)).count() == 0

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rolefit.llm import alignment, tokens
from rolefit.llm.queries import op13_token_alignment
from tokenizers import Tokenizer

from .conftest import SF

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
MODEL_A, MODEL_B = open(PATHS[0], encoding="utf-8").read(), open(PATHS[1], "rb").read()
A = Tokenizer.from_str(MODEL_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_proto=MODEL_B)
BYTES_A = tokens.token_bytes(MODEL_A)
ALIGNER = alignment.Aligner(MODEL_A, MODEL_B)
ODD = "ab é\n\t\x0b\xa0 ▁<0x41>'st0ß🙂<s>​"


def bytes_b(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of(i)), i))
        at += len(of(i))
    return out


def plain(text):
    """(tokens of A, of B, groups, linked id pairs) by comparing every token with every other."""
    if not text:
        return [], [], [], Counter()
    whole = " " + text
    a, b = A.encode(whole, add_special_tokens=False).ids, B.encode(text)
    if any(b"".join(map(of, ids)) != whole.encode() for ids, of in ((a, BYTES_A.__getitem__), (b, bytes_b))):
        return [], [], [], Counter()
    at_a, at_b = spans(a, BYTES_A.__getitem__), spans(b, bytes_b)
    links = Counter((i, j) for s, e, i in at_a for u, v, j in at_b if s < v and u < e)
    groups, ends, low = [], sorted({e for _, e, _ in at_a} & {e for _, e, _ in at_b}), 0
    for high in ends:
        groups.append(([i for s, e, i in at_a if low <= s and e <= high], [i for s, e, i in at_b if low <= s and e <= high]))
        low = high
    return a, b, groups, links


def expected(texts):
    """The query's columns of each text."""
    found = [plain(t) for t in texts]
    total = sum((f[3] for f in found), Counter())
    highest = defaultdict(int)
    for (_, b), n in total.items():
        highest[b] = max(highest[b], n)
    out = []
    for a, b, groups, links in found:
        joined = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(n for p, n in links.items() if total[p] == highest[p[1]])
        out.append((len(a), len(b), len(groups), sum(links.values()), best, sum(n * total[p] for p, n in links.items()), hashlib.sha256(joined.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(ODD, max_size=50)), min_size=1, max_size=5))
def test_batches_like_plain_comparison(texts):
    found = ALIGNER.align(texts)
    for k, text in enumerate(texts):
        a, b, groups, links = plain(text)
        assert (found.n_a[k], found.n_b[k], found.n_groups[k], found.n_links[k]) == (len(a), len(b), len(groups), sum(links.values()))
        assert found.groups[k] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own = found.pair_doc == k
        assert {divmod(int(p), ALIGNER.size_b): int(n) for p, n in zip(found.pair[own], found.times[own])} == dict(links)


@settings(max_examples=100, deadline=None)
@given(st.text(ODD, max_size=80))
def test_pieces_in_stretches(text):
    cut = [s[1:] for s in alignment.stretches(" " + text, alignment.CUT_BLANKS, 5)]
    assert ALIGNER.b.cuts and [i for s in cut for i in B.encode(s)] == B.encode(text)


def aligned(df):
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return alignment.align(df, *PATHS, keep=("key",)).select("key", "n_a", "n_b", "n_groups", "n_links", "pairs", "times", digest)


def test_odd_rows_in_one_and_many_shards(llm, no_texts):
    texts = ["alpha beta", "alpha beta", None, "", " ", "naïve 😀", "a▁b", "the the the", "<|endoftext|> </s>", "x" * 300, "\n\n end\n"]
    df = llm.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "key int, text string, pairs string, n_a string").repartition(3)
    want = expected([t or "" for t in texts])
    for shard in (None, 7):
        got = {r.key: tuple(r[c] for c in COLUMNS) for r in alignment.scored(aligned(df), ALIGNER.size_b, shard).collect()}
        assert [got[k] for k in range(len(texts))] == want
    empty = alignment.scored(alignment.align(no_texts, *PATHS), ALIGNER.size_b)
    assert empty.count() == 0


def test_query(llm):
    rows = sorted(llm.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("text")).collect())
    assert len(rows) == 200
    import tempfile

    folder = tempfile.mkdtemp(prefix="llm-")
    llm.createDataFrame(rows).write.parquet(f"{folder}/documents.parquet")  # short texts: plain comparison is quadratic
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_token_alignment(llm, folder).collect()}
    assert [got[r.doc_id] for r in rows] == expected([r.text for r in rows])

"""Secrets in texts: three fixed patterns, and strings that a dictionary-primed compressor finds new.

Novelty of a candidate is the number of bytes it adds to the zstandard frame of the text before it, measured against a
random string of its length, when the compressor already knows the identifiers that stand in the corpus next to sensitive words. Words, names and paths are in the
dictionary or repeat their surroundings and add little; random strings add nearly a byte a character while they are short.
The literals of longer ones are Huffman-coded down to the entropy of their alphabet (half a byte for hex digits), so a long
string is also judged by its pieces, whose literals are left as they are; one new piece makes the whole string new.
zstandard only repeats whole stretches, so a name that the dictionary does not hold costs as much as a random string. The
dictionary also gives the letter pairs of known names: runs of letters whose pairs are likelier among them than all letters
alike read like names, and a string is only new if at most half of it does. So paths, host names and rare words are not
reported, and random strings are, whatever their alphabet. With an empty dictionary nothing reads like a name. Letters that
are themselves among the commonest identifier parts of the corpus (a secret in very many texts) are known, not new.

Null and empty texts hold no secrets. Columns of the same name as a result are replaced, all others pass through. Rows
are worked on one by one; an empty table gives an empty one (with an empty dictionary).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_new

# The base patterns, in order.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words whose neighbourhood is searched for new strings, and how far it reaches.
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api_?key|private_?key|credential|bearer|auth|akia", re.A | re.I)
REACH = 96
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
INSIDE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.~-")
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: The most characters of a piece of a long candidate.
PIECE = 32
#: The parts of identifiers that go to the dictionary: runs of letters, which random strings have short ones of.
PART = re.compile(r"[A-Za-z]{3,24}")
#: Runs of letters that may be names, with one capital at most or of capitals only, and the short number or separator after.
NAME = re.compile(r"([A-Z]?[a-z]{3,}|[A-Z]{4,})[^A-Za-z]{0,3}")

SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns. A run of hex digits is either long enough as a whole or dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def neighbourhoods(text: str) -> list[tuple[int, int]]:
    """Merged stretches around sensitive words."""
    out: list[tuple[int, int]] = []
    for m in SENSITIVE.finditer(text):
        low, high = max(0, m.start() - REACH), m.end() + REACH
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def may_hold(text: str) -> bool:
    """A quick test on fixed letters that every match of SENSITIVE or ASSIGN has."""
    low = text.lower()
    return any(w in low for w in ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth", "akia"))


class Names:
    """Letter pairs of known names: which runs of letters read like one."""

    def __init__(self, dictionary: bytes):
        counts = np.full((27, 26), 0.5)  # by the letter before (the last row: none) and the letter
        for part in PART.findall(dictionary.decode()):
            at = self._letters(part)
            np.add.at(counts, (at[:-1], at[1:]), 1)
        self.gain = np.log(counts / counts.sum(axis=1, keepdims=True) * 26)

    @staticmethod
    def _letters(run: str) -> np.ndarray:
        return np.frombuffer(b"{" + run.lower().encode(), np.uint8) - np.uint8(97)  # "{" follows "z"

    def known(self, string: str) -> int:
        """Characters of `string` in its runs, if these together read like names; each with the number or separator after it."""
        total, gain = 0, 0.0
        for m in NAME.finditer(string):
            at = self._letters(m[1])
            gain += self.gain[at[:-1], at[1:]].sum()
            total += len(m[0])
        return total if gain > 1e-9 else 0


class Novelty:
    """Marginal compressed bytes of a string after its surroundings."""

    def __init__(self, dictionary: bytes, level: int, share: float):
        known = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.frame = zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress
        # zstandard leaves literals as they are with this strategy and a target length.
        plain = zstandard.ZstdCompressionParameters.from_level(level, strategy=zstandard.STRATEGY_FAST, target_length=1, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain = zstandard.ZstdCompressor(dict_data=known, compression_params=plain).compress
        self.share = share
        self.names = Names(dictionary)
        self.draw, self.drawn = Random(0), b""

    def random(self, n: int) -> bytes:
        """A fixed random string of `n` characters."""
        if n > len(self.drawn):
            self.drawn += bytes(self.draw.choices(LETTERS, k=2 * n - len(self.drawn)))
        return self.drawn[:n]

    def marginal(self, around: str, candidate: str, frame) -> int:
        """Bytes that `candidate` adds, against a random string as long: a short frame alone may be left uncompressed."""
        before, n = around.encode(), len(candidate)
        return n + len(frame(before + candidate.encode())) - len(frame(before + self.random(n)))

    def new(self, around: str, string: str, frame) -> bool:
        n = len(string)
        return self.marginal(around, string, frame) >= self.share * n and 2 * self.names.known(string) <= n

    def novel(self, text: str, start: int, end: int) -> bool:
        if self.new(text[max(0, start - REACH) : start], text[start:end], self.frame):
            return True
        n = -(-(end - start) // PIECE)
        cuts = [start + (end - start) * k // n for k in range(n + 1)]
        return n > 1 and any(self.new(text[max(0, a - REACH) : a], text[a:b], self.plain) for a, b in zip(cuts[:-1], cuts[1:]))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        found, done = [], 0
        for low, high in neighbourhoods(text):
            # A string that the border of the stretch cuts belongs to it as a whole.
            if low < len(text) and text[low] in INSIDE:
                while low > done and text[low - 1] in INSIDE:
                    low -= 1
            high = min(len(text), high)
            if high < len(text) and text[high - 1] in INSIDE and (cut := RUN.match(text, high)):
                high = cut.end()
            for m in CANDIDATE.finditer(text, max(low, done), high):
                if self.novel(text, m.start(), m.end()):
                    found.append((m.start(), 3, m.end()))
            done = max(done, high)
        return found


def identifiers(df: DataFrame, text: str, at_most: int) -> bytes:
    """The commonest parts of identifiers around sensitive words, of the whole corpus, as a dictionary of bounded size."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for t in batch.column(0):
                t = t.as_py()
                if t and may_hold(t):
                    for low, high in neighbourhoods(t):
                        counts.update(PART.findall(t, low, high))
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    top = (
        df.select(F.col(text)).mapInArrow(counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        .orderBy(F.col("n").desc(), "word").limit(at_most).collect()
    )
    return " ".join(r["word"] for r in reversed(top)).encode()  # zstandard reaches the end of a dictionary most cheaply


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets", words: int = 2000, level: int = 3, share: float = 0.8) -> DataFrame:
    """`df` with `out`: spans (kind, start, end) by start, then kind; code points, end exclusive.

    `words` bounds the identifier dictionary; a string is new if it, or a piece of it, adds at least `share` bytes a
    character.
    """
    known = df.sparkSession.sparkContext.broadcast(identifiers(df, text, words))

    @F.arrow_udf(SPANS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(known.value, level, share)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            rows = []
            for t in texts:
                t = t.as_py() or ""
                if may_hold(t):
                    spans = sorted({*base_spans(t), *novelty.spans(t)})
                else:
                    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(t)]
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.array(rows, kind)

    return with_new(df, {out: found(F.col(text))})

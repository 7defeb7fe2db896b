"""Token ids of whole texts by distinct chunks: what a tokenizer never joins is encoded once and looked up afterwards.

A rule says where a tokenizer never makes a token across; texts are cut there, and each distinct chunk of a batch is
encoded once. The memory of the lookup is bounded by bytes, and a long text is cut in stretches, so a batch costs what
its stretch and its longest chunk need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: White space to all libraries, and characters that some of them count as such.
WHITE = r" \t-\r"
UNSURE = r"\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"

#: Chunks end between a visible character and white space. The split pattern of byte-level BPE never reaches over such a
#: place: a match holds white space in front of other characters only as its first blank, and judges it by what follows.
#: CHUNK matches the chunks of a text one after the other, CUT the two characters around such a place.
CHUNK = re.compile(rf"[{WHITE}{UNSURE}]*[^{WHITE}{UNSURE}]+(?:[{UNSURE}][{WHITE}{UNSURE}]*[^{WHITE}{UNSURE}]*)*|[{WHITE}{UNSURE}]+")
CUT = re.compile(rf"[^{WHITE}{UNSURE}][{WHITE}]")
#: Cuts before a run of blanks (or the sign for them) within a text, for vocabularies without a piece that holds a blank
#: after another character.
CUT_BLANKS = re.compile(r"[^ \u2581] +[^ \u2581]")

STRETCH = 1 << 20
#: Bytes that the lookup holds (twice this at most), with what an entry costs besides, and the longest entry in characters.
CACHE_BYTES, ENTRY, LONGEST = 16 << 20, 200, 64


def stretches(text: str, cut: re.Pattern, size: int | None = None) -> Iterator[str]:
    """Consecutive parts of `text` of at least `size` characters, cut after the first character of matches of `cut`."""
    start, size = 0, size or STRETCH
    while len(text) - start > size and (found := cut.search(text, start + size - 1)):
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:]


class Lookup:
    """Packed ids (little-endian unsigned 32-bit) of texts; `encode_many` gives those of distinct chunks."""

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = CACHE_BYTES):
        self.encode_many, self.limit = encode_many, limit
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _fill(self, distinct: set[str]) -> list[str]:
        if self.held > self.limit:
            self.old, self.now, self.held = self.now, {}, 0
        missing = []
        for chunk in [c for c in distinct if c not in self.now]:
            if (known := self.old.get(chunk)) is None:
                missing.append(chunk)
            else:
                self.now[chunk] = known
                self.held += len(known) + len(chunk) + ENTRY
        long = []
        for chunk, packed in zip(missing, self.encode_many(missing) if missing else ()):
            self.now[chunk] = packed
            if len(chunk) > LONGEST:
                long.append(chunk)
            else:
                self.held += len(packed) + len(chunk) + ENTRY
        return long

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            if len(text) > STRETCH:
                out += self._encode(group)
                out.append(b"".join(chain.from_iterable(self._encode([s]) for s in stretches(text, CUT))))
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size > STRETCH:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[bytes]:
        lists = list(map(CHUNK.findall, texts))
        long = self._fill(set(chain.from_iterable(lists)))
        get, join = self.now.__getitem__, b"".join
        packed = [join(map(get, chunks)) for chunks in lists]
        for chunk in long:
            del self.now[chunk]
        return packed


class Bytes:
    """The bytes of tokens by id, gathered for many ids at once."""

    def __init__(self, tokens: list[bytes | None]):
        filled = [t or b"" for t in tokens]
        self.lengths = np.array([len(t) for t in filled], np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths, dtype=np.int64)))[:-1].astype(np.int32)
        self.flat = np.frombuffer(b"".join(filled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        places = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        places += np.arange(len(places))
        return self.flat[places]

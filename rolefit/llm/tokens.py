"""Token ids by a byte-level BPE vocabulary file of the `tokenizers` library, with the bytes of its tokens."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from .chunks import CUT, stretches


def alphabet() -> dict[str, int]:
    """The characters that stand for bytes in such files: visible Latin-1 ones for themselves, the next free ones else."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def token_bytes(model: str) -> list[bytes | None]:
    """Bytes of every id of the vocabulary file with this text; None for numbers that are no ids."""
    vocabulary, letters = json.loads(model)["model"]["vocab"], alphabet()
    out: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
    for token, number in vocabulary.items():
        out[number] = bytes(letters[c] for c in token)
    return out


def ranked(model: str) -> bool:
    """Whether the ids above the single bytes follow the order of the merges, so that an id is also its merge's rank."""
    read = json.loads(model)
    vocabulary, merges = read["model"]["vocab"], read["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    plain = read.get("normalizer") is None and read["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return plain and len(vocabulary) == len(pairs) + 256 and all(vocabulary.get(a + b) == 256 + k for k, (a, b) in enumerate(pairs))


def encoder(model: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids (unsigned 32-bit) of texts, as the `tokenizers` library gives them with ordinary text only.

    A file whose ids are ranks is run by `tiktoken`, which gives the same ids about five times as fast. Long texts are
    cut where no token crosses.
    """
    if ranked(model):
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(token_bytes(model)) if t}, special_tokens={})
        ids_of = own.encode_ordinary
    else:
        library = Tokenizer.from_str(model)
        library.encode_special_tokens = True
        ids_of = lambda text: library.encode(text, add_special_tokens=False).ids

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.concatenate([np.array(ids_of(s), np.uint32) for s in stretches(t, CUT)]) for t in texts]

    return encode

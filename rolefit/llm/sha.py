"""SHA-256 states of many messages at once, as numpy columns.

A digest in hexadecimal text is exactly one block of 64 bytes, so a parent that hashes its children's texts stands at a
block border before each child. Such a state is eight words: it can be kept in a table and resumed by any task.
"""

from __future__ import annotations

from math import isqrt

import numpy as np

#: Rows that are worked on at once, so that the schedule stays in the cache.
ROWS = 4096


def _cube_root(n: int) -> int:
    low, high = 0, 1 << (n.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid**3 <= n else (low, mid - 1)
    return low


_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))][:64]
#: The standard's constants: fractional parts of the roots of the first primes.
ROUND = [np.uint32(_cube_root(p << 96) & 0xFFFFFFFF) for p in _PRIMES]
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _PRIMES[:8]], np.uint32)

_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    w = np.empty((64, blocks.shape[1]), np.uint32)
    w[:16] = blocks
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + (_turn(a, 7) ^ _turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (_turn(b, 17) ^ _turn(b, 19) ^ (b >> np.uint32(10)))
    a, b, c, d, e, f, g, h = states
    for t in range(64):
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g))) + (w[t] + ROUND[t])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return states + np.stack([a, b, c, d, e, f, g, h])


def absorb(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n, 8) after one more block (n, 64 bytes) each."""
    out = np.empty_like(states)
    for i in range(0, len(states), ROWS):
        words = np.ascontiguousarray(blocks[i : i + ROWS]).view(">u4").astype(np.uint32).T
        out[i : i + ROWS] = _absorb(states[i : i + ROWS].T, words).T
    return out


def texts(digests: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) as hexadecimal texts (n, 64 bytes)."""
    return _HEX[digests].reshape(len(digests), 64)


def start(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages that end here, after `blocks` blocks (a number for each row)."""
    last = np.zeros((len(states), 64), np.uint8)
    last[:, 0] = 128
    last[:, 56:] = (blocks.astype(np.uint64) * np.uint64(512)).astype(">u8")[:, None].view(np.uint8)
    return absorb(states, last).astype(">u4").view(np.uint8).reshape(-1, 32)

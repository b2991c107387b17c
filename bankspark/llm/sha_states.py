"""SHA-256 over arrays of messages, as states that can be kept, copied and resumed.

Messages here are runs of hex digests. A hex digest is 64 bytes, one block of the hash, so the state before any
digest of a run is eight 32-bit numbers with nothing pending.
"""

from __future__ import annotations

import numpy as np


def _root(n: int, k: int) -> int:
    """The k-th root of n, rounded down."""
    low, high = 0, 1 << (n.bit_length() // k + 1)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**k <= n else (low, middle - 1)
    return low


_PRIMES = [n for n in range(2, 312) if all(n % d for d in range(2, n))]
_MASK = (1 << 32) - 1
# Defined by the standard: the first 32 bits after the point of the roots of the first primes.
START = np.array([_root(p << 64, 2) & _MASK for p in _PRIMES[:8]], np.uint32)
_ROUNDS = np.array([_root(p << 96, 3) & _MASK for p in _PRIMES], np.uint32)
_HEX = np.array([int.from_bytes(b"%04x" % n, "big") for n in range(1 << 16)], np.uint32)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def resumed(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one more block (n, 16) each."""
    words = [np.ascontiguousarray(w) for w in block.T]
    a, b, c, d, e, f, g, h = (np.ascontiguousarray(s) for s in state.T)
    for t in range(64):
        if t >= 16:
            x, y = words[1], words[14]
            words.append(words[0] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + words[9]
                         + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
            del words[0]
        word = words[t] if t < 16 else words[15]
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUNDS[t] + word
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return np.stack([a, b, c, d, e, f, g, h], 1) + state


def written(digest: np.ndarray) -> np.ndarray:
    """The block (n, 16) that the hex form of each digest (n, 8) fills."""
    out = np.empty((len(digest), 16), np.uint32)
    out[:, 0::2], out[:, 1::2] = _HEX[digest >> np.uint32(16)], _HEX[digest & np.uint32(0xFFFF)]
    return out


def ended(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 8) of messages of so many whole blocks, from their states."""
    last = np.zeros((len(state), 16), np.uint32)
    last[:, 0], last[:, 15] = 1 << 31, 512 * blocks
    return resumed(state, last)


def started(n: int) -> np.ndarray:
    return np.repeat(START[None, :], n, axis=0)


def numbers(digests: list[bytes]) -> np.ndarray:
    """Digests of 32 bytes as (n, 8) numbers."""
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 8).astype(np.uint32)


def as_bytes(digest: np.ndarray) -> list[bytes]:
    raw = digest.astype(">u4").tobytes()
    return [raw[k : k + 32] for k in range(0, len(raw), 32)]

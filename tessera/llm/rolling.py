"""Vectorised Rabin-Karp hashes of words, word windows and byte windows.

A word's hash is a polynomial in its bytes over 64-bit words, each byte mapped to a fixed random
number first, then mixed. A window's hash is a polynomial in its words' hashes. Both come from
running sums, so each costs a few array operations however long the window is. The base is odd and
so has an inverse, which takes a sum from any place to the first.
"""

from __future__ import annotations

import numpy as np

from tessera.llm.common import ship

U = np.uint64
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes that are hashed at once; the arrays for them take some 60 times as much.
PIECE = 1 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACES = b"\t\n\x0b\x0c\r "


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (public splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTES = mix(np.arange(1, 257, dtype=U) * U(BASE))
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


class Powers(dict):
    """Powers by base; it travels to executors empty."""

    def __reduce__(self):
        return Powers, ()


_powers = Powers()


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[base] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers[base][0][:n], _powers[base][1][:n]


def windows(values: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """Mixed hash of every run of ``size`` values."""
    n = len(values)
    if n < size:
        return np.zeros(0, U)
    up, down = powers(base, n)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * up, dtype=U, out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * down[: n - size + 1])


def _piece_words(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    space = np.ones(len(codes) + 2, bool)
    space[1:-1] = IS_SPACE[codes]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    up, down = powers(BASE, len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum(BYTES[codes] * up[:-1], dtype=U, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def _cut(data: bytes) -> list[bytes]:
    """Pieces of a long text, cut at white space where there is any within reach."""
    out, at = [], 0
    while len(data) - at > PIECE:
        near = max(data.rfind(s, at, at + PIECE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if near <= at:  # one word longer than a piece: up to its end
            ends = [e for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (e := data.find(s, at + PIECE)) >= 0]
            near = min(ends, default=len(data))
        out.append(data[at:near])
        at = near
    return [*out, data[at:]]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and where each text's words begin (one more entry than texts)."""
    hashes, counts = [], []
    group: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            data = b" ".join(group)
            hashes.append(_piece_words(data))
            # words before each text's first byte: counted by the starts of words in the joined data
            space = np.ones(len(data) + 1, bool)
            space[1:] = IS_SPACE[np.frombuffer(data, np.uint8)]
            before = np.zeros(len(data) + 1, np.int64)
            np.cumsum(space[:-1] & ~space[1:], out=before[1:])
            at = np.cumsum([0] + [len(t) + 1 for t in group])
            counts.extend(before[np.minimum(at[1:] - 1, len(data))] - before[at[:-1]])
            group, size = [], 0

    for text in texts:
        if len(text) > PIECE:
            flush()
            parts = [_piece_words(p) for p in _cut(text)]
            hashes.extend(parts)
            counts.append(sum(map(len, parts)))
            continue
        if size + len(text) > PIECE:
            flush()
        group.append(text)
        size += len(text) + 1
    flush()
    return np.concatenate(hashes) if hashes else np.zeros(0, U), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


ship(__name__)

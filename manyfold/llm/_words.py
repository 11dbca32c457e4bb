"""Hashes of all words of many texts at once, in numpy: no Python code runs per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_P = U(0x9E3779B97F4A7C15)

#: ASCII white space only, and every ASCII character that is neither letter nor digit.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray, kind: int = 1) -> np.ndarray:
    """A hash of two hashes in order; kinds don't meet."""
    return mix(a * U(0xD6E8FEB86659FD93) + mix(b + U(kind) * _P))


class Words:
    """The words of some texts: hash (64 bits), starts and ends in data, counts (words of each text)."""

    def __init__(self, texts: list[str | None], breaks: np.ndarray = SPACES):
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        self.raw = b"\n".join(parts) + b"\n" if parts else b""
        self.lower = self.raw.lower()
        self.data = np.frombuffer(self.lower, dtype=np.uint8)
        inside = ~breaks[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        self.starts, self.ends = edge[::2], edge[1::2]
        size = self.ends - self.starts
        at = np.flatnonzero(inside)
        first = np.cumsum(size) - size
        longest = int(size.max(initial=1))
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(longest, _P | U(1), dtype=U))
            value = (self.data[at].astype(U) + U(1)) * power[np.arange(len(at)) - np.repeat(first, size)]
            self.hash = mix(np.add.reduceat(value, first) + size.astype(U) * U(0xC2B2AE3D27D4EB4F)) if len(first) else np.zeros(0, dtype=U)
        self.size = size
        self.text_ends = np.cumsum([len(p) + 1 for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
        self.word_ends = np.searchsorted(self.starts, self.text_ends)
        self.counts = np.diff(np.concatenate(([0], self.word_ends)))
        self.text = np.repeat(np.arange(len(parts)), self.counts)


def chunks(texts: list[str | None], most: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of ``texts`` of about ``most`` characters; a longer text is alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > first and size + n > most:
            yield slice(first, i)
            first, size = i, 0
        size += n
    if first < len(texts):
        yield slice(first, len(texts))

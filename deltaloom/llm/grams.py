"""Hashed byte n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MIX = np.uint32(0x9E3779B1)


class Bytes:
    """Texts laid end to end, with the bounds of each."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.starts = np.r_[0, self.ends[:-1]] if texts else self.ends

    def hashed(self, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each order n the bucket of the n-gram at every byte; the last n - 1 of each text reach into the next and must be left out."""
        data = self.data.astype(np.uint32)
        code = data.copy()
        for n in range(1, max(orders) + 1):
            if n > 1:
                if data.size < n:
                    return
                code = code[:-1] * np.uint32(257) + data[n - 1 :]
            if n in orders:
                h = (code ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * MIX
                yield n, (h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits)

    def inside(self, n: int) -> np.ndarray:
        """Which places start an n-gram that lies in one text."""
        ok = np.ones(max(0, self.data.size - n + 1), bool)
        for back in range(1, n):
            at = self.ends - back
            ok[at[(at >= self.starts) & (at >= 0) & (at < ok.size)]] = False
        return ok

    def sums(self, values: np.ndarray, n: int) -> np.ndarray:
        """Sum of integer ``values`` over each text's n-grams."""
        total = np.r_[0, np.cumsum(values, dtype=np.int64)]
        last = np.minimum(np.maximum(self.ends - n + 1, self.starts), values.size)
        return np.where(last > self.starts, total[last] - total[np.minimum(self.starts, values.size)], 0)

    def numbers(self, n: int) -> np.ndarray:
        """How many n-grams each text has."""
        return np.maximum(0, self.ends - self.starts - n + 1)

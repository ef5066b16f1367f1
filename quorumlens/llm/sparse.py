"""Hashed sparse features and what the numpy classifiers share."""

from __future__ import annotations

import zlib

import numpy as np

REMEMBERED = 200_000


class Hashed(dict):
    """The bucket of each word, by CRC-32, made when first asked for; bounded."""

    def __init__(self, bits: int):
        super().__init__()
        self.mask = (1 << bits) - 1

    def bucket(self, word: str) -> int:
        return zlib.crc32(word.encode("utf-8", "surrogatepass")) & self.mask

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self.bucket(word)
        if len(word) <= 64:
            self[word] = bucket
        return bucket


class Rows:
    """Sparse rows: indexes and values, concatenated, and where each row starts."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        self.index = np.concatenate([i for i, _ in rows]).astype(np.int64) if rows else np.empty(0, np.int64)
        self.value = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.empty(0)
        self.n = len(rows)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """index, value and row number (0, 1, ...) of some rows."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[rows], sizes)
        return self.index[at], self.value[at], np.repeat(np.arange(len(rows)), sizes)

    def only(self, used: np.ndarray) -> Rows:
        """The rows with the features that ``used`` marks."""
        keep, out = used[self.index], Rows([])
        out.n, out.index, out.value = self.n, self.index[keep], self.value[keep]
        out.starts = np.concatenate([[0], np.cumsum(keep)])[self.starts]
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def pack(index: np.ndarray, value: np.ndarray) -> bytes:
    """A sparse row as bytes: uint32 indexes, then float32 values."""
    return index.astype("<u4").tobytes() + value.astype("<f4").tobytes()


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    half = len(data) // 2
    return np.frombuffer(data[:half], "<u4"), np.frombuffer(data[half:], "<f4")

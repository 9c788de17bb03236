"""Words of texts as 64-bit names, on the executors."""

from __future__ import annotations

import numpy as np


class Names(dict):
    """Word (bytes) -> 64-bit name, remembered for a bounded number of words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks, which is what bytes.split() parts at."""
    return b"" .split() if text is None else text.encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(names: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` names."""
    n = len(names) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += names[k : k + n]
    return mix(out)


def pack(values: np.ndarray) -> bytes:
    """Sorted values as differences, which compress well."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u8"), dtype=np.uint64)

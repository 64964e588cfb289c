"""Words of a text and hashes of word runs, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a worker remembers the hash of; working one out again is cheap.
MEMORY = 100_000
#: An odd multiplier for polynomial hashes, and two for mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hashes of words, worked out at first sight."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Runs of characters other than space and 0x09-0x0D; `lower` turns A-Z to a-z."""
    data = text.encode()
    return (data.lower() if lower else data).split()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of `length` neighbouring words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, power = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(length):
            out += hashes[j : j + n] * power
            power = power * BASE
        return mixed(out + np.uint64(length))

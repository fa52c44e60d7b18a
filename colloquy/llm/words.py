"""Words of a text: maximal runs of Unicode letters and digits, lower case."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class WordHashes:
    """64-bit hashes of words, remembered per worker; the memory is emptied when full."""

    def __init__(self, room: int = 400_000) -> None:
        self.room, self.known = room, {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(known) > self.room:
                known.clear()
            for token in set(tokens):
                if token not in known:
                    known[token] = xxhash.xxh3_64_intdigest(token)
            return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) that spreads sums of products over all bits."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return values ^ (values >> np.uint64(32))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            total = total * np.uint64(0x100000001B3) + hashes[k : k + count]
    return mix(total)

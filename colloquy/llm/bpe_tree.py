"""Byte-level BPE encoding of a corpus as a tree reduction (problem 8).

A text is halved down to leaves, the leaves are encoded, and neighbouring
results are joined: a window around the seam is encoded again and replaces the
tokens there. The window grows until both of its ends are *stable cuts*. A
stable cut is a place where the pre-tokenizer ends a piece whatever surrounds
it: between a non-space and a space character, between a digit and anything
else, or between an ASCII letter and an ASCII non-letter. No merge crosses such
a place, so the tokens outside the window are those of the whole text. If no
stable cut exists the window reaches the end of the node, that is the node is
encoded whole. Joining is associative, hence a monoid; decoding concatenates
the bytes of the tokens.

NULL and empty texts give an empty list; blank texts are encoded as they are;
strings of special tokens are plain text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.session import spread

TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizer's pattern, which belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF_BYTES = 1 << 10
VOCABULARY_LIMIT = 32 << 20

_SPACE, _DIGIT, _LETTER, _MARK, _OTHER, _WORDISH = 0, 1, 2, 3, 4, 5


def _classes() -> np.ndarray:
    """Class of every byte; bytes of multi-byte characters get a class of their own."""
    kinds = np.full(256, _OTHER, np.uint8)
    for byte in range(128):
        char = chr(byte)
        if char in " \t\n\r":
            kinds[byte] = _SPACE
        elif char.isdigit():
            kinds[byte] = _DIGIT
        elif char.isalpha():
            kinds[byte] = _LETTER
        elif char.isprintable():
            kinds[byte] = _MARK
    return kinds


_CLASS = _classes()


def stable_cuts(raw: np.ndarray) -> np.ndarray:
    """For each place between two bytes (index of the right one), whether it is a stable cut.

    Only pairs of ASCII bytes are judged, except before an ASCII space, where a
    left byte of a longer character counts if that character is no space; the
    spaces outside ASCII end in the bytes below, which are left out wholesale.
    """
    kind = _CLASS[raw]
    left, right = kind[:-1], kind[1:]
    tail = raw[:-1]
    odd_space = (tail == 0x85) | (tail == 0xA0) | ((tail >= 0x80) & (tail <= 0x8B)) | (tail == 0xA8) | (tail == 0xA9) | (tail == 0xAF) | (tail == 0x9F)
    solid = (left == _DIGIT) | (left == _LETTER) | (left == _MARK) | ((tail >= 0x80) & ~odd_space)
    cut = solid & (right == _SPACE)
    cut |= (left == _DIGIT) & ((right == _LETTER) | (right == _MARK))
    cut |= (left == _LETTER) & ((right == _DIGIT) | (right == _MARK))
    return np.concatenate([[False], cut])


class TreeEncoder:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, leaf_bytes: int = LEAF_BYTES) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.base = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.length_of = np.array([len(x) for x in self.bytes_of], np.int64)
        self.leaf_bytes = leaf_bytes

    def plain(self, raw: bytes) -> np.ndarray:
        return np.array(self.base.encode_ordinary(raw.decode("utf-8")), np.int32)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        raw = text.encode("utf-8", "replace")
        if len(raw) <= self.leaf_bytes:
            return self.plain(raw)
        view = np.frombuffer(raw, np.uint8)
        return self._node(raw, view, np.flatnonzero(stable_cuts(view)), 0, len(raw))

    def _node(self, raw: bytes, view: np.ndarray, cuts: np.ndarray, low: int, high: int) -> np.ndarray:
        if high - low <= self.leaf_bytes:
            return self.plain(raw[low:high])
        middle = (low + high) // 2
        while view[middle] & 0xC0 == 0x80:  # never inside a character
            middle += 1
        left = self._node(raw, view, cuts, low, middle)
        right = self._node(raw, view, cuts, middle, high)
        return self._join(raw, cuts, left, right, low, middle, high)

    def _join(self, raw: bytes, cuts: np.ndarray, left: np.ndarray, right: np.ndarray, low: int, middle: int, high: int) -> np.ndarray:
        # A cut is judged from the bytes on both its sides, which must lie in the same half.
        width = 16
        while True:
            a = np.searchsorted(cuts, max(low + 1, middle - width), "left")
            b = np.searchsorted(cuts, min(high - 1, middle + width), "right") - 1
            start = int(cuts[a]) if a < len(cuts) and cuts[a] < middle else None
            end = int(cuts[b]) if b >= 0 and cuts[b] > middle else None
            whole_left, whole_right = middle - width <= low, middle + width >= high
            if (start is not None or whole_left) and (end is not None or whole_right):
                break
            width *= 2
        start, end = low if start is None else start, high if end is None else end
        head = np.searchsorted(np.cumsum(self.length_of[left]), start - low, "right") if start > low else 0
        tail = np.searchsorted(np.cumsum(self.length_of[right]), end - middle, "left") + 1 if end < high else len(right)
        return np.concatenate([left[:head], self.plain(raw[start:end]), right[tail:]])

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")


_ENCODERS: dict[int, TreeEncoder] = {}


def encoder(vocabulary: bytes) -> TreeEncoder:
    """The encoder of a vocabulary, built once per worker."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS[key] = TreeEncoder(vocabulary)
    return _ENCODERS[key]


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, whose size is checked since every worker gets a copy."""
    if os.path.getsize(path) > VOCABULARY_LIMIT:
        raise ValueError(f"{path} is larger than a vocabulary of a public tokenizer")
    with open(path, "rb") as file:
        return file.read()


def encode_documents(documents: DataFrame, vocabulary_path: str = VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; no shuffle beyond spreading a tiny input."""
    shared = documents.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.encode(x) for x in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["key", "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)

"""Batches of texts as hashed words, and what similarity operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.words import WordHashes, mix, words

BATCH = 512


def conversation_text(messages: str = "messages") -> Column:
    """Contents of all messages but system ones, in order, one per line; NULL parts count as empty."""
    spoken = F.filter(F.col(messages), lambda m: m.isNotNull() & (F.coalesce(m["role"], F.lit("")) != "system"))
    return F.array_join(F.transform(spoken, lambda m: F.coalesce(m["content"], F.lit(""))), "\n")


class Batch:
    """The words of some texts in one array; ``start`` has the first word of each text and the end."""

    def __init__(self, texts: list[str | None], hashes: WordHashes) -> None:
        arrays = [hashes(words(t)) for t in texts]
        self.arrays = arrays
        self.start = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)
        self.flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
        self.text_of = np.repeat(np.arange(len(arrays)), np.diff(self.start))

    @classmethod
    def of_hashes(cls, flat: np.ndarray, sizes: np.ndarray) -> Batch:
        """A batch of texts that are hashed already."""
        own = cls.__new__(cls)
        own.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        own.arrays, own.flat = np.split(flat, own.start[1:-1]), flat
        own.text_of = np.repeat(np.arange(len(sizes)), sizes)
        return own

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of words within a text, and the first word of each."""
        count = len(self.flat) - length + 1
        if count <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        inside = np.flatnonzero(self.text_of[:count] == self.text_of[length - 1 :])
        total = np.zeros(count, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(length):
                total = total * np.uint64(0x100000001B3) + self.flat[k : k + count]
        return mix(total[inside]), inside

    def distinct_runs(self, length: int) -> np.ndarray:
        """Number of distinct runs of words of each text."""
        runs, first = self.runs(length)
        marked = (self.text_of[first].astype(np.uint64) << np.uint64(54)) | (runs >> np.uint64(10))
        return np.bincount((np.unique(marked) >> np.uint64(54)).astype(np.int64), minlength=len(self.arrays))


def batches_of(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def arrow_rows(columns: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


class KeyBitmap:
    """A bitmap of fixed size over the hashes of keys, made by Spark and sent to every worker.

    It only skips rows whose key is surely not among the keys; the rest is
    settled by joins. Its size bound is ``2**bits / 8`` bytes.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 26) -> None:
        place = F.pmod(F.col(column), F.lit(1 << bits)) + 1
        rows = (
            keys.select(place.alias("place"))
            .groupBy(F.bitmap_bucket_number("place").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
            .toLocalIterator()
        )
        self.mask = (1 << bits) - 1
        self.bytes = np.zeros((1 << bits) // 8, np.uint8)
        for row in rows:
            low = (row["bucket"] - 1) * 4096
            self.bytes[low : low + 4096] = np.frombuffer(row["bits"], np.uint8)

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        place = keys.astype(np.int64) & self.mask
        return (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sorted_groups(batches: Iterator[pa.RecordBatch], hold: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Column arrays of whole groups from rows sorted by their first column, and whether they are hot.

    A chunk that isn't hot has groups of at most ``hold`` rows, all complete. A
    group of more rows comes alone, in pieces marked hot, so that no task ever
    holds it.
    """
    carry: list[list[np.ndarray]] = []  # the rows of the last, maybe unfinished group
    held, hot = 0, None

    def joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*parts)]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if carry or hot is not None:
            current = carry[0][0][0] if carry else hot
            more = int(np.searchsorted(columns[0], current, "right"))
            if more:
                carry.append([c[:more] for c in columns])
                held += more
            if held > hold or hot is not None:
                if carry:
                    yield joined(carry), True
                carry, held, hot = [], 0, current
            columns = [c[more:] for c in columns]
            if not len(columns[0]):
                continue
            if carry:
                yield joined(carry), False
            carry, held, hot = [], 0, None
        edges = np.flatnonzero(np.concatenate([[True], columns[0][1:] != columns[0][:-1]]))
        sizes = np.diff(np.concatenate([edges, [len(columns[0])]]))
        large = (sizes > hold)[:-1]
        for k in np.flatnonzero(large):
            yield [c[edges[k] : edges[k + 1]] for c in columns], True
        rows = np.ones(int(edges[-1]), bool) if not large.any() else ~np.repeat(large, sizes[:-1])
        if rows.any():
            yield [c[: edges[-1]][rows] for c in columns], False
        carry, held = [[c[edges[-1] :] for c in columns]], int(sizes[-1])
    if carry:
        yield joined(carry), held > hold

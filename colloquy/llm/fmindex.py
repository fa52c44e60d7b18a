"""Evaluation passages inside corpus documents, by an FM-index per shard (problem 9).

Each task joins the words of its documents into shards of bounded size. A shard
gets a suffix array (prefix doubling), its Burrows-Wheeler transform in a
wavelet matrix, and suffix positions sampled every few words. All distinct runs
of ``run`` words of the test items are searched backwards together, one word
per step, as vectors of intervals; a word unknown to the shard ends its phrases
at once. Occurrences are located by stepping back to a sampled position, mapped
to documents, and neighbouring ones are merged to removal spans.

The items are few and fixed; they are still handled in blocks of at most
``ITEM_WORDS`` words, so what is sent to the executors is bounded.

NULL, empty and blank texts match nothing, nor do items of fewer than ``run``
words. Repeated rows of documents are reported under each of their ids, items
with equal passages each by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.words import WORD, WordHashes, words
from colloquy.session import spread

RUN = 16
SHARD_WORDS, SAMPLE_EVERY, ITEM_WORDS = 1 << 19, 16, 1 << 21


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the sorted prefix length."""
    size = len(symbols)
    rank, width = symbols.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        following = np.zeros(size, np.int64)
        following[: size - width] = rank[width:] + 1 if width < size else 0
        keys = rank * (size + 2) + following
        order = np.argsort(keys)
        ordered = keys[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(size, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == size - 1 or width >= size:
            return order


class WaveletMatrix:
    """Rank over a sequence of small integers, a bit level at a time, for vectors of questions."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.ones: list[np.ndarray] = []
        current = values
        for level in reversed(range(self.levels)):
            bits = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each end."""
        low, high = np.zeros_like(ends), ends.copy()
        for level, ones in zip(reversed(range(self.levels)), self.ones):
            one = (symbols >> level) & 1 == 1
            zeros = len(ones) - 1 - int(ones[-1])
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low


class FMIndex:
    """FM-index over a sequence of symbols; 0 separates documents and never occurs in a phrase."""

    def __init__(self, symbols: np.ndarray) -> None:
        # A symbol below all others ends the sequence, so that stepping back is well defined.
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = suffix_array(text)
        self.transform = text[order - 1]
        self.wavelet = WaveletMatrix(self.transform)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        # Only the sampled rows are kept, in order, each with its place in the text.
        self.sampled = np.flatnonzero(order % SAMPLE_EVERY == 0).astype(np.int32)
        self.places = order[self.sampled].astype(np.int32)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals [low, high) of suffixes that start with each phrase (one per row, 0 for unknown words)."""
        count, length = phrases.shape
        low, high = np.zeros(count, np.int64), np.full(count, len(self.transform), np.int64)
        alive = np.flatnonzero((phrases > 0).all(axis=1))
        high[np.setdiff1d(np.arange(count), alive)] = 0
        for step in reversed(range(length)):
            symbol = phrases[alive, step] + 1
            low[alive] = self.first[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.first[symbol] + self.wavelet.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        rows, steps, found = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            at = np.minimum(np.searchsorted(self.sampled, rows[open_]), len(self.sampled) - 1)
            known = self.sampled[at] == rows[open_]
            found[open_[known]] = self.places[at[known]] + steps[open_[known]]
            open_ = open_[~known]
            symbol = self.transform[rows[open_]]
            rows[open_] = self.first[symbol] + self.wavelet.rank(symbol, rows[open_])
            steps[open_] += 1
        return found


class Phrases:
    """The distinct runs of words of a block of items, and which items have each."""

    def __init__(self, items: list[tuple[int, str]], run: int) -> None:
        hashes, owners, grams = WordHashes(), [], []
        for item, text in items:
            own = hashes(words(text))
            if len(own) >= run:
                grams.append(np.lib.stride_tricks.sliding_window_view(own, run))
                owners.append(np.full(len(own) - run + 1, item, np.int64))
        stacked = np.concatenate(grams) if grams else np.empty((0, run), np.uint64)
        self.grams, back = np.unique(stacked, axis=0, return_inverse=True)
        back = back.reshape(-1)
        pairs = np.unique(np.stack([back, np.concatenate(owners) if owners else np.empty(0, np.int64)], axis=1), axis=0)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(self.grams) + 1))
        self.owner = pairs[:, 1]


def search_shard(keys: list, hashed: list[np.ndarray], phrases: Phrases) -> list[tuple[object, int, int, int]]:
    """(key, item, first word, last word exclusive) of the merged occurrences in one shard."""
    run = phrases.grams.shape[1]
    lengths = np.array([len(x) for x in hashed])
    vocabulary, symbols = np.unique(np.concatenate(hashed), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(starts[-1], np.int64)
    at = np.arange(len(symbols)) + np.repeat(np.arange(len(lengths)), lengths)
    text[at] = symbols + 1
    place = np.searchsorted(vocabulary, phrases.grams)
    known = vocabulary[np.minimum(place, len(vocabulary) - 1)] == phrases.grams
    wanted = np.where(known, place + 1, 0)
    if not known.all(axis=1).any():
        return []
    index = FMIndex(text)
    low, high = index.search(wanted)
    count = high - low
    rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    gram = np.repeat(np.arange(len(low)), count)
    position = index.locate(rows)
    document = np.searchsorted(starts, position, "right") - 1
    owners = phrases.owner_start[gram + 1] - phrases.owner_start[gram]
    spot = np.repeat(np.arange(len(gram)), owners)
    item = phrases.owner[np.repeat(phrases.owner_start[gram], owners) + np.arange(owners.sum()) - np.repeat(np.cumsum(owners) - owners, owners)]
    found = pd.DataFrame({"d": document[spot], "i": item, "w": (position - starts[document])[spot]}).sort_values(["d", "i", "w"])
    if found.empty:
        return []
    fresh = (found.d != found.d.shift()) | (found.i != found.i.shift()) | (found.w > found.w.shift() + run)
    spans = found.groupby(fresh.cumsum()).agg(d=("d", "first"), i=("i", "first"), low=("w", "min"), high=("w", "max"))
    return [(keys[d], int(i), int(a), int(b) + run) for d, i, a, b in spans.itertuples(index=False)]


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Removal spans: ``key``, ``item_key``, and the place of each shared passage in words and characters."""
    spark = documents.sparkSession
    own = items.select(F.col(item_key).cast("bigint").alias("item"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * ITEM_WORDS)))
    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, item bigint, first_word bigint, end_word bigint, start_char bigint, end_char bigint"
    source = spread(documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()))
    found = None
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast(Phrases([(r.item, r.text) for r in rows], run))

        def run_shard(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            hashes = WordHashes()

            def flush(keys: list, texts: list, hashed: list) -> pd.DataFrame:
                text_of = dict(zip(range(len(keys)), texts))
                out = []
                for d, item, low, high in search_shard(list(range(len(keys))), hashed, shared.value):
                    spots = [m.span() for m in WORD.finditer(text_of[d])]
                    # Lower case may change the number of characters or words; then only the words' places are exact.
                    exact = len(spots) == len(hashed[d])
                    out.append((keys[d], item, low, high, spots[low][0] if exact else None, spots[high - 1][1] if exact else None))
                return pd.DataFrame(out, columns=["key", "item", "first_word", "end_word", "start_char", "end_char"]).astype({"start_char": "Int64", "end_char": "Int64"})

            keys, texts, hashed, size = [], [], [], 0
            for frame in frames:
                for one, value in zip(frame["key"], frame["text"]):
                    own_hashes = hashes(words(value))
                    if len(own_hashes) < run:
                        continue
                    keys.append(one)
                    texts.append(value)
                    hashed.append(own_hashes)
                    size += len(own_hashes) + 1
                    if size >= SHARD_WORDS:
                        yield flush(keys, texts, hashed)
                        keys, texts, hashed, size = [], [], [], 0
            if keys:
                yield flush(keys, texts, hashed)

        part = source.mapInPandas(run_shard, schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def leaked_pairs(documents: DataFrame, items: DataFrame, run: int = RUN, **names: str) -> DataFrame:
    """Distinct (document, item) pairs with a shared passage."""
    return leaked_passages(documents, items, run, **names).select(names.get("key", "doc_id"), names.get("item_key", "item_id")).distinct()


def removal_spans(passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passages of all items merged to disjoint spans of words per document."""
    order = Window.partitionBy(key).orderBy("first_word", "end_word")
    reach = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = passages.withColumn("fresh", F.when(reach >= F.col("first_word"), 0).otherwise(1))
    numbered = marked.withColumn("span_idx", F.sum("fresh").over(order))
    return numbered.groupBy(key, "span_idx").agg(
        F.min("first_word").alias("first_word"), F.max("end_word").alias("end_word"),
        F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"),
    )

"""Exact and near duplicates, clusters, the record kept of each, and overlaps across splits.

Near duplicates are found without loss: of each set of word shingles, in an
order that puts rare ones first, two sets of n and m that share o or more (o from n, m
and the similarity) share k of their first ``n - o + k`` and ``m - o + k``, for any k up to o.
Only these beginnings are stored and joined; pairs that meet so often are compared by
parity sketches, which bound the difference from below, and the rest on the whole sets,
made anew from the texts of these pairs. Copies are collapsed, so a text repeated in a
third of the rows counts once; common shingles come last in the order and drop out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.graph import components
from colloquy.session import durable, freeing, spread

SHINGLE, SIMILARITY = 5, 0.85
#: Frequencies of shingles are counted in one of ``SAMPLE`` sets and kept of so many shingles.
SAMPLE, FREQUENT = 8, 1 << 20
#: Shingles that two beginnings have to share, and one more for so many shingles of the smaller set; 64-bit words of a
#: sketch; bits of the table of wanted keys, a power of 2; texts of a block. They decide the cost only.
MET, MORE, WORDS, WANTED, BLOCK = 4, 64, 8, 1 << 23, 1000


def mark_first(df: DataFrame, content: Column, *order: str, name: str = "is_first") -> DataFrame:
    """Adds whether a row is the first of its content; ``order`` columns together are unique and not NULL.

    The first rows are aggregated before the shuffle and joined back by their
    order columns, not by content, so copies don't gather in one task.
    """
    firsts = df.groupBy(content.alias("_c")).agg(F.min(F.struct(*order)).alias("_f")).select(*(F.col(f"_f.{o}").alias(o) for o in order), F.lit(True).alias(name))
    return df.join(firsts, list(order), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def dedup_exact(df: DataFrame, text: Column, *order: str) -> DataFrame:
    """Adds ``is_first``: whether a row is the first of its text, by hash."""
    return mark_first(df, X.content_hash(text), *order)


def shingle_sets(df: DataFrame, key: str, text: Column, size: int = SHINGLE) -> DataFrame:
    """``key, runs``: the distinct shingles as hashes; rows without a word are left out."""
    return spread(df).select(F.col(key).alias("key"), X.shingle_hashes(size)(text).alias("runs")).where(F.size("runs") > 0)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            yield batch.slice(start, BLOCK)


def short(runs: np.ndarray) -> np.ndarray:
    """Half of each hash: enough to meet by, as pairs are checked on whole hashes."""
    return runs.astype(np.int32)


class RunOrder:
    """An order of shingles, rare ones first: by classes of their frequency in a sample of the texts, then by hash.

    Any order gives all pairs; the frequencies decide the cost only. They are kept of
    the ``FREQUENT`` shingles that most of the sampled texts have, a table of fixed size.
    """

    def __init__(self, texts: DataFrame, size: int, sample: int = SAMPLE, frequent: int = FREQUENT) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches):
                sizes, runs = X.run_hashes(block.column(0).to_pylist(), size)
                distinct = dict.fromkeys(own.tobytes() for own in np.split(runs, np.cumsum(sizes)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(short(np.frombuffer(b"".join(distinct), np.int64)))], ["run"])

        chosen = texts.where(F.pmod(F.xxhash64("key"), F.lit(sample)) == 0).select("text")
        with freeing(texts.sparkSession):
            top = chosen.mapInArrow(run, "run int").groupBy("run").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "run").limit(frequent).toArrow()
        runs, n = top.column("run").to_numpy(), top.column("n").to_numpy()
        order = np.argsort(runs)
        self.runs, self.classes = runs[order], np.minimum(4 * np.log2(np.maximum(n[order], 1)), 127).astype(np.int8)

    def __call__(self, runs: np.ndarray) -> np.ndarray:
        if not len(self.runs):
            return np.zeros(len(runs), np.int8)
        own = short(runs)
        place = np.minimum(np.searchsorted(self.runs, own), len(self.runs) - 1)
        return np.where(self.runs[place] == own, self.classes[place], -1)


def sketches(owner: np.ndarray, runs: np.ndarray, count: int) -> np.ndarray:
    """Per set the parities of its numbers of shingles in ``64 * WORDS`` cells: two sets differ in as many shingles as parities, or more."""
    cells = 64 * WORDS
    with np.errstate(over="ignore"):
        cell = ((runs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % cells
    odd = np.bincount(owner * cells + cell, minlength=count * cells).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def beginnings(texts: DataFrame, order: RunOrder, similarity: float, size: int) -> DataFrame:
    """``key, same, n, runs, sketch`` of each text with a word: a hash of its set of shingles, their number, the first of the order, and the sketch.

    Of copies that a task meets, only the first has ``runs`` and a sketch; those of further tasks do no harm.
    """
    shared = texts.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for block in blocks(batches):
            counts, every = X.run_hashes(block.column(1).to_pylist(), size)
            keys, sizes = block.column(0).filter(pa.array(counts > 0)), counts[counts > 0]
            if not len(sizes):
                continue
            sets = np.split(every, np.cumsum(sizes)[:-1])
            same = [xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) for own in sets]
            first = np.zeros(len(sets), bool)
            for i, x in enumerate(same):
                if x not in seen:
                    first[i] = True
                    if len(seen) < 1 << 20:
                        seen.add(x)
            own_sizes = np.where(first, sizes, 0)
            runs = every[np.repeat(first, sizes)]
            owner = np.repeat(np.arange(len(sets)), own_sizes)
            by = np.argsort(256 * owner + shared.value(runs) + 1, kind="stable")  # by hash already
            place = np.arange(len(runs)) - np.repeat(np.cumsum(own_sizes) - own_sizes, own_sizes)
            shown = np.where(first, np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-8).astype(np.int64) + MET + sizes // MORE), 0)
            starts = pa.array(np.concatenate(([0], np.cumsum(shown))).astype(np.int32))
            began = pa.ListArray.from_arrays(starts, pa.array(short(runs[by][place < shown[owner]])))
            words = sketches(np.cumsum(first)[owner] - 1, runs, int(first.sum()))
            sketch = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(WORDS * first))).astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([keys, pa.array(same, pa.int64()), pa.array(sizes.astype(np.int32)), began, sketch], ["key", "same", "n", "runs", "sketch"])

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, same bigint, n int, runs array<int>, sketch array<bigint>")


def met(began: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` (hashes of sets, a < b): all pairs at least so similar, and few others.

    A shingle that stands in many beginnings is joined by Spark, where adaptive
    execution splits skewed partitions; both sides are one shuffle.
    """
    firsts = began.select("same", "n", F.posexplode("runs").alias("place", "run"))
    a, b = firsts.alias("a"), firsts.alias("b")
    shared = lambda n, m: F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9)
    least = shared(F.col("a.n"), F.col("b.n"))
    enough = F.least(MET + F.floor(F.least("a.n", "b.n") / MORE), least)
    fits = (F.col("a.n") >= similarity * F.col("b.n") - 1e-9) & (F.col("b.n") >= similarity * F.col("a.n") - 1e-9)
    early = (F.col("a.place") < F.col("a.n") - least + enough) & (F.col("b.place") < F.col("b.n") - least + enough)
    joined = a.join(b, (F.col("a.run") == F.col("b.run")) & (F.col("a.same") < F.col("b.same")) & fits & early)
    # Durable, so that the shuffles of the join are gone before the sketches are sent.
    often = durable(joined.groupBy(F.col("a.same").alias("a"), F.col("b.same").alias("b"), enough.cast("int").alias("enough")).agg(F.count("*").alias("c")).where("c >= enough").select("a", "b"))
    one = began.where(F.size("runs") > 0).select("same", "n", "sketch").dropDuplicates(["same"])
    side = lambda s: one.select(F.col("same").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    apart = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(WORDS)), F.lit(0))
    both = often.join(side("a"), "a").join(side("b"), "b")
    return both.where(apart <= F.col("n_a") + F.col("n_b") - 2 * shared(F.col("n_a"), F.col("n_b"))).select("a", "b")


def wanted(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is in ``keys``, and few others: by a bitmap of fixed size, so rows are not shuffled."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED))
    value = slot(keys.columns[0]) + 1  # buckets of Spark's bitmaps begin with 1
    parts = keys.groupBy(F.bitmap_bucket_number(value).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).collect()
    table = np.zeros(WANTED // 8, np.uint8)
    for part in parts:
        table[(part.bucket - 1) * 4096 :][: len(part.bits)] = np.frombuffer(part.bits, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def known(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return df.where(known(slot(key)))


def similar_texts(df: DataFrame, key: str, text: Column, similarity: float = SIMILARITY, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``members`` (``key, text_id``: the smallest key of the same set of shingles) and ``links`` (``a, b, similarity`` of text ids).

    The texts are read again for what is compared in the end, so ``df`` has to give the same rows each time.
    """
    texts = spread(df).select(F.col(key).alias("key"), text.alias("text"))
    began = durable(beginnings(texts, RunOrder(texts, size), similarity, size))
    ids = began.groupBy("same").agg(F.min("key").alias("text_id"))
    members = durable(began.select("key", "same").join(ids, "same").select("key", "text_id"))
    side = lambda s: ids.select(F.col("same").alias(s), F.col("text_id").alias(f"id_{s}"))
    pairs = durable(met(began, similarity).join(side("a"), "a").join(side("b"), "b").select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")))
    sets = shingle_sets(wanted(df, key, pairs.select(F.explode(F.array("a", "b")))), key, text, size)
    left, right = sets.select(F.col("key").alias("a"), F.col("runs").alias("x")), sets.select(F.col("key").alias("b"), F.col("runs").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("similarity", common / (F.size("x") + F.size("y") - common))
    return members, durable(checked.where(F.col("similarity") >= similarity).select("a", "b", "similarity"))


def near_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``a, b, similarity`` of rows: copies of one text (1.0) and of linked texts."""
    x = members.select(F.col("key").alias("x"), F.col("text_id").alias("a"))
    y = members.select(F.col("key").alias("y"), F.col("text_id").alias("b"))
    across = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    other = y.withColumnRenamed("b", "a")
    same = x.join(other, "a").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    return across.unionByName(same)


def clusters(members: DataFrame, links: DataFrame) -> DataFrame:
    """``key, cluster_id``: the smallest key of the connected rows; rows alone are their own cluster."""
    found = components(links).withColumnRenamed("node", "text_id")
    return members.join(found, "text_id", "left").select("key", F.coalesce("component", "text_id").alias("cluster_id"))


def keep_best(rows: DataFrame, cluster: str, key: str, *order: Column) -> DataFrame:
    """Adds ``kept``: the first row of each cluster in the order given (real before synthetic, longer first), then by ``key``.

    The best is found by an aggregate that combines before the shuffle and is
    joined back by key, so a large cluster does not gather in one task.
    """
    best = rows.groupBy(cluster).agg(F.min(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)), F.col(key).alias("best"))).alias("_b"))
    return rows.join(best.select(F.col("_b.best").alias(key), F.lit(True).alias("kept")), key, "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def is_real(source: Column) -> Column:
    return ~F.coalesce(F.lower(source).startswith("synthetic"), F.lit(False))


def leakage(rows: DataFrame, key: str, text: Column, split: str, similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """``text_a, text_b, split_a, split_b, similarity, n_pairs``: texts (by their smallest key) at least so similar whose rows lie in different splits.

    Rows are counted per text and split first; links join texts, and the numbers
    of copies multiply, so copies are never expanded. A text whose copies lie in
    two splits is linked with itself (similarity 1). ``split_a < split_b`` for
    these; of two texts both orders of splits may occur. Rows without a split are
    not compared.
    """
    own = rows.where(F.col(split).isNotNull())
    members, links = similar_texts(own, key, text, similarity, size)
    sides = own.select(F.col(key).alias("key"), F.col(split).alias("split"))
    counts = durable(members.join(sides, "key").groupBy("text_id", "split").agg(F.count("*").alias("n")))
    side = lambda s: counts.select(F.col("text_id").alias(f"text_{s}"), F.col("split").alias(f"split_{s}"), F.col("n").alias(f"n_{s}"))
    both = links.select(F.col("a").alias("text_a"), F.col("b").alias("text_b"), "similarity").unionByName(members.select(F.col("text_id").alias("text_a")).distinct().select("text_a", F.col("text_a").alias("text_b"), F.lit(1.0).alias("similarity")))
    joined = both.join(side("a"), "text_a").join(side("b"), "text_b")
    across = joined.where((F.col("split_a") != F.col("split_b")) & ((F.col("text_a") != F.col("text_b")) | (F.col("split_a") < F.col("split_b"))))
    return across.select("text_a", "text_b", "split_a", "split_b", "similarity", (F.col("n_a") * F.col("n_b")).alias("n_pairs"))


def near_dup_lsh(df: DataFrame, key: str, text: Column, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = 16, rows: int = 8) -> tuple[DataFrame, DataFrame]:
    """As ``similar_texts``, but candidates share one of ``bands`` bands of ``rows`` minimum hashes.

    A pair of similarity s is missed with probability (1 - s**rows)**bands, 0.4 % at
    0.85; the exact join loses none, this one shuffles ``bands`` rows per text instead of
    a prefix of its shingles. Candidates are compared exactly. A band that many
    texts share is joined by Spark, where skewed partitions are split.
    """
    sets = durable(shingle_sets(df, key, text, size).withColumn("same", F.xxhash64(F.array_sort("runs"))))
    ids = sets.groupBy("same").agg(F.min("key").alias("text_id"))
    members = sets.select("key", "same").join(ids, "same").select("key", "text_id")
    distinct = durable(sets.join(ids.select(F.col("text_id").alias("key")), "key").select("key", "runs"))
    signed = distinct.select("key", F.size("runs").alias("n"), F.explode(X.band_hashes(bands, rows)(F.col("runs"))).alias("band"))
    crowded = signed.groupBy("band").agg(F.count("*").alias("_c")).where("_c > 1").select("band")
    met = durable(signed.join(crowded, "band"))
    a, b = met.alias("a"), met.alias("b")
    fits = (F.col("a.n") >= similarity * F.col("b.n") - 1e-9) & (F.col("b.n") >= similarity * F.col("a.n") - 1e-9)
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.key") < F.col("b.key")) & fits).select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct()
    left, right = distinct.select(F.col("key").alias("a"), F.col("runs").alias("x")), distinct.select(F.col("key").alias("b"), F.col("runs").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    checked = pairs.join(left, "a").join(right, "b").withColumn("similarity", common / (F.size("x") + F.size("y") - common))
    return members, durable(checked.where(F.col("similarity") >= similarity).select("a", "b", "similarity"))

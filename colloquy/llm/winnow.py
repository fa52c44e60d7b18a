"""Records of evaluation splits in the training split, by minima of rolling hashes (problem 6).

The rolling hashes of a text are those of its runs of ``RUN`` words. Minima are
selected twice, over windows of different width:

* over the whole text, under ``BANDS * ROWS`` orders. ``ROWS`` of them make a seed, and
  seeds are joined across splits. Narrow windows would be the plain form of winnowing,
  but their minima are phrases, and common phrases join nearly every pair: on 114,000
  dialogues windows of 6 runs gave 540 million joined pairs, these seeds 0.7 million.
  Texts of similarity J share no seed with probability (1 - J**ROWS)**BANDS, below
  2 in a million at 0.6. Every text that shares a seed is joined, whatever their number;
* over windows of ``WINDOW`` grams, where the joined texts are aligned: equal selected
  grams are seeds of an alignment, chained collinearly (the longest chain first,
  then what is left, so that moved blocks chain as well), extended to both sides
  past single other words, and the words covered are counted.

Between the two, joined pairs are compared exactly: runs of three words in common
over runs in either. Before that, pairs are left out whose sizes exclude the
similarity or whose fingerprints (96 bits, as in problem 1) lie more than ``RADIUS``
apart, which a pair at 0.6 does with a probability of 3 in 100,000 (4 standard deviations).

Only seeds that texts of both sides have are shuffled: two bitmaps of fixed size
skip the rest. Seeds that a sample shows to be hot never meet in one task: they
go to a salted join.

Copies of a text are one text per side when pairs are sought and compared; only
the result names their rows. Texts without a run of three words, NULL messages
and rows of no split have no overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import Batch, KeyBitmap, arrow_rows, batches_of, conversation_text, signed, sorted_groups
from colloquy.llm.vptree import ROWS, SIZE_GAP, alike, band_keys, fingerprints, minimum_hashes
from colloquy.llm.words import WordHashes, words
from colloquy.session import durable, spread

RUN, SIMILARITY = 3, 0.6
BANDS, RADIUS = 96, 35
GRAM, WINDOW, DROP = 9, 4, 3
#: Seeds with more than ``HOLD`` rows are joined by Spark, in ``SALTS`` parts; a sample of one in ``SAMPLE`` texts foretells them.
HOLD, SALTS, SAMPLE = 1 << 13, 16, 64


def selected_grams(batch: Batch, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, first word) of the least gram of each window, in order; ties go to the right."""
    grams, first = batch.runs(gram)
    owner = batch.text_of[first]
    chosen = np.zeros(len(grams), bool)
    count = len(grams) - window + 1
    if count > 0:
        inside = owner[:count] == owner[window - 1 :]
        best, place = grams[:count].copy(), np.arange(count)
        for k in range(1, window):
            other = grams[k : k + count]
            less = other <= best
            best = np.where(less, other, best)
            place = np.where(less, np.arange(count) + k, place)
        chosen[place[inside]] = True
    # Texts with fewer grams than a window select them all.
    sizes = np.bincount(owner, minlength=len(batch.arrays))
    chosen |= (sizes < window)[owner] if len(owner) else chosen
    return owner[chosen], grams[chosen], first[chosen] - batch.start[owner[chosen]]


def select_minima(batch: Batch, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    return selected_grams(batch, gram, window)[:2]


FEATURES = "key bigint, held boolean, high bigint, low bigint, seeds array<bigint>"


def text_seeds(rows: DataFrame, wanted: KeyBitmap | None = None) -> DataFrame:
    """``key, held, high, low, seeds`` of each text with a run of ``rows`` (key, text, held), once per task and side; only seeds that may be wanted."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, wanted = WordHashes(), set(), shared.value
        for batch in batches_of(batches):
            fresh = []
            for one in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                fresh.append(one not in seen)
                seen.add(one)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            own = Batch(batch.column(1).to_pylist(), hashes)
            minima, which = minimum_hashes(own, RUN, BANDS * ROWS)
            text_hash = np.array([xxhash.xxh3_64_intdigest(own.arrays[i].tobytes()) for i in which], np.uint64)
            high, low = fingerprints(minima, own.distinct_runs(RUN)[which], text_hash)
            seeds = signed(np.ascontiguousarray(band_keys(minima, BANDS).T))
            keep = np.ones(seeds.shape, bool) if wanted is None else wanted.may_have(seeds.ravel()).reshape(seeds.shape)
            offsets = np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(seeds[keep], pa.int64()))
            take = pa.array(which)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(signed(high)), pa.array(signed(low)), lists], ["key", "held", "high", "low", "seeds"])

    return spread(rows.select("key", "text", "held")).mapInArrow(run, FEATURES)


def hot_seeds(made: DataFrame, hold: int) -> KeyBitmap:
    """The seeds that more than ``hold`` texts may have, from the sampled texts, as a bitmap of fixed size."""
    sample = made.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select(F.explode("seeds").alias("seed"))
    return KeyBitmap(sample.groupBy("seed").count().where(F.col("count") > max(4, hold // (2 * SAMPLE))), "seed", 20)


def _pairs_of(order: np.ndarray, first: np.ndarray, n_train: np.ndarray, n_held: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(held-out rows, training rows) of all pairs in groups whose training rows come first, in blocks."""
    count = n_train * n_held
    ends = np.cumsum(count)
    for at in range(0, int(ends[-1]) if len(ends) else 0, block):
        number = np.arange(at, min(at + block, int(ends[-1])))
        group = np.searchsorted(ends, number, "right")
        spot = number - (ends[group] - count[group])
        yield order[first[group] + n_train[group] + spot % n_held[group]], order[first[group] + spot // n_held[group]]


SEARCHED = "hot bigint, held_key bigint, train_key bigint, high bigint, low bigint, held boolean"


def group_pairs(columns: list[np.ndarray], radius: int = RADIUS, block: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Pairs of keys across splits in a chunk of whole groups of equal seeds, in blocks of bounded size."""
    seed, key, held = columns[0], columns[1], columns[4].astype(np.int64)
    high, low = columns[2].view(np.uint64), columns[3].view(np.uint64)
    rows = np.lexsort((key, held, seed))
    same = (seed[rows][1:] == seed[rows][:-1]) & (key[rows][1:] == key[rows][:-1]) & (held[rows][1:] == held[rows][:-1])
    rows = rows[np.concatenate([[True], ~same])]  # a text may come from several tasks
    group = np.cumsum(np.concatenate([[0], seed[rows][1:] != seed[rows][:-1]]))
    n_held = np.bincount(group, held[rows]).astype(np.int64)
    n_train = np.bincount(group) - n_held
    first = np.cumsum(n_held + n_train) - (n_held + n_train)
    both = (n_held > 0) & (n_train > 0)
    for test, train in _pairs_of(rows, first[both], n_train[both], n_held[both], block):
        near = alike(high[test], low[test], high[train], low[train], radius)
        found = np.unique(np.stack([key[test[near]], key[train[near]]], axis=1), axis=0)
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(found[:, 0]), pa.array(found[:, 1]), none, none, pa.nulls(len(found), pa.bool_())], ["hot", "held_key", "train_key", "high", "low", "held"])


def seed_pairs(made: DataFrame, hold: int = HOLD, radius: int = RADIUS, wanted: KeyBitmap | None = None) -> DataFrame:
    """``held_key, train_key``: the distinct pairs across splits that share a seed (that may be ``wanted``) and may be similar."""
    hot = made.sparkSession.sparkContext.broadcast((hot_seeds(made, hold), wanted))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks the rows of foretold hot seeds."""
        foretold, wanted = hot.value
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.may_have(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(foretold.may_have(batch.column(0).to_numpy()), pa.bool_())], [*batch.schema.names, "is_hot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, is_hot in sorted_groups(batches, hold):
            if is_hot:
                seed, key, high, low, held = columns
                none = pa.nulls(len(seed), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(key), none, pa.array(high), pa.array(low), pa.array(held.astype(bool))], ["hot", "held_key", "train_key", "high", "low", "held"])
            else:
                yield from group_pairs(columns, radius)

    rows = made.where("size(seeds) > 0").select(F.explode("seeds").alias("seed"), "key", "high", "low", "held")
    marked = rows.mapInArrow(split, "seed bigint, key bigint, high bigint, low bigint, held boolean, is_hot boolean")
    ordered = marked.where("NOT is_hot").drop("is_hot").repartition("seed").sortWithinPartitions("seed")
    searched = durable(ordered.mapInArrow(search, SEARCHED))
    late = searched.where("hot IS NOT NULL").select(F.col("hot").alias("seed"), F.col("held_key").alias("key"), "high", "low", "held")
    crowd = marked.where("is_hot").drop("is_hot").unionByName(late)
    side = lambda own: [F.col(c).alias(f"{own}_{c}") for c in ("key", "high", "low")]
    train = crowd.where("NOT held").select("seed", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("salt"), *side("train"))
    test = crowd.where("held").select("seed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), *side("held"))
    apart = F.bit_count(F.col("held_high").bitwiseXOR(F.col("train_high"))) + F.bit_count(F.shiftrightunsigned(F.col("held_low").bitwiseXOR(F.col("train_low")), 32))
    size = lambda own: F.shiftright(f"{own}_low", 24).bitwiseAND(F.lit(255))
    fits = (F.abs(size("held") - size("train")) <= SIZE_GAP) | (F.greatest(size("held"), size("train")) == 255)
    met = test.join(train, ["seed", "salt"]).where((apart <= radius) & fits).select("held_key", "train_key")
    return searched.where("hot IS NULL").select("held_key", "train_key").unionByName(met).distinct()


def longest_chain(j: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly increasing subsequence."""
    tops, ends, before = [], [], np.full(len(j), -1)
    for k, value in enumerate(j.tolist()):
        at = int(np.searchsorted(tops, value)) if tops else 0
        before[k] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [value], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return np.array(out[::-1], np.int64)


def reach(equal: np.ndarray, drop: int = DROP) -> int:
    """How far to extend along ``equal``: to the best score (one up for an equal word, one down for another) before it falls by ``drop``."""
    if not len(equal):
        return 0
    score = np.cumsum(np.where(equal, 1, -1))
    best = np.maximum.accumulate(np.maximum(score, 0))
    fallen = np.flatnonzero(score <= best - drop)
    score = score[: fallen[0]] if len(fallen) else score
    return int(np.argmax(score)) + 1 if len(score) and score.max() > 0 else 0


def gram_of(shorter: int, gram: int = GRAM) -> int:
    """The words of a seed: of a quarter of the shorter text at most."""
    return min(gram, max(RUN, shorter // 4), shorter)


def common_seeds(a: list[np.ndarray], b: list[np.ndarray], gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, place in a, place in b) of the equal selected grams of many pairs, in order of the place in a.

    The k-th copy of a gram in one text meets the k-th in the other.
    """
    sides = [x for pair in zip(a, b) for x in pair]
    text, value, place = selected_grams(Batch.of_hashes(np.concatenate(sides), np.array([len(x) for x in sides])), gram, window)
    order = np.lexsort((place, value, text))
    text, value, place = text[order], value[order], place[order]
    if not len(text):
        return (np.empty(0, np.int64),) * 3
    fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
    copy = np.arange(len(text)) - np.maximum.accumulate(np.where(fresh, np.arange(len(text)), 0))
    pair, side = text >> 1, text & 1
    by = np.lexsort((side, copy, value, pair))
    pair, side, value, copy, place = pair[by], side[by], value[by], copy[by], place[by]
    met = np.flatnonzero((pair[1:] == pair[:-1]) & (value[1:] == value[:-1]) & (copy[1:] == copy[:-1]) & (side[1:] != side[:-1]))
    pair, i, j = pair[met], place[met], place[met + 1]
    by = np.lexsort((i, pair))
    return pair[by], i[by], j[by]


def chained(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, gram: int) -> tuple[int, int]:
    """Words of ``a`` and of ``b`` that lie in common chains of the seeds at ``i`` and ``j``.

    The longest collinear chain is taken first, then the longest of what
    is left, until no seed is uncovered; each seed of a chain is extended to both
    sides and covers equal words not covered before, so reordered parts count too.
    """
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    while len(i):
        chain = longest_chain(j)
        done = (-1, -1)  # the diagonal and the end of the last extension
        for k in chain.tolist():
            x, d = int(i[k]), int(j[k] - i[k])
            if done[0] == d and x + gram <= done[1]:
                continue
            low, high = max(0, -d), min(len(a), len(b) - d)
            start = x - reach((a[low:x] == b[low + d : x + d])[::-1])
            end = x + gram + reach(a[x + gram : high] == b[x + gram + d : high + d])
            free = (a[start:end] == b[start + d : end + d]) & ~(in_a[start:end] | in_b[start + d : end + d])
            in_a[start:end] |= free
            in_b[start + d : end + d] |= free
            done = (d, end)
        rest = np.ones(len(i), bool)
        rest[chain] = False
        rest &= ~in_a[i] & ~in_b[j]
        i, j = i[rest], j[rest]
    return int(in_a.sum()), int(in_b.sum())


def align_all(a: list[np.ndarray], b: list[np.ndarray], gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """``chained`` of many pairs; short texts have shorter seeds and show all of them."""
    out: list[tuple[int, int]] = [(0, 0)] * len(a)
    sizes = np.array([gram_of(min(len(x), len(y)), gram) for x, y in zip(a, b)], np.int64)
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        pair, i, j = common_seeds([a[r] for r in rows], [b[r] for r in rows], size, window if size == gram else 1)
        edges = np.searchsorted(pair, np.arange(len(rows) + 1))
        for k, r in enumerate(rows.tolist()):
            out[r] = chained(a[r], b[r], i[edges[k] : edges[k + 1]], j[edges[k] : edges[k + 1]], size)
    return out


def align(a: np.ndarray, b: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[int, int]:
    """Words of ``a`` and of ``b`` that lie in common chains."""
    return align_all([a], [b], gram, window)[0]


def word_arrays(rows: DataFrame, wanted: KeyBitmap) -> DataFrame:
    """``key, words``: hashed words of the texts that may be wanted, once each."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches_of(batches):
            may = shared.value.may_have(batch.column(0).to_numpy())
            fresh = []
            for ok, one in zip(may.tolist(), batch.column(0).to_pylist()):
                fresh.append(ok and one not in seen)
                if ok:
                    seen.add(one)
            batch = batch.filter(pa.array(fresh, pa.bool_()))
            own = [signed(hashes(words(t))) for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
            values = np.concatenate(own) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))], ["key", "words"])

    return spread(rows.select("key", "text")).mapInArrow(build, "key bigint, words array<bigint>").dropDuplicates(["key"])


def _run_keys(lists: pa.ListArray) -> np.ndarray:
    """Sorted distinct (row, run) keys of a batch of word arrays."""
    offsets = lists.offsets.to_numpy()
    own = Batch.of_hashes(lists.values.to_numpy().view(np.uint64)[offsets[0] : offsets[-1]], np.diff(offsets))
    runs, first = own.runs(RUN)
    return np.unique((own.text_of[first].astype(np.uint64) << np.uint64(54)) | (runs >> np.uint64(10)))


def compare(batches: Iterator[pa.RecordBatch], similarity: float = SIMILARITY) -> Iterator[pa.RecordBatch]:
    """Exact similarity of each candidate pair, and the chained coverage of those that reach it."""
    for batch in batches_of(batches):
        a_keys, b_keys = _run_keys(batch.column(2)), _run_keys(batch.column(3))
        count = lambda keys: np.bincount((keys >> np.uint64(54)).astype(np.int64), minlength=batch.num_rows)  # noqa: E731, B023
        common = count(np.intersect1d(a_keys, b_keys, assume_unique=True))
        union = count(a_keys) + count(b_keys) - common
        like = common / np.maximum(union, 1)
        kept = np.flatnonzero((like >= similarity) & (union > 0))
        a, b = ([batch.column(c)[k].values.to_numpy().view(np.uint64) for k in kept.tolist()] for c in (2, 3))
        out = [(like[k], in_a, len(x), in_b, len(y)) for k, x, y, (in_a, in_b) in zip(kept.tolist(), a, b, align_all(a, b))]
        names = ["similarity", "held_covered", "held_words", "train_covered", "train_words"]
        types = [pa.float64(), *[pa.int64()] * 4]
        columns = [pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept)), batch.column(1).take(pa.array(kept)), *columns], ["held_key", "train_key", *names])


COMPARED = "held_key bigint, train_key bigint, similarity double, held_covered bigint, held_words bigint, train_covered bigint, train_words bigint"


def overlaps(texts: DataFrame, similarity: float = SIMILARITY, hold: int = HOLD, bitmap_bits: int = 26) -> DataFrame:
    """Overlapping pairs of ``texts`` (``key`` bigint, equal for equal texts; ``text``; ``held``: evaluation or training); similarities below 0.6 are not meant."""
    held = durable(text_seeds(texts.where("held")))
    train = durable(text_seeds(texts.where("NOT held"), KeyBitmap(held.select(F.explode("seeds").alias("seed")), "seed", bitmap_bits)))
    in_train = KeyBitmap(train.select(F.explode("seeds").alias("seed")), "seed", bitmap_bits)
    close = durable(seed_pairs(held.unionByName(train), hold, wanted=in_train))
    keys = close.select(F.col("held_key").alias("key")).union(close.select("train_key")).distinct()
    arrays = word_arrays(texts, KeyBitmap(keys, "key", bitmap_bits))
    a = arrays.select(F.col("key").alias("held_key"), F.col("words").alias("a"))
    b = arrays.select(F.col("key").alias("train_key"), F.col("words").alias("b"))
    joined = close.join(a, "held_key").join(b, "train_key").select("held_key", "train_key", "a", "b")
    return joined.mapInArrow(lambda batches: compare(batches, similarity), COMPARED)


def split_rows(dialogues: DataFrame, key: str = "rec_id") -> DataFrame:
    """``row, key, text, held`` and the reported columns of the rows with a split; ``key`` is a hash of the text."""
    split = F.col("split")
    rows = dialogues.where(split.isin("train", "val", "test")).select(F.col(key).alias("row"), "split", "scenario", "source", conversation_text().alias("text"), (split != "train").alias("held"))
    return rows.where("text IS NOT NULL").withColumn("key", F.xxhash64("text"))


def overlap_pairs(dialogues: DataFrame) -> DataFrame:
    """``rec_a, rec_b``: all pairs of rows, copies included."""
    rows = split_rows(dialogues).select("key", "row", "held")
    a = rows.where("held").select(F.col("key").alias("held_key"), F.col("row").alias("held_row"))
    b = rows.where("NOT held").select(F.col("key").alias("train_key"), F.col("row").alias("train_row"))
    both = overlaps(split_rows(dialogues)).select("held_key", "train_key").join(a, "held_key").join(b, "train_key")
    return both.select(F.least("held_row", "train_row").alias("rec_a"), F.greatest("held_row", "train_row").alias("rec_b"))


def overlap_report(dialogues: DataFrame) -> DataFrame:
    """Overlapping evaluation records per split, scenario and source: records, pairs with training rows, and the mean share of their words that training covers.

    Copies are counted per text, not expanded.
    """
    rows = split_rows(dialogues)
    copies = rows.where("NOT held").groupBy(F.col("key").alias("train_key")).agg(F.count("*").alias("copies"))
    found = overlaps(rows).join(copies, "train_key").groupBy(F.col("held_key").alias("key")).agg(
        F.sum("copies").alias("partners"), F.max(F.col("held_covered") / F.col("held_words")).alias("coverage")
    )
    own = rows.where("held").groupBy("key", "split", "scenario", "source").agg(F.count("*").alias("n"))
    return own.join(found, "key").groupBy("split", "scenario", "source").agg(
        F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("partners")).alias("n_pairs"), (F.sum(F.col("n") * F.col("coverage")) / F.sum("n")).alias("mean_coverage")
    )

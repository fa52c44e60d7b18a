"""Groups of near-equal records, by vantage-point trees over fingerprints (problem 1).

A text becomes the set of its runs of three words. ``BANDS * ROWS`` minimum
hashes of the set give

* the id of the text: 96 bits, one of each of as many minimum hashes, 8 bits of the
  logarithm of the number of runs and 24 bits of a hash of its words. The 96 bits are a
  fingerprint: two sets of similarity J differ in (1 - J) / 2 of them, so similarity J
  or more means a Hamming distance within ``RADIUS`` of the fingerprints (at J = 0.6
  4 standard deviations above the mean). Similarity J also means that the smaller set
  has at least J times the runs of the larger one, which the 8 bits check;
* its shards: a fingerprint lies in one shard per band, and texts of similarity J
  miss each other in all shards with probability (1 - J**ROWS)**BANDS.

A tree over a whole collection doesn't prune: the distances of unrelated texts
crowd around 48 of 96 bits, and two such distances never differ by more than a
radius of 35, so the triangle bound excludes nothing (measured: a tree over 4,096
fingerprints makes 99.9 % of all comparisons). It is not a matter of bits: similar
texts lie within a fifth of the bits, unrelated ones at half, and a bound needs twice
the radius between them. The bands therefore do the sharding, and trees are built
inside shards of more than ``LEAF`` texts, where they prune as far as these differ.
A shard of more than ``HOT`` texts lies in blocks, each with its own tree. No cap
applies anywhere. Pairs within the radius are checked exactly on their sets.

Copies of a text share an id and are searched once; only ``pairs`` expands them.
Texts with fewer than three words, NULL messages and blank contents have no run
and thus no link. Repeated rows link with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.texts import Batch, KeyBitmap, arrow_rows, batches_of, conversation_text, signed, sorted_groups
from colloquy.llm.words import WordHashes, mix
from colloquy.operators.graph import components
from colloquy.session import durable, spread

RUN, SIMILARITY = 3, 0.6
BANDS, ROWS, RADIUS = 36, 4, 35
#: Sizes of sets are told apart in steps of a twentieth; two steps allow for rounding.
SIZE_STEP = 1.05
SIZE_GAP = int(np.ceil(np.log(1 / SIMILARITY) / np.log(SIZE_STEP))) + 2
HOT, LEAF, SAMPLE = 4096, 32, 64

def minimum_hashes(batch: Batch, run: int = RUN, count: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Minimum hashes (one row per hash) of the texts that have a run, and which texts these are."""
    runs, first = batch.runs(run)
    owner = batch.text_of[first]
    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    out = np.empty((count, len(edges)), np.uint32)
    if len(edges):
        high = (runs >> np.uint64(32)).astype(np.uint32)
        product = np.empty_like(high)
        odd = (mix(np.arange(1, count + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for k, factor in enumerate(odd):
            # The sums with a per-hash constant make the minima of the products independent of each other.
            np.multiply(high ^ (factor >> np.uint32(7)), factor, out=product)
            np.minimum.reduceat(product, edges, out=out[k])
    return out, owner[edges]


def fingerprints(minima: np.ndarray, sizes: np.ndarray, text_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the ids: 64 bits of the fingerprint; its other 32 bits, 8 bits of size and 24 bits of the text's hash."""
    with np.errstate(over="ignore"):
        bits = (mix(minima[:96].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) & np.uint64(1)
    place = np.arange(64, dtype=np.uint64)[:, None]
    high = np.bitwise_or.reduce(bits[:64] << place, axis=0)
    low = np.bitwise_or.reduce(bits[64:] << (place[:32] + np.uint64(32)), axis=0)
    size = np.minimum(np.log(sizes) / np.log(SIZE_STEP), 255).astype(np.uint64)
    return high, low | (size << np.uint64(24)) | (text_hashes >> np.uint64(40))


def band_keys(minima: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key per band (row) and text."""
    band = np.arange(1, bands + 1, dtype=np.uint64)[:, None]
    part = [minima[k::ROWS][:bands].astype(np.uint64) for k in range(ROWS)]
    with np.errstate(over="ignore"):
        keys = mix(((part[0] << np.uint64(32)) | part[1]) * np.uint64(0x9E3779B97F4A7C15) + ((part[2] << np.uint64(32)) | part[3]) * np.uint64(0xD6E8FEB86659FD93) + band * np.uint64(0xA0761D6478BD642F))
    return keys >> np.uint64(8)


def distance(high: np.ndarray, low: np.ndarray, to_high: np.ndarray, to_low: np.ndarray) -> np.ndarray:
    """Hamming distance of fingerprints given as ids."""
    return np.bitwise_count(high ^ to_high).astype(np.int16) + np.bitwise_count((low ^ to_low) >> np.uint64(32))


def alike(high: np.ndarray, low: np.ndarray, to_high: np.ndarray, to_low: np.ndarray, radius: int) -> np.ndarray:
    """Whether fingerprints are within the radius and sizes allow the similarity."""
    size, to_size = (low >> np.uint64(24)).astype(np.uint8).astype(np.int16), (to_low >> np.uint64(24)).astype(np.uint8).astype(np.int16)
    # The largest size class is open above.
    return (distance(high, low, to_high, to_low) <= radius) & ((np.abs(size - to_size) <= SIZE_GAP) | (np.maximum(size, to_size) == 255))


class VantageTree:
    """A vantage-point tree over fingerprints; questions run down the tree together, as arrays."""

    def __init__(self, high: np.ndarray, low: np.ndarray, leaf: int = LEAF) -> None:
        self.high, self.low, self.leaf, self.compared = high, low, leaf, 0
        self.root = self._build(np.arange(len(high)))

    def _build(self, members: np.ndarray):
        if len(members) <= self.leaf:
            return members
        point, rest = members[0], members[1:]
        apart = distance(self.high[rest], self.low[rest], self.high[point], self.low[point])
        middle = int(np.median(apart))
        near = apart <= middle
        if near.all():  # all remaining ones are equally far or nearer; the bound can't tell them apart
            near = apart < middle
        if not near.any() or near.all():
            return members
        return point, int(apart[near].max()), int(apart[~near].min()), self._build(rest[near]), self._build(rest[~near])

    def within(self, high: np.ndarray, low: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(question, member) index pairs at most ``radius`` apart."""
        asked: list[np.ndarray] = []
        found: list[np.ndarray] = []

        def compare(questions: np.ndarray, members: np.ndarray) -> None:
            step = max(1, (1 << 20) // max(1, len(members)))
            self.compared += len(questions) * len(members)
            for at in range(0, len(questions), step):
                q = questions[at : at + step]
                hit = alike(high[q, None], low[q, None], self.high[None, members], self.low[None, members], radius)
                i, j = np.nonzero(hit)
                asked.append(q[i])
                found.append(members[j])

        stack = [(self.root, np.arange(len(high)))]
        while stack:
            node, questions = stack.pop()
            if not len(questions):
                continue
            if isinstance(node, np.ndarray):
                compare(questions, node)
                continue
            point, reach, start, near, far = node
            self.compared += len(questions)
            apart = distance(high[questions], low[questions], self.high[point], self.low[point])
            hit = questions[alike(high[questions], low[questions], self.high[point], self.low[point], radius)]
            asked.append(hit)
            found.append(np.full(len(hit), point))
            stack.append((near, questions[apart <= reach + radius]))
            stack.append((far, questions[apart >= start - radius]))
        return np.concatenate(asked), np.concatenate(found)


PAIRS = "a_high bigint, a_low bigint, b_high bigint, b_low bigint"


def _pair_rows(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> pa.RecordBatch:
    """Each unordered pair of different ids once, the smaller id first."""
    swap = (ah > bh) | ((ah == bh) & (al > bl))
    ah, bh, al, bl = np.where(swap, bh, ah), np.where(swap, ah, bh), np.where(swap, bl, al), np.where(swap, al, bl)
    keep = (ah != bh) | (al != bl)
    table = np.unique(np.stack([ah[keep], al[keep], bh[keep], bl[keep]], axis=1), axis=0)
    names = ["a_high", "a_low", "b_high", "b_low"]
    return arrow_rows({n: (signed(np.ascontiguousarray(table[:, i])), pa.int64()) for i, n in enumerate(names)})


def shard_pairs(key: np.ndarray, high: np.ndarray, low: np.ndarray, radius: int = RADIUS) -> pa.RecordBatch:
    """Pairs within the radius in the complete shards of a chunk, sorted by key."""
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    sizes = np.diff(edges)
    parts: list[tuple[np.ndarray, ...]] = []
    # Small shards lie side by side: each text is compared with those at most LEAF places further on.
    small = np.repeat((sizes > 1) & (sizes <= LEAF), sizes)
    k, h, l = key[small], high[small], low[small]
    for lag in range(1, int(min(LEAF, sizes.max(initial=1)))):
        i = np.flatnonzero(k[:-lag] == k[lag:])
        if not len(i):
            break
        i = i[alike(h[i], l[i], h[i + lag], l[i + lag], radius)]
        parts.append((h[i], l[i], h[i + lag], l[i + lag]))
    for g in np.flatnonzero(sizes > LEAF):
        at = slice(edges[g], edges[g + 1])
        own = np.unique(np.stack([high[at], low[at]], axis=1), axis=0)
        h, l = np.ascontiguousarray(own[:, 0]), np.ascontiguousarray(own[:, 1])
        q, m = VantageTree(h, l).within(h, l, radius)
        q, m = q[q < m], m[q < m]
        parts.append((h[q], l[q], h[m], l[m]))
    if not parts:
        parts = [(np.empty(0, np.uint64),) * 4]
    return _pair_rows(*(np.concatenate(x) for x in zip(*parts)))


def features(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, high, low, bands`` of every row with a run; the bands only with the first copy in a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches_of(batches):
            own = Batch(batch.column(1).to_pylist(), hashes)
            minima, which = minimum_hashes(own)
            text_hash = np.array([xxhash.xxh3_64_intdigest(own.arrays[i].tobytes()) for i in which], np.uint64)
            high, low = fingerprints(minima, own.distinct_runs(RUN)[which], text_hash)
            keys = signed(np.ascontiguousarray(band_keys(minima).T))
            fresh = np.zeros(len(which), bool)
            for i, one in enumerate(zip(high.tolist(), low.tolist())):
                if one not in seen:
                    seen.add(one)
                    fresh[i] = True
            offsets = np.concatenate([[0], np.cumsum(np.where(fresh, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[fresh].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(which)), pa.array(signed(high)), pa.array(signed(low)), bands], ["key", "high", "low", "bands"]
            )

    kind = rows.schema[key].dataType.simpleString()
    return spread(rows.select(key, text)).mapInArrow(run, f"key {kind}, high bigint, low bigint, bands array<bigint>")


def hot_bands(shards: DataFrame, hot: int) -> KeyBitmap:
    """The shards that more than ``hot`` texts may have, from one in ``SAMPLE`` texts, as a bitmap of fixed size."""
    sample = shards.where(F.pmod(F.xxhash64("high", "low"), F.lit(SAMPLE)) == 0)
    return KeyBitmap(sample.groupBy("band").count().where(F.col("count") > max(4, hot // (2 * SAMPLE))), "band", 20)


def near_pairs(shards: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Distinct pairs of ids within the radius that share a shard; ``shards`` has ``band, high, low``.

    Shards that a sample foretells to be hot, and those that turn out so, go to ``hot_pairs``.
    """
    foretold = shards.sparkSession.sparkContext.broadcast(hot_bands(shards, hot))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(foretold.value.may_have(batch.column(0).to_numpy()), pa.bool_())], ["band", "high", "low", "is_hot"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, high, low), is_hot in sorted_groups(batches, hot):
            high, low = high.view(np.uint64), low.view(np.uint64)
            if is_hot:
                none = np.zeros(len(band), np.int64)
                yield arrow_rows({"hot": (band, pa.int64()), "a_high": (signed(high), pa.int64()), "a_low": (signed(low), pa.int64()), "b_high": (none, pa.int64()), "b_low": (none, pa.int64())})
            else:
                pairs = shard_pairs(band, high, low, radius)
                yield pa.RecordBatch.from_arrays([pa.nulls(pairs.num_rows, pa.int64()), *pairs.columns], ["hot", *pairs.schema.names])

    marked = shards.select("band", "high", "low").mapInArrow(mark, "band bigint, high bigint, low bigint, is_hot boolean")
    ordered = marked.where("NOT is_hot").drop("is_hot").repartition("band").sortWithinPartitions("band")
    searched = durable(ordered.mapInArrow(search, f"hot bigint, {PAIRS}"))
    late = searched.where("hot IS NOT NULL").select(F.col("hot").alias("band"), F.col("a_high").alias("high"), F.col("a_low").alias("low"))
    crowd = marked.where("is_hot").drop("is_hot").unionByName(late)
    return searched.where("hot IS NULL").drop("hot").unionByName(hot_pairs(crowd, radius, hot)).distinct()


def hot_pairs(crowd: DataFrame, radius: int, hot: int) -> DataFrame:
    """Pairs of the hot shards: a shard lies in blocks of about ``hot`` texts, each with its own tree; a text is stored in one block of its shard and asks in all of them.

    A partition of the shard by distance to vantage points does not spare blocks: with
    64 points drawn from a shard every text has to ask in all 64 cells.
    """
    crowd = durable(crowd.distinct())
    sizes = crowd.groupBy("band").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks"))
    laid = crowd.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("low", "high"), F.col("blocks")).cast("int"))
    stored = laid.select(F.xxhash64("band", F.col("own").alias("spot")).alias("shard"), F.lit(0).alias("asks"), "high", "low")
    # Of two blocks the texts of the first ask in the second, so each pair is met once.
    asking = laid.select("band", "high", "low", F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("spot")).select(F.xxhash64("band", "spot").alias("shard"), F.lit(1).alias("asks"), "high", "low")
    ordered = stored.unionByName(asking).repartition("shard").sortWithinPartitions("shard", "asks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, kept, tree = None, [], None
        for batch in batches_of(batches, 4096):
            shards, asks, high, low = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(shards) else []
            for low_at, high_at in zip(edges[:-1], edges[1:]):
                if shards[low_at] != shard:
                    shard, kept, tree = shards[low_at], [], None
                s = slice(low_at, high_at)
                h, l, is_asking = high[s].view(np.uint64), low[s].view(np.uint64), asks[s] == 1
                if (~is_asking).any():
                    kept.append((h[~is_asking], l[~is_asking]))
                if is_asking.any() and kept:
                    tree = tree or VantageTree(*(np.concatenate(x) for x in zip(*kept)))
                    q, m = tree.within(h[is_asking], l[is_asking], radius)
                    yield _pair_rows(h[is_asking][q], l[is_asking][q], tree.high[m], tree.low[m])

    return ordered.mapInArrow(ask, PAIRS)


def pack(values: np.ndarray) -> bytes:
    """Sorted distinct values of 40 bits, five bytes each."""
    return np.ascontiguousarray(np.unique(values >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(packed, np.uint8).reshape(-1, 5)
    return wide.view(np.uint64).ravel()


def run_sets(rows: DataFrame, key: str, text: str, wanted: KeyBitmap, run: int = RUN) -> DataFrame:
    """``key, runs``: the packed distinct runs of the rows whose key may be wanted; others are not tokenised.

    Runs are 40-bit hashes; that two different runs of two texts of a thousand runs agree
    by chance has a probability of 1 in 10**6, and such a run moves the similarity by 1 in 1,000.
    """
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches_of(batches):
            batch = batch.filter(pa.array(shared.value.may_have(batch.column(0).to_numpy())))
            own = Batch(batch.column(1).to_pylist(), hashes)
            runs, first = own.runs(run)
            cuts = np.searchsorted(own.text_of[first], np.arange(1, batch.num_rows))
            sets = [pack(x) for x in np.split(runs, cuts)] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["key", "runs"])

    return spread(rows.select(key, text)).mapInArrow(build, "key bigint, runs binary")


def compare_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The similarity of each pair from its packed sets (the last two columns)."""
    for batch in batches_of(batches):
        out = np.zeros(batch.num_rows)
        for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
            common = len(np.intersect1d(unpack(x), unpack(y), assume_unique=True))
            out[k] = common / ((len(x) + len(y)) // 5 - common)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out)], [*batch.schema.names[:4], "similarity"])


class Links:
    """``members``: ``rec_id, high, low`` of every row with a run. ``links``: pairs of different texts with their similarity."""

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def pairs(self, key: str = "rec_id") -> DataFrame:
        """All pairs of rows: those of one text and those of linked texts."""
        m = self.members
        a = m.select(F.col("key").alias("x"), F.col("high").alias("a_high"), F.col("low").alias("a_low"))
        b = m.select(F.col("key").alias("y"), F.col("high").alias("b_high"), F.col("low").alias("b_low"))
        across = self.links.join(a, ["a_high", "a_low"]).join(b, ["b_high", "b_low"])
        repeated = m.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        copies = m.join(repeated, ["high", "low"])
        other = copies.select(F.col("key").alias("y"), "high", "low")
        same = copies.withColumnRenamed("key", "x").join(other, ["high", "low"]).where("x < y")
        both = across.select("x", "y").unionByName(same.select("x", "y"))
        return both.select(F.least("x", "y").alias(f"{key[:3]}_a"), F.greatest("x", "y").alias(f"{key[:3]}_b"))

    def groups(self) -> DataFrame:
        """``key, group_id, n_links``: the smallest key of the connected group and the number of linked rows."""
        sizes = self.members.groupBy("high", "low").agg(F.count("*").alias("size"), F.min("key").alias("text"))
        side = lambda s: sizes.select(F.col("high").alias(f"{s}_high"), F.col("low").alias(f"{s}_low"), F.col("text").alias(f"{s}"), F.col("size").alias(f"{s}_size"))
        named = durable(self.links.join(side("a"), ["a_high", "a_low"]).join(side("b"), ["b_high", "b_low"]).select("a", "b", "a_size", "b_size"))
        degree = named.select(F.col("a").alias("text"), F.col("b_size").alias("n")).unionByName(named.select(F.col("b").alias("text"), F.col("a_size").alias("n"))).groupBy("text").agg(F.sum("n").alias("others"))
        found = components(named).withColumnRenamed("node", "text")
        texts = sizes.join(degree, "text", "left").join(found, "text", "left")
        return self.members.join(texts, ["high", "low"]).select(
            "key", F.coalesce("component", "text").alias("group_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
        )


def link_texts(rows: DataFrame, key: str, text: str, similarity: float = SIMILARITY, radius: int = RADIUS, hot: int = HOT) -> Links:
    """Search all rows (unique integer ``key``, string ``text``)."""
    made = durable(features(rows, key, text))
    members = made.select("key", "high", "low")
    shards = made.where("size(bands) > 0").select(F.explode("bands").alias("band"), "high", "low")
    close = durable(near_pairs(shards, radius, hot))
    ids = close.select(F.col("a_high").alias("high"), F.col("a_low").alias("low")).union(close.select("b_high", "b_low")).distinct()
    first = durable(members.join(ids, ["high", "low"]).groupBy("high", "low").agg(F.min("key").alias("key")))
    sets = first.join(run_sets(rows, key, text, KeyBitmap(first, "key")), "key").drop("key")
    a = sets.select(F.col("high").alias("a_high"), F.col("low").alias("a_low"), F.col("runs").alias("a_runs"))
    b = sets.select(F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("runs").alias("b_runs"))
    both = close.join(a, ["a_high", "a_low"]).join(b, ["b_high", "b_low"]).select("a_high", "a_low", "b_high", "b_low", "a_runs", "b_runs")
    checked = both.mapInArrow(compare_sets, f"{PAIRS}, similarity double")
    return Links(members, durable(checked.where(F.col("similarity") >= similarity)))


def link_dialogues(dialogues: DataFrame) -> Links:
    return link_texts(dialogues.select("rec_id", conversation_text().alias("text")), "rec_id", "text")

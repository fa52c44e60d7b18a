"""Percentiles of large numeric columns from mergeable buffers (problem 5).

A sketch of a group is a set of sorted buffers of ``BUFFER`` values; a buffer of
level L stands for ``BUFFER * 2**L`` values, each with weight ``2**L``. Values
that do not fill a buffer stay as they are (level 0). Buffers collapse by
sorting their union and keeping evenly spaced positions, so the result is
deterministic. Collapsing a block of ``BUFFER * 2**L`` raw values moves no rank
by more than ``2**(L-1)``; joining two buffers of weight w moves no rank by more
than w. Each sketch carries the sum of these bounds, which is the stated error:
the value given for a percentile has a true rank within ``rank_error`` of the
wanted one. Merging follows a tree: partial sketches of ``FAN`` tasks meet in one, and
so on, with as many levels as the number of tasks asks for, so that no task gets
more than ``FAN`` partial sketches of a hot group, and depth and error grow with the
logarithm of the number of values.

Sketches of days or files are kept in a ``SketchStore`` and put together without reading
rows again. A request that is logged in two parts counts in the part added first: the
store keeps the ids of each part, and a later part leaves out those it has.

The wanted rank of percentile p among n values is ``ceil(p * n)``; groups whose
values fit in raw buffers are exact. NULL, NaN, infinite and negative values are
left out, repeated requests count once (by the earliest ``logged_at``), groups
without any valid value give no row, NULL group keys form a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUFFER, FAN, FLUSH_VALUES = 1024, 64, 1 << 21
#: ``salt`` is the task of a partial sketch, or a node of the tree.
SKETCH = "grp string, metric string, salt int, level int, error bigint, vals array<double>"

Sketch = dict[int, list[np.ndarray]]


def collapse_block(ordered: np.ndarray, size: int) -> np.ndarray:
    """``size`` evenly spaced positions of a sorted block, taken from the middle of each stretch."""
    step = len(ordered) // size
    return ordered[(step - 1) // 2 :: step]


def sketch_raw(values: np.ndarray, size: int = BUFFER) -> tuple[Sketch, int]:
    """Buffers of raw values in any order: blocks of size * 2**L, the largest first, and a raw rest."""
    sketch, error, at = {}, 0, 0
    while len(values) - at >= 2 * size:
        level = ((len(values) - at) // size).bit_length() - 1
        block = np.sort(values[at : at + (size << level)])
        sketch.setdefault(level, []).append(collapse_block(block, size))
        error += (1 << level) >> 1
        at += size << level
    if at < len(values):
        sketch.setdefault(0, []).append(np.sort(values[at:]))
    return sketch, error


def merge(sketch: Sketch, error: int, size: int = BUFFER) -> tuple[Sketch, int]:
    """Collapse until every level has at most one buffer; raw values first."""
    raw = np.concatenate(sketch.pop(0)) if 0 in sketch else np.empty(0)
    own, more = sketch_raw(raw, size)
    error += more
    for level, buffers in own.items():
        sketch.setdefault(level, []).extend(buffers)
    level = 1
    while level <= max(sketch, default=0):
        buffers = sketch.get(level, [])
        turn = 0
        while len(buffers) > 1:
            union = np.sort(np.concatenate([buffers.pop(), buffers.pop()]))
            sketch.setdefault(level + 1, []).append(union[turn::2])  # alternate ends, so that errors do not add up on one side
            error += 1 << level
            turn = 1 - turn
        level += 1
    return {k: v for k, v in sketch.items() if v}, error


def weigh(sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """All values in order and the cumulated weights."""
    values = np.concatenate([b for buffers in sketch.values() for b in buffers])
    weights = np.concatenate([np.full(len(b), 1 << level, np.int64) for level, buffers in sketch.items() for b in buffers])
    order = np.argsort(values, kind="stable")
    return values[order], np.cumsum(weights[order])


def percentile(values: np.ndarray, cumulated: np.ndarray, p: float) -> float:
    rank = max(1, int(np.ceil(p * cumulated[-1])))
    return float(values[np.searchsorted(cumulated, rank, "left")])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["grp", "metric", "salt", "level", "error", "vals"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names)


def _sketch_rows(group: str, metric: str, salt: int, sketch: Sketch, error: int) -> list[tuple]:
    """One row per buffer; the first carries the error."""
    rows = [(group, metric, salt, level, 0, b) for level, buffers in sketch.items() for b in buffers]
    return [(*rows[0][:4], error, rows[0][5]), *rows[1:]] if rows else []


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, first, last) of each run of a sorted integer array."""
    if len(keys):
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        yield from zip(keys[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist())


def build(rows: DataFrame, groups: dict[str, Column], metrics: Sequence[str]) -> DataFrame:
    """Partial sketches, one set per task: ``groups`` maps a prefix to a string key column (NULL allowed).

    The rows are not shuffled; every task emits what its own rows give.
    """
    columns = [F.coalesce(F.concat(F.lit(f"{prefix}|"), key), F.lit(f"{prefix}!")).alias(f"g{i}") for i, (prefix, key) in enumerate(groups.items())]
    taken = rows.select(*columns, *(F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)))
    count, names = len(groups), list(metrics)

    def flush(batches: list[pa.RecordBatch], salt: int) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches).combine_chunks()
        values = [block.column(count + i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        for g in range(count):
            coded = block.column(g).combine_chunks().dictionary_encode()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            codes, labels, out, size = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist(), [], 0
            order = np.argsort(codes, kind="stable")
            for m, name in enumerate(names):
                ordered, own = values[m][order], codes[order]
                with np.errstate(invalid="ignore"):
                    good = np.isfinite(ordered) & (ordered >= 0)
                ordered, own = ordered[good], own[good]
                for key, low, high in _slices(own):
                    out += _sketch_rows(labels[key], name, salt, *sketch_raw(ordered[low:high]))
                    size += min(high - low, 4 * BUFFER)
                    if size > FLUSH_VALUES // 8:
                        yield _rows(out)
                        out, size = [], 0
            if out:
                yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, held, size = TaskContext.get().partitionId(), [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows * len(names)
            if size >= FLUSH_VALUES:
                yield from flush(held, salt)
                held, size = [], 0
        if size:
            yield from flush(held, salt)

    return taken.mapInArrow(run, SKETCH)


def _grouped(batches: Iterator[pa.RecordBatch], by_salt: bool) -> Iterator[tuple[str, str, int, Sketch, int]]:
    """The sketches of a task, whose rows are sorted by group; one group is held at a time."""
    current, sketch, error = None, {}, 0
    for batch in batches:
        values = batch.column(5)
        offsets, flat = values.offsets.to_numpy(), values.values.to_numpy(zero_copy_only=False)
        salts = batch.column(2).to_pylist()
        for i, (group, metric, level, own) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            key = (group, metric, salts[i] if by_salt else 0)
            if key != current:
                if current is not None:
                    yield *current, sketch, error
                current, sketch, error = key, {}, 0
            sketch.setdefault(level, []).append(flat[offsets[i] : offsets[i + 1]])
            error += own
            if len(sketch[level]) >= 64:  # a hot group is merged while it streams past
                sketch, error = merge(sketch, error)
    if current is not None:
        yield *current, sketch, error


def _merge_stage(sketches: DataFrame, by_salt: bool) -> DataFrame:
    keys = ["grp", "metric", *(["salt"] if by_salt else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for group, metric, salt, sketch, error in _grouped(batches, by_salt):
            out += _sketch_rows(group, metric, salt, *merge(sketch, error))
            if len(out) >= 4096:
                yield _rows(out)
                out = []
        yield _rows(out)

    return sketches.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, SKETCH)


def combine(sketches: DataFrame) -> DataFrame:
    """One sketch per group and metric from any union of sketches (tasks, files, days)."""
    return _merge_stage(sketches, by_salt=False)


def combine_tree(sketches: DataFrame, tasks: int) -> DataFrame:
    """As ``combine``, of the partial sketches of up to ``tasks`` tasks, level by level."""
    while tasks > FAN:
        sketches = _merge_stage(sketches.withColumn("salt", F.floor(F.col("salt") / FAN).cast("int")), by_salt=True)
        tasks = -(-tasks // FAN)
    return _merge_stage(sketches, by_salt=False)


def percentiles(sketches: DataFrame, ps: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """``grp, metric, n, p50, ..., rank_error`` from combined sketches (one set per group)."""
    names = [f"p{round(100 * p)}" for p in ps]
    types = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * len(ps), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for group, metric, _, sketch, error in _grouped(batches, False):
            values, cumulated = weigh(sketch)
            rows.append((group, metric, int(cumulated[-1]), *(percentile(values, cumulated, p) for p in ps), error))
        columns = list(zip(*rows)) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], ["grp", "metric", "n", *names, "rank_error"])

    # The rows of a group already lie together, in order, after combining.
    return sketches.mapInArrow(run, f"grp string, metric string, n bigint, {', '.join(f'{x} double' for x in names)}, rank_error bigint")


def first_logged(requests: DataFrame, columns: Sequence[str], key: str = "request_id", order: str = "logged_at") -> DataFrame:
    """Each request once, by its earliest log line."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last()))
    return requests.select(key, order, *columns).withColumn("_first", first).where("_first = 1").drop("_first", key, order)


METRICS = ("ttft_ms", "itl_mean_ms", "total_ms")


def request_sketches(requests: DataFrame) -> DataFrame:
    """Combined sketches of the request log per (concurrency, run_day) and per client_key."""
    once = first_logged(requests, ["client_key", "concurrency", "run_day", *METRICS])
    day = F.concat_ws("|", F.coalesce(F.col("concurrency").cast("string"), F.lit("")), F.coalesce(F.col("run_day").cast("string"), F.lit("")))
    # The shuffle that keeps each request once decides the number of tasks.
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return combine_tree(build(once, {"day": day, "client": F.col("client_key")}, METRICS), tasks)


def request_percentiles(sketches: DataFrame) -> DataFrame:
    """The percentiles with the group keys as columns again."""
    wide = percentiles(sketches)
    kind = F.when(F.col("grp").startswith("day"), F.lit("concurrency_day")).otherwise(F.lit("client"))
    tail = F.when(F.substring("grp", -1, 1) == "!", F.lit(None))
    part = F.split(F.expr("substring(grp, 5)"), r"\|")
    is_day = kind == "concurrency_day"
    client = F.when(~is_day & F.col("grp").startswith("client|"), F.expr("substring(grp, 8)")).otherwise(tail)
    blank = lambda c: F.when(c == "", None).otherwise(c)
    return wide.select(
        kind.alias("grouping"),
        F.when(is_day, blank(part[0]).try_cast("int")).alias("concurrency"),
        F.when(is_day, blank(part[1]).try_cast("date")).alias("run_day"),
        client.alias("client_key"), "metric", "n", "p50", "p95", "p99", "rank_error",
    )


def combine_days(sketches: DataFrame) -> DataFrame:
    """Sketches per concurrency over all days, from the day sketches alone."""
    days = sketches.where(F.col("grp").startswith("day|")).withColumn("grp", F.concat(F.lit("day|"), F.split("grp", r"\|")[1], F.lit("|")))
    return combine(days)


def describe(sketches: DataFrame) -> DataFrame:
    """One row per stored buffer: its group, metric, level, error, the values it stands for, and its ends."""
    size = F.size("vals")
    return sketches.select("grp", "metric", "level", "error", size.alias("n_stored"), (size * F.pow(F.lit(2), F.col("level"))).cast("bigint").alias("n_values"), F.get("vals", F.lit(0)).alias("low"), F.get("vals", size - 1).alias("high"))


class SketchStore:
    """Sketches of the parts (days, files) of a request log under one folder, with the ids of their requests."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def parts(self) -> list[str]:
        """The names of the parts; an empty store has none."""
        try:
            return sorted(str(r.part) for r in self.spark.read.parquet(f"{self.folder}/ids").select("part").distinct().collect())
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def add(self, part: str, requests: DataFrame) -> None:
        """Adds or replaces a part; requests that other parts have are left out."""
        others = [p for p in self.parts() if p != part]
        rows = requests
        if others:
            seen = self.spark.read.parquet(*(f"{self.folder}/ids/part={p}" for p in others)).select("request_id")
            rows = requests.join(seen, "request_id", "left_anti")
        request_sketches(rows).write.mode("overwrite").parquet(f"{self.folder}/sketches/part={part}")
        rows.select("request_id").distinct().write.mode("overwrite").parquet(f"{self.folder}/ids/part={part}")

    def combined(self, parts: Sequence[str] | None = None) -> DataFrame:
        """One sketch per group and metric of all parts, or of some."""
        names = list(self.parts() if parts is None else parts)
        if not names:
            return self.spark.createDataFrame([], SKETCH)
        both = None
        for number, part in enumerate(names):
            one = self.spark.read.schema(SKETCH).parquet(f"{self.folder}/sketches/part={part}").withColumn("salt", F.lit(number))
            both = one if both is None else both.unionByName(one)
        return combine_tree(both, len(names))


def bounds_kept(requests: DataFrame, sketches: DataFrame) -> DataFrame:
    """Per group and metric, the number of values and whether each percentile's true rank is within the stated error, by counting the rows on both sides of it."""
    found = request_percentiles(sketches)
    once = first_logged(requests, ["client_key", "concurrency", "run_day", *METRICS])
    named = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS)))
    values = once.select("client_key", "concurrency", "run_day", named.alias("e")).select("client_key", "concurrency", "run_day", "e.*").where("v >= 0 AND NOT isnan(v) AND v < double('infinity')")
    as_groups = F.explode(F.array(
        F.struct(F.lit("concurrency_day").alias("grouping"), F.col("concurrency"), F.col("run_day"), F.lit(None).cast("string").alias("client_key")),
        F.struct(F.lit("client").alias("grouping"), F.lit(None).cast("int").alias("concurrency"), F.lit(None).cast("date").alias("run_day"), F.col("client_key")),
    ))
    rows = values.select("metric", "v", as_groups.alias("g")).select("metric", "v", "g.*")
    keys = ["grouping", "concurrency", "run_day", "client_key", "metric"]
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = rows.alias("a").join(found.alias("b"), same).select(*(F.col(f"a.{k}") for k in keys), "v", "n", "p50", "p95", "p99", "rank_error")
    ok = F.max("n") == F.count("*")
    for p in (50, 95, 99):
        rank = F.greatest(F.ceil(F.lit(p / 100) * F.max("n")), F.lit(1))
        below, upto = F.count_if(F.col("v") < F.col(f"p{p}")), F.count_if(F.col("v") <= F.col(f"p{p}"))
        ok &= (below + 1 - F.max("rank_error") <= rank) & (rank <= upto + F.max("rank_error"))
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), ok.alias("within"))

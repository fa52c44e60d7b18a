"""Task matrices, prompt grids and comparisons of generations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators.sample import draw, group_rank


#: Rows of an axis of a task matrix.
AXIS_ROWS = 10_000


def task_matrix(axes: Sequence[DataFrame], quota: int, seed: int = 42) -> DataFrame:
    """All combinations of small axes in seeded order, repeated in turn up to ``quota`` rows with a dense ``task_idx``.

    The axes are lists of a configuration; more than ``AXIS_ROWS`` rows in one raise.
    """
    for axis in axes:
        if axis.limit(AXIS_ROWS + 1).count() > AXIS_ROWS:
            raise ValueError(f"an axis of more than {AXIS_ROWS} rows")
    grid = axes[0]
    for axis in axes[1:]:
        grid = grid.crossJoin(axis)
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in grid.columns))
    whole = Window.partitionBy(F.lit(0))
    ranked = grid.withColumn("_place", F.row_number().over(whole.orderBy(draw(seed, F.lit("task"), key))) - 1).withColumn("_all", F.count("*").over(whole))
    times = F.sequence(F.lit(0), F.floor((F.lit(quota) - 1 - F.col("_place")) / F.col("_all")).cast("int"))
    return ranked.where(F.col("_place") < quota).withColumn("_round", F.explode(times)).withColumn("task_idx", F.col("_round") * F.col("_all") + F.col("_place")).drop("_place", "_all", "_round")


def parameter_grid(df_ranks: DataFrame, df_rates: DataFrame) -> DataFrame:
    """Rank times learning rate, alpha twice the rank."""
    return df_ranks.crossJoin(df_rates).withColumn("alpha", F.col("rank") * 2)


def picked(seed: int, index: Column, low: int, high: int) -> Column:
    """A seeded count between both bounds, per task."""
    digits = F.conv(F.substring(draw(seed, F.lit("count"), index), 1, 12), 16, 10).cast("bigint")
    return (F.lit(low) + F.pmod(digits, F.lit(high - low + 1))).cast("int")


def pick_examples(matrix: DataFrame, seeds: DataFrame, on: str, seed_key: str, low: int, high: int, seed: int = 42, index: str = "task_idx") -> DataFrame:
    """``index``, the seeds' columns and ``place``: for each task a seeded number of distinct seeds of its ``on`` value, in seeded order.

    ``seeds`` is a list of a configuration and ``high`` is small; tasks are joined with the seeds of their value only.
    """
    joined = matrix.select(index, on).join(seeds, on).withColumn("_draw", draw(seed, F.col(index), seed_key))
    place = F.row_number().over(Window.partitionBy(index).orderBy("_draw", seed_key))
    return joined.withColumn("place", place).where(F.col("place") <= picked(seed, F.col(index), low, high)).drop("_draw")


def zip_rows(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """Rows of both sides at the same position of their orders, strictly: sides of different size raise. Columns must differ."""
    a, b = group_rank(left, [], left_order, "position"), group_rank(right, [], right_order, "_position")
    paired = F.col("position").isNotNull() & F.col("_position").isNotNull()
    joined = a.join(b, F.col("position") == F.col("_position"), "full")
    return joined.withColumn("position", F.when(paired, F.col("position")).otherwise(F.raise_error(F.lit("sides of different size")).cast("bigint"))).drop("_position")


def compare_generations(before: DataFrame, after: DataFrame, key: str, mode: str = "exact", prefix: int = 16) -> DataFrame:
    """Verdict per prompt of two runs with ``text`` and ``token_ids``: equal texts, or equal first tokens. Unpaired prompts raise."""
    if mode not in ("exact", "prefix"):
        raise ValueError(f"unknown mode {mode!r}")
    a = before.select(key, F.col("text").alias("text_a"), F.col("token_ids").alias("ids_a"), F.lit(True).alias("in_a"))
    b = after.select(key, F.col("text").alias("text_b"), F.col("token_ids").alias("ids_b"), F.lit(True).alias("in_b"))
    paired = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    same = F.col("text_a").eqNullSafe(F.col("text_b")) if mode == "exact" else F.slice("ids_a", 1, prefix).eqNullSafe(F.slice("ids_b", 1, prefix))
    match = F.when(paired, same).otherwise(F.raise_error(F.concat(F.lit("unpaired prompt: "), F.col(key).cast("string"))).cast("boolean"))
    return a.join(b, key, "full").select(key, match.alias("match"), X.first_difference(F.col("text_a"), F.col("text_b")).alias("first_char"), "text_a", "text_b")


def first_token_difference(a: Column, b: Column) -> Column:
    """0-based place of the first different token, the shorter length if one starts the other, NULL if equal."""
    shorter = F.least(F.size(a), F.size(b))
    place = F.array_position(F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(place > 0, (place - 1).cast("int")).when(F.size(a) != F.size(b), shorter)


def consistency(verdicts: DataFrame, key: str) -> DataFrame:
    """Totals of verdicts; an empty comparison is consistent. The prompts that differ are ``mismatches``."""
    return verdicts.agg(F.count("*").alias("n_total"), F.count_if(~F.col("match")).alias("n_mismatch"), F.coalesce(F.bool_and("match"), F.lit(True)).alias("consistent"))


def mismatches(verdicts: DataFrame, key: str) -> DataFrame:
    """The prompts that differ, a row each."""
    return verdicts.where(~F.col("match")).select(key)


def count_changed(verdicts: DataFrame) -> DataFrame:
    """``n_changed, n_total`` of compared texts, whatever the verdict's mode."""
    return verdicts.agg(F.count_if(F.col("first_char").isNotNull()).alias("n_changed"), F.count("*").alias("n_total"))

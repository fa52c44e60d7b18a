"""Scores of judges: cross tables, pairwise differences, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that come first, in this order.
FIRST_TAGS = ("base", "sft", "dpo")


def tag_order(tag: Column) -> Column:
    place = F.array_position(F.array(*(F.lit(t) for t in FIRST_TAGS)), tag)
    return F.when(place > 0, place).otherwise(len(FIRST_TAGS) + 1)


def population_std(x: Column) -> Column:
    """Population deviation of integers from exact sums, equal in every engine."""
    n, total, squares = F.count(x), F.sum(x.cast("bigint")), F.sum(x.cast("bigint") * x.cast("bigint"))
    return F.sqrt((n * squares - total * total).cast("double")) / n


def long_scores(df: DataFrame, scores: str = "scores", *keep: str) -> DataFrame:
    """One row per dimension of a map of scores; NULL scores are left out."""
    return df.select(*keep, F.explode(scores).alias("dimension", "score")).where("score IS NOT NULL")


def cross_table(long: DataFrame, judge: str, tag: str, scenario: str) -> DataFrame:
    """Mean, population deviation and count per judge, tag and dimension, per scenario and overall (``all``)."""
    named = long.withColumn(scenario, F.coalesce(scenario, F.lit("(none)")))
    j, t, s, d = (F.col(c) for c in (judge, tag, scenario, "dimension"))
    out = named.groupingSets([[j, t, s, d], [j, t, d]], j, t, s, d).agg(
        (F.sum("score") / F.count("score")).alias("mean"), population_std(F.col("score")).alias("std"), F.count("score").alias("n")
    )
    return out.withColumn(scenario, F.coalesce(scenario, F.lit("all")))


def average_over_judges(table: DataFrame, tag: str) -> DataFrame:
    """Mean of the judges' means per tag and dimension."""
    return table.groupBy(tag, "dimension").agg(F.avg("mean").alias("mean"), F.count("*").alias("judges"))


def pairwise(table: DataFrame, judge: str, tag: str, threshold: float = 0.1) -> DataFrame:
    """Differences of rounded means of all pairs of tags, the later minus the earlier; ``no_diff`` below the threshold."""
    own = table.withColumn("ord", tag_order(F.col(tag)))
    a, b = own.alias("a"), own.alias("b")
    later = (F.col("a.ord") < F.col("b.ord")) | ((F.col("a.ord") == F.col("b.ord")) & (F.col(f"a.{tag}") < F.col(f"b.{tag}")))
    joined = a.join(b, (F.col(f"a.{judge}") == F.col(f"b.{judge}")) & (F.col("a.dimension") == F.col("b.dimension")) & later)
    diff = F.round(F.round("b.mean", 3) - F.round("a.mean", 3), 3)
    return joined.select(
        F.col(f"a.{judge}").alias(judge), F.col("a.dimension").alias("dimension"), F.col(f"a.{tag}").alias("tag_a"), F.col(f"b.{tag}").alias("tag_b"),
        diff.alias("diff"), (F.abs(diff) < threshold).alias("no_diff"),
    )


def cost(usage: DataFrame, pricing: DataFrame, model: str = "model") -> DataFrame:
    """Tokens per model and their price per million; models without a price have NULL and are flagged."""
    sums = usage.groupBy(model).agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    joined = sums.join(pricing, model, "left")
    usd = F.col("prompt_tokens") / 1e6 * F.col("prompt_usd") + F.col("completion_tokens") / 1e6 * F.col("completion_usd")
    return joined.select(model, "requests", "prompt_tokens", "completion_tokens", usd.alias("usd"), usd.isNull().alias("unpriced"))

"""Rule flags of replies and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as X

RULES = ("pattern_hit", "over_length", "role_break", "no_question")


def rule_flags(reply: Column, scenario: Column, patterns: Sequence[str] = (), role_patterns: Sequence[str] = (), max_tokens: int = 120, asking: Sequence[str] = ()) -> Column:
    """Struct of four flags: an unwanted pattern, too many tokens, a break of role, and no question where one is due. A NULL reply has none."""
    text = F.coalesce(reply, F.lit(""))
    return F.struct(
        X.matches_any(text, list(patterns)).alias("pattern_hit"), (X.count_tokens(text) > max_tokens).alias("over_length"),
        X.matches_any(text, list(role_patterns)).alias("role_break"), (F.coalesce(scenario.isin(*asking), F.lit(False)) & ~F.contains(text, F.lit("?"))).alias("no_question"),
    )


def failures(flags: Column, detail: Column) -> Column:
    """Array of {rule, detail} of the raised flags, in a fixed order."""
    return F.array_compact(F.array(*(F.when(flags[r], F.struct(F.lit(r).alias("rule"), detail.cast("string").alias("detail"))) for r in RULES)))


def summarise(df: DataFrame, flags: str, rules: Sequence[str], tokens: str, scenario: str = "scenario") -> DataFrame:
    """Counts and rates of flags and exact length percentiles, per scenario and overall (``all``)."""
    aggregates = [F.count("*").alias("n")]
    for rule in rules:
        hit = F.count_if(F.col(f"{flags}.{rule}"))
        aggregates += [hit.alias(f"n_{rule}"), (hit / F.count("*")).alias(f"rate_{rule}")]
    aggregates += [F.avg(tokens).alias("tokens_mean"), F.min(tokens).alias("tokens_min"), F.max(tokens).alias("tokens_max")]
    aggregates += [F.percentile(tokens, p / 100).alias(f"tokens_p{p}") for p in (50, 90, 95)]
    named = df.withColumn(scenario, F.coalesce(scenario, F.lit("(none)")))
    return named.groupingSets([[F.col(scenario)], []], F.col(scenario)).agg(*aggregates).withColumn(scenario, F.coalesce(scenario, F.lit("all")))

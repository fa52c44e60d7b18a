"""Latency and throughput of streams and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import gaps
from colloquy.operators.percentiles import with_percentiles


def summarise_stream(start: Column, chunks: Column, tokens: Column) -> Column:
    """Struct of first-chunk time, total, gaps and their mean, in seconds; NULL without chunks; decreasing times raise."""
    size = F.size(chunks)
    gaps = F.zip_with(F.slice(chunks, F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice(chunks, F.lit(1), F.greatest(size - 1, F.lit(0))), lambda a, b: a - b)
    checked = F.when(F.exists(gaps, lambda g: g < 0), F.raise_error(F.lit("chunk times decrease")).cast("array<double>")).otherwise(gaps)
    live = size > 0
    total = F.aggregate(checked, F.lit(0.0), lambda a, x: a + x)
    return F.struct(
        F.when(live, F.get(chunks, F.lit(0)) - start).alias("ttft"), F.when(live, F.get(chunks, size - 1) - start).alias("total"), checked.alias("gaps"),
        F.when(F.size(checked) > 0, total / F.size(checked)).alias("gap_mean"), F.coalesce(tokens, size).alias("tokens"),
    )


def request_row(start: Column, stream: Column, ok: Column) -> Column:
    """A stream summary as a log row in milliseconds."""
    return F.struct(start.alias("start_ts"), (stream["ttft"] * 1000).alias("ttft_ms"), (stream["gap_mean"] * 1000).alias("itl_mean_ms"), (stream["total"] * 1000).alias("total_ms"), stream["tokens"].alias("n_output_tokens"), ok.alias("ok"))


def drop_warmup(df: DataFrame, seconds: float, *tier: str, start: str = "start_ts") -> DataFrame:
    """Rows from ``seconds`` after the first start of their tier on; failed rows count for the first start.

    The first starts are aggregated before the join, so a tier never gathers in one task.
    """
    if seconds <= 0:
        return df
    first = df.groupBy(*tier).agg(F.min(start).alias("_first"))
    same = None
    for c in tier:
        one = F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
        same = one if same is None else same & one
    joined = df.alias("l").join(first.alias("r"), same if same is not None else F.lit(True))
    return joined.where(F.col(f"l.{start}") >= F.col("r._first") + seconds).select("l.*")


def tier_rollup(df: DataFrame, run_seconds: float, warmup_seconds: float, *tier: str) -> DataFrame:
    """Steady-state rollup of each tier: exact percentiles over good rows, tokens and requests per second of the window, error rate over all rows."""
    window = run_seconds - warmup_seconds
    if window <= 0:
        raise ValueError("the run must be longer than the warm-up")
    good = F.col("ok")
    steady = drop_warmup(df, warmup_seconds, *tier)
    rollup = steady.groupBy(*tier).agg(
        F.count("*").alias("n"), F.count_if(good).alias("n_ok"),
        (F.sum(F.when(good, F.coalesce("n_output_tokens", F.lit(0))).otherwise(0)) / window).alias("tokens_per_s"), (F.count_if(good) / window).alias("requests_per_s"),
        (F.count_if(~F.coalesce(good, F.lit(False))) / F.count("*")).alias("error_rate"),
    )
    ps = (0.5, 0.95)
    return with_percentiles(rollup, steady, tier, {"ttft": (F.when(good, F.col("ttft_ms")), ps), "itl": (F.when(good, F.col("itl_mean_ms")), ps)})


def aggregate_streams(df: DataFrame, stream: str, *group: str) -> DataFrame:
    """Rollup of stream summaries; streams without output count but give no times."""
    t, total, ps = f"{stream}.ttft", f"{stream}.total", (0.5, 0.95)
    rollup = df.groupBy(*group).agg(
        F.count("*").alias("n"), F.count(t).alias("n_with_output"), F.avg(t).alias("ttft_mean"), F.avg(total).alias("total_mean"), F.sum(f"{stream}.tokens").alias("tokens")
    )
    return with_percentiles(rollup, df, group, {"ttft": (F.col(t), ps), "total": (F.col(total), ps)})


__all__ = ["aggregate_streams", "drop_warmup", "gaps", "positive", "request_row", "speedup", "summarise_stream", "throughput", "tier_rollup"]


def positive(value: Column, name: str) -> Column:
    return F.when(value > 0, value).otherwise(F.raise_error(F.lit(f"{name} must be positive")).cast("double"))


def speedup(single_s: Column, wall_s: Column, n: Column) -> Column:
    return n * single_s / positive(wall_s, "wall time")


def throughput(tokens: Column, wall_s: Column) -> Column:
    return tokens / positive(wall_s, "wall time")

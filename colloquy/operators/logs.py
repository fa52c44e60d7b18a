"""Series out of trainer logs, and nested configuration edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def log_series(state: DataFrame, metrics: Sequence[str], history: str = "log_history") -> DataFrame:
    """``metric, step, value`` in long form from an array of log entries; entries without a step or value are skipped."""
    fields = set(state.selectExpr(f"inline({history})").columns)
    rows = state.select(F.explode(history).alias("e")).where("e.step IS NOT NULL")
    present = [m for m in metrics if m in fields]
    if not present:
        return state.sparkSession.createDataFrame([], "metric string, step bigint, value double")
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"e.{m}").cast("double").alias("value")) for m in present)))
    return rows.select(F.col("e.step").cast("bigint").alias("step"), pairs.alias("p")).select("p.metric", "step", "p.value").where("value IS NOT NULL")


def best_loss(state: DataFrame, history: str = "log_history", metric: str = "eval_loss") -> float | None:
    """The least logged value, or None."""
    return log_series(state, [metric], history).agg(F.min("value")).first()[0]


def ranked_runs(runs: DataFrame, loss: str = "best_loss") -> DataFrame:
    """Runs by their best loss, those without one last."""
    return runs.orderBy(F.asc_nulls_last(loss))


def strip_keys(node: object, keys: Sequence[str], path: str = "") -> list[str]:
    """Removes keys anywhere in nested JSON in place; returns the paths removed."""
    removed: list[str] = []
    if isinstance(node, dict):
        for key in [k for k in node if k in keys]:
            del node[key]
            removed.append(f"{path}.{key}".lstrip("."))
        for key, value in node.items():
            removed += strip_keys(value, keys, f"{path}.{key}")
    elif isinstance(node, list):
        for i, value in enumerate(node):
            removed += strip_keys(value, keys, f"{path}[{i}]")
    return removed

"""The pipelines as one call each: normalise sources, split with a leakage gate, evaluate replies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.operators import clean, dedup, rules, sample
from colloquy.session import durable
from colloquy.sources import formats


class LeakageFound(RuntimeError):
    """Near-equal records lie in different splits."""


def normalise_sources(sources: Sequence[tuple[str, str, DataFrame]], keywords: Mapping[str, list[str]], min_chars: int = 2) -> tuple[DataFrame, DataFrame]:
    """(tag, format, rows) of each source through conversion and cleaning: kept records, and the drop report."""
    converted = formats.union_sources([formats.to_records(df, kind, tag) for tag, kind, df in sources])
    order = F.struct(*(c for c in ("_ord", "pair_idx") if c in converted.columns))
    done = durable(clean.normalise(converted.withColumn("_ord", order), dict(keywords), min_chars))
    kept = done.where("drop_reason IS NULL").select(
        F.col("record_id").alias("id"), "source", "scenario", F.lit("en").alias("lang"), "n_turns", F.create_map(F.lit("raw_format"), "raw_format").alias("meta"), F.col("clean_messages").alias("messages"), "_src", "_ord"
    )
    return kept, clean.drop_report(done)


@dataclass
class SplitResult:
    rows: DataFrame
    pairs: DataFrame
    warnings: DataFrame
    stats: dict = field(default_factory=dict)


def split_with_gate(rows: DataFrame, key: str, keywords: Sequence[str] = (), high_value: Sequence[str] = (), ratio: float = 2.0, similarity: float = 0.85, least: int = 20, seed: int = 42, points: float = 3.0, fail: bool = True) -> SplitResult:
    """Near dedup before the split, downsampling of real rows, stratified split, drift warnings, leakage gate."""
    own = durable(rows.withColumn("_text", M.canonical_text(F.col("messages"))))
    grouped = dedup.clusters(*dedup.similar_texts(own, key, F.col("_text"), similarity)).withColumnRenamed("key", key)
    # Records without a shingle are clusters of their own.
    joined = own.join(grouped, key, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.col(key)))
    best = dedup.keep_best(joined, "cluster_id", key, ~dedup.is_real(F.col("source")), -M.length(F.col("messages"))).where("kept").drop("kept")
    word = dedup.X.has_keyword(M.full_text(F.col("messages")), list(keywords))
    down = sample.downsample(best, key, dedup.is_real(F.col("source")), F.col("scenario").isin(*high_value), word, ratio, seed).where("kept").drop("kept", "why")
    strata = sample.with_strata(down.withColumn("bucket", M.turn_bucket(F.col("n_turns"))), "scenario", "bucket", least)
    split = durable(sample.stratified_split(strata, "stratum", key, seed=seed))
    pairs = durable(dedup.leakage(split, key, F.col("_text"), "split", similarity))
    leaks = pairs.agg(F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n")).first().n
    stats = {r.split: r["count"] for r in split.groupBy("split").count().collect()} | {"leaks": leaks}
    if fail and leaks:
        raise LeakageFound(f"{leaks} pairs, such as {pairs.orderBy('text_a', 'text_b').limit(10).collect()}")
    return SplitResult(split.drop("_text"), pairs, sample.distribution_warnings(split, "split", "stratum", points), stats)


def evaluate(results: DataFrame, patterns: Sequence[str] = (), role_patterns: Sequence[str] = (), max_tokens: int = 120, asking: Sequence[str] = ()) -> DataFrame:
    """Flags and summaries of results with ``completion`` and ``scenario``."""
    text = dedup.X.strip_reasoning(F.coalesce("completion", F.lit("")))
    flags = rules.rule_flags(text, F.col("scenario"), patterns, role_patterns, max_tokens, asking)
    return rules.summarise(results.select("scenario", flags.alias("flags"), dedup.X.count_tokens(text).alias("tokens")), "flags", rules.RULES, "tokens")

"""The cleaning chain: short turns, language, redaction, tail, identity; a reason instead of a dropped row.

``drop_reason`` is NULL for kept rows. The order is fixed: conversion, empty
after filtering, language, duplicate, validation. Duplicates are marked before
validation, so repeats of an invalid record count as duplicates and only the
first as invalid; replacements are counted before either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.operators.dedup import mark_first
from colloquy.session import durable

#: Frequent words by which a language is told when no label is given.
PROFILES = {
    "en": ["the", "and", "you", "is", "of", "to", "for", "with", "that", "it", "in", "are", "this", "on"],
    "de": ["der", "die", "das", "und", "ich", "sie", "ist", "nicht", "mit", "für", "wir", "ein", "im"],
    "fr": ["le", "la", "les", "et", "vous", "nous", "est", "de", "pour", "avec", "une", "que", "je"],
    "es": ["el", "los", "y", "usted", "que", "es", "para", "con", "una", "por", "su", "la", "en"],
}


def detect_language(messages: Column) -> Column:
    """The language whose frequent words occur most in the contents of all but system messages; ``unknown`` without any."""
    spoken = F.filter(messages, lambda m: m["role"] != "system")
    words = F.split(F.lower(M.full_text(spoken)), r"[^\p{L}]+")
    hits = lambda own: F.size(F.filter(words, lambda w: w.isin(own)))
    scores = [F.struct(hits(own).alias("n"), F.lit(-i).alias("tie"), F.lit(code).alias("code")) for i, (code, own) in enumerate(PROFILES.items())]
    best = F.greatest(*scores)
    return F.when(best["n"] > 0, best["code"]).otherwise("unknown")


def clean(records: DataFrame, min_chars: int = 2, language: Column | None = None, keep: str = "en") -> DataFrame:
    """Adds ``clean_messages, pii_replacements, drop_reason`` to rows with ``messages``."""
    long_enough = F.filter("messages", lambda m: F.coalesce(F.length(X.strip(m["content"])), F.lit(0)) >= min_chars)
    df = records.withColumn("_kept", M.merge_runs(long_enough))
    lang = language if language is not None else detect_language(F.col("_kept"))
    # Redaction by message: text and count together, so each pattern runs once per text and use.
    both = F.transform("_kept", lambda m: F.struct(m["role"].alias("role"), X.redact(m["content"])[0].alias("content"), X.redact(m["content"])[1].alias("n")))
    reason = (
        F.when(F.col("messages").isNull(), "conversion_failed")
        .when(M.n_assistant(F.col("_kept")) == 0, "empty_after_filter")
        .when(~F.coalesce(lang == keep, F.lit(False)), f"not_{keep}")
    )
    df = df.withColumn("drop_reason", reason)
    live = F.col("drop_reason").isNull()
    df = df.withColumn("_both", F.when(live, both))
    count = F.aggregate("_both", F.lit(0), lambda n, m: n + m["n"])
    redacted = F.transform("_both", lambda m: M.message(m["role"], m["content"]))
    return df.withColumn("pii_replacements", F.coalesce(count, F.lit(0))).withColumn("clean_messages", M.cut_tail(redacted)).drop("_kept", "_both")


def mark_duplicates(df: DataFrame, messages: str = "clean_messages", order: tuple[str, ...] = ("_src", "_ord")) -> DataFrame:
    """Adds ``record_id``; all but the first row of each content get the reason ``duplicate``."""
    # The cleaned rows are used twice from here on; they are computed once.
    df = durable(df.withColumn("record_id", M.dialogue_id(F.col(messages))))
    live = F.col("drop_reason").isNull()
    # Rows dropped before keep a content of their own.
    content = F.when(live, F.col("record_id")).otherwise(F.concat_ws("|", F.lit("dropped"), *(F.col(o).cast("string") for o in order)))
    marked = mark_first(df, content, *order, name="_first")
    return marked.withColumn("drop_reason", F.when(live & ~F.col("_first"), "duplicate").otherwise(F.col("drop_reason"))).drop("_first")


def mark_invalid(df: DataFrame, messages: str = "clean_messages") -> DataFrame:
    errors = M.validation_errors(F.col(messages), M.n_assistant(F.col(messages)), F.lit("en"))
    return df.withColumn("drop_reason", F.when(F.col("drop_reason").isNull() & (F.size(errors) > 0), "validation_failed").otherwise(F.col("drop_reason")))


def tag_scenario(text: Column, keywords: dict[str, list[str]], default: str = "general") -> Column:
    """The scenario with most keyword hits; ties go to the first in the order given, none to the default."""
    if not keywords:
        return F.lit(default)
    scores = []
    for i, (name, own) in enumerate(keywords.items()):
        hits = sum((X.count_substring(text, k) for k in own), F.lit(0))
        scores.append(F.struct(hits.alias("n"), F.lit(-i).alias("tie"), F.lit(name).alias("name")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when(best["n"] > 0, best["name"]).otherwise(default)


def drop_report(df: DataFrame, group: str = "source") -> DataFrame:
    """Rows and replacements per group and reason, with totals: ``kept`` stands for no reason, ``all`` for any group or reason."""
    named = df.withColumn("reason", F.coalesce("drop_reason", F.lit("kept"))).withColumn(group, F.coalesce(group, F.lit("(none)")))
    out = named.groupingSets([[F.col(group), F.col("reason")], [F.col(group)], [F.col("reason")], []], F.col(group), F.col("reason")).agg(
        F.count("*").alias("n"), F.sum("pii_replacements").cast("bigint").alias("pii")
    )
    return out.select(F.coalesce(group, F.lit("all")).alias(group), F.coalesce("reason", F.lit("all")).alias("reason"), "n", "pii")


def normalise(sources: DataFrame, keywords: dict[str, list[str]], min_chars: int = 2) -> DataFrame:
    """Converted sources (``_src, _ord, source, messages``) through the whole chain, with scenario and turns of kept rows."""
    df = mark_invalid(mark_duplicates(clean(sources, min_chars)))
    text = M.full_text(F.col("clean_messages"))
    return df.withColumn("scenario", F.when(F.col("drop_reason").isNull(), tag_scenario(text, keywords))).withColumn("n_turns", M.n_assistant(F.col("clean_messages")))

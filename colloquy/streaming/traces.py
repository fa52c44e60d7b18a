"""Streams: turns of conversations appended to sinks, and rollups by event time.

Extensions beyond batch: watermarked windows and per-conversation state.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from colloquy.functions import text as X
from colloquy.operators import rules


def window_rollup(events: DataFrame, ts: str, value: str, key: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum per key and tumbling or sliding window; with ``late`` a watermark bounds the state of a stream."""
    own = events.withWatermark(ts, late) if late else events
    frame = F.window(ts, width, slide) if slide else F.window(ts, width)
    return own.groupBy(frame.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total"
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions per key: events less than ``gap`` apart."""
    own = events.withWatermark(ts, late) if late else events
    return own.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


Sink = Callable[[DataFrame, int], None]


def json_sink(path: str) -> Sink:
    """Appends each micro-batch as JSON lines under its number, so that a repeated batch replaces itself."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    return write


def fan_out(sinks: Sequence[Sink], failures: list[str] | None = None) -> Sink:
    """Several sinks of one stream; the batch is computed once. With ``failures`` errors of a sink are noted there and don't stop the others."""
    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                try:
                    sink(batch, number)
                except Exception as error:
                    if failures is None:
                        raise
                    failures.append(f"batch {number}: {error}")
        finally:
            batch.unpersist()

    return write


def sink_provider(settings: Mapping[str, str] = os.environ, names: Sequence[str] = ()) -> str:
    """``remote`` if every named setting is there and not blank, else ``local``; without names it is ``local``."""
    return "remote" if names and all(settings.get(n, "").strip() for n in names) else "local"


def make_sink(path: str, provider: str = "auto", remote: Sink | None = None, failures: list[str] | None = None, settings: Mapping[str, str] = os.environ, names: Sequence[str] = ()) -> Sink | None:
    """The sink of a run: ``local`` files, ``remote`` as well (best effort, its errors are noted), ``auto`` by the settings, ``disabled`` none."""
    if provider == "auto":
        provider = "remote" if remote is not None and sink_provider(settings, names) == "remote" else "local"
    if provider == "disabled":
        return None
    if provider == "local":
        return json_sink(path)
    if provider == "remote" and remote is not None:
        noted = failures if failures is not None else []
        return fan_out([json_sink(path), fan_out([remote], noted)])
    raise ValueError(f"unknown provider {provider!r}, or no remote sink given")


def evaluation_turns(results: DataFrame, model: str, flags: Column | None = None) -> DataFrame:
    """Evaluated generations as turns: ``conversation_id`` (the sample's id), ``turn_index``, content without reasoning, latency, tokens, failures."""
    failed = rules.failures(flags, F.lit(None)) if flags is not None else F.array().cast("array<struct<rule:string,detail:string>>")
    have = lambda name, kind: (F.col(name) if name in results.columns else F.lit(None)).cast(kind).alias(name)
    return results.select(
        F.col("id").alias("conversation_id"), F.lit(0).alias("turn_index"), X.strip_reasoning(F.coalesce("completion", F.lit(""))).alias("content"), F.lit(model).alias("model"),
        have("latency_ms", "double"), have("prompt_tokens", "bigint"), have("completion_tokens", "bigint"), failed.alias("failures"),
    )


def usage_struct(reply: Column) -> Column:
    """Token counts of a reply's JSON (``usage``); missing ones are NULL."""
    number = lambda name: F.get_json_object(reply, f"$.usage.{name}").cast("bigint").alias(name)
    return F.struct(number("prompt_tokens"), number("completion_tokens"), number("total_tokens"))


def readiness_url(endpoint: Column) -> Column:
    """Where an endpoint tells that it is ready: its list of models."""
    return F.concat(F.rtrim(endpoint, F.lit("/")), F.lit("/models"))


def record_turns(turns: DataFrame, sink: Sink, checkpoint: str):
    """Starts the query that hands micro-batches of turns to a sink until the input is used up."""
    return turns.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CONVERSATION = "conversation_id string, turns bigint, failures bigint, latency_ms double"


def conversation_state(turns: DataFrame, idle_ms: int | None = 600_000) -> DataFrame:
    """A running total per conversation (turns, failed turns, latency), kept in state that ends after idling; with None it stays."""
    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, bad, latency = state.get if state.exists else (0, 0, 0.0)
        for frame in frames:
            n += len(frame)
            bad += int(frame["failed"].sum())
            latency += float(frame["latency_ms"].fillna(0).sum())
        state.update((n, bad, latency))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conversation_id": [key[0]], "turns": [n], "failures": [bad], "latency_ms": [latency]})

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return turns.groupBy("conversation_id").applyInPandasWithState(update, CONVERSATION, "turns bigint, failures bigint, latency_ms double", "update", timeout)


def trace_summary(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, failed turns, latency and tokens."""
    return turns.groupBy("conversation_id").agg(
        F.count("*").alias("turns"), F.count_if(F.size("failures") > 0).alias("failed_turns"), F.sum("latency_ms").alias("latency_ms"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
    )

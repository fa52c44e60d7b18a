"""Runs over rows with an injected client: generation, synthesis with gates, judging, streamed calls.

A run asks in rounds. Every round is one distributed pass over the rows that have no
accepted reply yet, written to the checkpoint folder, so a lost executor repeats only
calls of its own tasks and nothing is asked twice for a later look at the results.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import json as J
from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.operators import judge, latency
from colloquy.operators.remote import call_rows
from colloquy.session import durable

Client = Callable[[str], tuple[str, int, int]]


@dataclass
class Run:
    """``accepted``: key, reply and the gate's struct; ``abandoned``: key and the last error; ``usage``: a row per request with its tokens."""

    accepted: DataFrame
    abandoned: DataFrame
    usage: DataFrame


def ask_until(rows: DataFrame, key: str, prompt: str, make_client: Callable[[], Client], gate: Callable[[Column], Column], rounds: int = 3, **options) -> Run:
    """Asks until ``gate`` (a struct with ``error``) accepts the reply, at most ``rounds`` times a row; tokens of rejected replies count."""
    pending, accepted, usage, last = rows.select(key, prompt), [], [], None
    for _ in range(rounds):
        calls = durable(call_rows(pending, key, prompt, make_client, **options).withColumn("gate", gate(F.col("reply"))))
        usage.append(calls.select(key, "prompt_tokens", "completion_tokens"))
        error = F.when(~F.col("ok"), F.col("error")).otherwise(F.col("gate.error"))
        judged = calls.withColumn("failure", error)
        accepted.append(judged.where("failure IS NULL").select(key, "reply", "gate"))
        last = judged.where("failure IS NOT NULL").select(key, F.col("failure").alias("error"))
        if last.isEmpty():
            break
        pending = pending.join(last.select(key), key, "left_semi")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return Run(union(accepted), last, union(usage))


def error_histogram(abandoned: DataFrame) -> DataFrame:
    """Abandoned rows by the kind of their error (what stands before a colon)."""
    return abandoned.groupBy(F.substring_index("error", ":", 1).alias("kind")).agg(F.count("*").alias("n"))


def first_abandoned(abandoned: DataFrame, key: str, count: int = 20) -> DataFrame:
    """The examples of a report: the first ``count`` by key."""
    return abandoned.orderBy(key).limit(count)


def cost_report(run: Run, tasks: DataFrame, key: str, group: str) -> DataFrame:
    """Accepted and abandoned rows, requests and tokens per ``group`` of the tasks."""
    named = tasks.select(key, F.coalesce(F.col(group), F.lit("(none)")).alias(group))
    used = run.usage.groupBy(key).agg(F.count("*").alias("requests"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    kept = run.accepted.select(key, F.lit(1).alias("kept"))
    joined = named.join(used, key, "left").join(kept, key, "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return joined.groupBy(group).agg(F.count("*").alias("tasks"), F.count("kept").alias("accepted"), zero("requests"), zero("prompt_tokens"), zero("completion_tokens"))


def synthesise(tasks: DataFrame, key: str, template: str, slots: dict[str, Column], make_client: Callable[[], Client], gate: Callable[[Column], Column], rounds: int = 3, **options) -> Run:
    """Generated records: the template filled per task, replies through a gate of ``operators.gates``."""
    return ask_until(tasks.withColumn("prompt", X.fill_template(template, **slots)), key, "prompt", make_client, gate, rounds, **options)


@dataclass
class JudgeRun:
    """``scores``: id, tag, scenario, judge and the map of scores; ``failures``: id, tag, judge, error; ``usage``: tokens per judge."""

    scores: DataFrame
    failures: DataFrame
    usage: DataFrame

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """The cross table and the pairwise differences of its totals."""
        whole = judge.cross_table(judge.long_scores(self.scores, "scores", "judge", "tag", "scenario"), "judge", "tag", "scenario")
        return whole, judge.pairwise(whole.where("scenario = 'all'"), "judge", "tag")


def judge_prompt(template: str, messages: Column, reply: Column) -> Column:
    """The prompt of a judge with ``{context}`` and ``{reply}``; it never tells whose reply it is."""
    return X.fill_template(template, context=M.transcript(messages), reply=X.strip(reply))


def run_judge(results: DataFrame, judges: Sequence[str], template: str, make_client: Callable[[str], Callable[[], Client]], dimensions: Sequence[str], rounds: int = 3, **options) -> JudgeRun:
    """Every result (``id, tag, scenario, prompt_messages, completion``) by every judge: jobs, calls with re-asks, scores and tokens."""
    scores = failures = usage = None
    jobs = results.withColumn("job", F.concat_ws("\x1f", "tag", "id")).withColumn("prompt", judge_prompt(template, F.col("prompt_messages"), F.coalesce("completion", F.lit(""))))
    for name in judges:
        run = ask_until(jobs, "job", "prompt", make_client(name), lambda reply: J.parse_scores(reply, dimensions), rounds, **options)
        facts = jobs.select("job", "id", "tag", "scenario", F.lit(name).alias("judge"))
        parts = (
            facts.join(run.accepted.select("job", F.col("gate.scores").alias("scores")), "job").drop("job"),
            facts.join(run.abandoned, "job").drop("job", "scenario"),
            run.usage.agg(F.lit(name).alias("judge"), F.count("*").alias("requests"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens")),
        )
        scores, failures, usage = parts if scores is None else (a.unionByName(b) for a, b in zip((scores, failures, usage), parts))
    return JudgeRun(scores, failures, usage)


def generate_all(samples: DataFrame, key: str, messages: str, make_client: Callable[[], Client], system: str | None = None, **options) -> DataFrame:
    """One reply per sample, by key: the prompt is the rendered chat; reasoning in front of the reply is stripped."""
    prompted = samples.select(key, M.render_chat(M.with_system(F.col(messages), system), True).alias("prompt"))
    return call_rows(prompted, key, "prompt", make_client, **options).withColumn("completion", X.strip_reasoning(F.col("reply")))


STREAMED = "start double, chunk_times array<double>, text string, error string"


def stream_rows(df: DataFrame, key: str, prompt: str, make_client: Callable[[], Callable[[str], Iterable[str]]], concurrency: int = 8, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """Streamed calls, at most ``concurrency`` at a time in a task: start, the time of each chunk with text, and the text; an error ends its row."""
    kind = df.schema[key].dataType.simpleString()

    def one(client: Callable, text: str | None) -> tuple:
        start, times, said = clock(), [], []
        if text is None:
            return start, times, None, "null_prompt"
        try:
            for chunk in client(text):
                if chunk:
                    times.append(clock())
                    said.append(chunk)
        except Exception as error:
            return start, times, "".join(said), f"{type(error).__name__}: {error}"
        return start, times, "".join(said), None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                out = pd.DataFrame(list(pool.map(lambda text: one(client, text), frame[prompt])), columns=["start", "chunk_times", "text", "error"])
                out.insert(0, key, frame[key].to_numpy())
                yield out

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, {STREAMED}")


def stream_rollup(streamed: DataFrame, *group: str) -> DataFrame:
    """Times and throughput of streamed calls: the aggregate of their summaries, the wall time, tokens per second and the speedup over one call after another."""
    own = streamed.where("error IS NULL").withColumn("stream", latency.summarise_stream(F.col("start"), F.col("chunk_times"), F.lit(None).cast("int")))
    last = F.max(F.coalesce(F.element_at("chunk_times", -1), F.col("start")))
    wall = own.where(F.size("chunk_times") > 0).groupBy(*group).agg((last - F.min("start")).alias("wall_s"), F.sum("stream.total").alias("serial_s"), F.sum("stream.tokens").alias("streamed"))
    same = F.lit(True)
    for g in group:
        same &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    joined = latency.aggregate_streams(own, "stream", *group).alias("a").join(wall.alias("b"), same, "left")
    return joined.select("a.*", "wall_s", latency.throughput(F.col("streamed"), F.col("wall_s")).alias("tokens_per_s"), latency.speedup(F.col("serial_s"), F.col("wall_s"), F.lit(1)).alias("speedup"))

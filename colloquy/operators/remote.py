"""Bounded, retried calls of an injected function over rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame


class Retryable(Exception):
    """An error worth another attempt."""


RESULT = "attempts int, ok boolean, reply string, error string, prompt_tokens bigint, completion_tokens bigint"


def call_rows(df: DataFrame, key: str, prompt: str, make_client: Callable[[], Callable[[str], tuple[str, int, int]]], concurrency: int = 8, retries: int = 3, base_s: float = 1.0, cap_s: float = 30.0, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """``key`` and the outcome of each call; one pool per task, at most ``concurrency`` calls at a time.

    ``make_client`` runs once per task and returns a function from prompt to
    (reply, prompt tokens, completion tokens). ``Retryable`` errors and replies
    that ``check`` rejects are tried again with growing waits; tokens of all
    attempts add up; other errors end the job. A NULL prompt is not sent.
    """
    kind = df.schema[key].dataType.simpleString()

    def one(client: Callable, text: str | None) -> tuple:
        if text is None:
            return 0, False, None, "null_prompt", 0, 0
        used, made, error = 0, 0, None
        for attempt in range(1, retries + 1):
            try:
                reply, p, c = client(text)
                used, made = used + p, made + c
                error = check(reply) if check else None
                if error is None:
                    return attempt, True, reply, None, used, made
            except Retryable as failure:
                error = f"{type(failure).__name__}: {failure}"
            if attempt < retries:
                time.sleep(min(cap_s, base_s * 2 ** (attempt - 1)) * (1 + 0.25 * random.random()))
        return retries, False, None, error, used, made

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                rows = list(pool.map(lambda text: one(client, text), frame[prompt]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
                out.insert(0, key, frame[key].to_numpy())
                yield out

    return df.select(key, prompt).mapInPandas(run, f"{key} {kind}, {RESULT}")

"""Chat formats to dialogues. A row that cannot be converted keeps NULL messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.functions import text as X

#: Speakers of the conversation format.
SPEAKERS = {"human": "user", "user": "user", "gpt": "assistant", "assistant": "assistant", "system": "system"}


def column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def instruction_pairs(df: DataFrame) -> DataFrame:
    """``instruction``, optional ``input``, ``output`` to a question and an answer."""
    asked, more, said = (X.strip(column_or_null(df, c)) for c in ("instruction", "input", "output"))
    question = F.when(F.coalesce(F.length(more), F.lit(0)) > 0, F.concat_ws("\n\n", asked, more)).otherwise(asked)
    fine = (F.length(asked) > 0) & (F.length(said) > 0)
    return df.withColumn("messages", F.when(fine, F.array(M.message("user", question), M.message("assistant", said))))


def conversations(df: DataFrame) -> DataFrame:
    """``conversations`` array<struct<from, value>>: unknown speakers or missing values fail; system texts go to the front, runs are merged."""
    speaker = F.create_map(*(F.lit(x) for pair in SPEAKERS.items() for x in pair))
    turns = F.transform("conversations", lambda c: M.message(F.try_element_at(speaker, F.coalesce(c["from"], F.lit(""))), c["value"]))
    bad = F.exists(turns, lambda m: m["role"].isNull() | m["content"].isNull())
    body = F.filter(turns, lambda m: m["role"] != "system")
    fine = F.coalesce(~bad & (F.size(body) > 0), F.lit(False))
    return df.withColumn("messages", F.when(fine, M.hoist_system(turns)))


def prefixed_pairs(df: DataFrame, customer: str = "Customer:", seller: str = "Salesman:") -> DataFrame:
    """Wide rows with digit-named columns: neighbouring customer and seller cells become pairs, one row each.

    Columns are taken in numeric order, NULL and blank cells removed. A seller
    cell never starts a pair, so looking one cell ahead equals the greedy scan.
    """
    names = sorted((c for c in df.columns if c.isdigit()), key=int)
    kept = [c for c in df.columns if not c.isdigit()]
    cells = F.filter(F.array(*(F.col(f"`{c}`") for c in names)), lambda c: ~X.is_blank(c))
    pairs = F.zip_with(cells, F.concat(F.slice(cells, 2, 1_000_000), F.array(F.lit(None).cast("string"))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    starts = lambda c, prefix: F.ltrim(c).startswith(prefix)
    found = F.filter(pairs, lambda p: F.coalesce(starts(p["a"], customer) & starts(p["b"], seller), F.lit(False)))
    rows = df.select(*kept, F.posexplode(found).alias("pair_idx", "p"))
    tail = lambda c, prefix: X.strip(F.substring(F.ltrim(c), F.lit(len(prefix) + 1), F.length(c)))
    asked, said = tail(F.col("p.a"), customer), tail(F.col("p.b"), seller)
    fine = (F.length(asked) > 0) & (F.length(said) > 0)
    return rows.withColumn("messages", F.when(fine, F.array(M.message("user", asked), M.message("assistant", said)))).drop("p")


CONVERTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"alpaca": instruction_pairs, "sharegpt": conversations, "prefixed_pairs": prefixed_pairs}


def to_records(df: DataFrame, kind: str, source: str) -> DataFrame:
    """A converted source with ``source, raw_format, messages``; unknown kinds raise."""
    if kind not in CONVERTERS:
        raise ValueError(f"unknown format {kind!r}; known: {sorted(CONVERTERS)}")
    out = CONVERTERS[kind](df)
    order = [c for c in ("_ord", "pair_idx") if c in out.columns]
    return out.select(F.lit(source).alias("source"), F.lit(kind).alias("raw_format"), *order, "messages")


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """All sources, the earlier ones first in ``_src``, for first-wins operators."""
    out = None
    for number, df in enumerate(frames):
        df = df.withColumn("_src", F.lit(number))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

"""Personal information in messages (problem 2), by the character model.

Every message is decoded whole, whatever its role and language; equal messages
of a task are decoded once. Items become typed placeholders in an otherwise
unchanged text, and are counted per record. NULL messages arrays, NULL and blank
contents have no item; a placeholder that stands in a text already is no item of
its own unless the model takes it for one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.pii_model import Weights, find_spans
from colloquy.llm.texts import batches_of
from colloquy.session import spread

WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Placeholders of the kinds.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
SEEN = 100_000
#: Rows decoded together (texts of like length share the steps of the model), or bytes where they are long.
TOGETHER, BYTES = 32_768, 1 << 24

SPAN = "array<struct<first:int,end:int,kind:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches that make TOGETHER rows or BYTES; the last may be fewer."""
    held: list[pa.RecordBatch] = []
    for batch in batches_of(batches, 16384):
        held.append(batch)
        if sum(b.num_rows for b in held) >= TOGETHER or sum(b.nbytes for b in held) >= BYTES:
            yield held
            held = []
    if held:
        yield held


def find_items(texts: DataFrame, text: str, *keep: str, weights: str = WEIGHTS) -> DataFrame:
    """Adds ``spans`` (characters) to the rows; a NULL text has none."""
    with open(weights, "rb") as file:
        stored = file.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Weights.load(BytesIO(stored)), {}
        for held in gathered(batches):
            columns = [batch.column(0).to_pylist() for batch in held]
            fresh = list(dict.fromkeys(v for values in columns for v in values if v and v not in seen))
            if len(seen) + len(fresh) > SEEN:
                seen.clear()
                fresh = list(dict.fromkeys(v for values in columns for v in values if v))
            for value, spans in zip(fresh, find_spans(own, fresh)):
                seen[value] = [{"first": a, "end": b, "kind": k} for a, b, k in spans]
            for batch, values in zip(held, columns):
                spans = pa.array([seen[v] if v else [] for v in values], _SPAN_TYPE)
                yield pa.RecordBatch.from_arrays([*batch.columns, spans], ["_text", *keep, "spans"])

    rows = spread(texts.select(F.col(text).alias("_text"), *keep))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, spans {SPAN}").withColumnRenamed("_text", text)


def message_rows(dialogues: DataFrame) -> DataFrame:
    """``rec_id, msg_idx, role, content`` of all messages, counted from 0."""
    return dialogues.select("rec_id", F.posexplode("messages").alias("msg_idx", "m")).select("rec_id", F.col("msg_idx").cast("bigint").alias("msg_idx"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def items(dialogues: DataFrame) -> DataFrame:
    """``rec_id, msg_idx, kind, nth``: one row per personal item; ``nth`` counts the kind in its message."""
    found = find_items(message_rows(dialogues).where(F.col("content").isNotNull()), "content", "rec_id", "msg_idx")
    numbered = F.transform("spans", lambda s, i: F.struct(
        s["kind"].alias("kind"), F.size(F.filter(F.slice(F.col("spans"), F.lit(1), i + 1), lambda o: o["kind"] == s["kind"])).cast("bigint").alias("nth")))
    return found.where(F.size("spans") > 0).select("rec_id", "msg_idx", F.explode(numbered).alias("s")).select("rec_id", "msg_idx", "s.kind", "s.nth")


def replaced(text: str, spans: str):
    """The text with a placeholder for each span, built from the last to the first."""
    place = F.create_map(*(F.lit(x) for pair in PLACEHOLDERS.items() for x in pair))
    put = lambda t, s: F.concat(F.substring(t, F.lit(1), s["first"]), F.element_at(place, s["kind"]), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(F.reverse(F.col(spans)), F.col(text), put)


def redacted(dialogues: DataFrame) -> DataFrame:
    """``rec_id, messages, pii_replacements``: every record with placeholders and the number of replacements."""
    found = find_items(message_rows(dialogues), "content", "rec_id", "msg_idx", "role")
    one = F.struct("msg_idx", F.struct("role", replaced("content", "spans").alias("content")).alias("m"), F.size("spans").alias("n"))
    grouped = found.groupBy("rec_id").agg(F.sort_array(F.collect_list(one)).alias("rows"))
    done = grouped.select("rec_id", F.transform("rows", lambda r: r["m"]).alias("messages"), F.aggregate("rows", F.lit(0), lambda n, r: n + r["n"]).alias("pii_replacements"))
    # Records without any message keep what they have.
    rest = dialogues.where(F.coalesce(F.size("messages"), F.lit(0)) <= 0).select("rec_id", "messages", F.lit(0).alias("pii_replacements"))
    return done.unionByName(rest)


def counts_against(dialogues: DataFrame, clean_results: DataFrame) -> DataFrame:
    """Per record the number of items found and the number an earlier cleaner stated (the largest, NULL if none)."""
    own = items(dialogues).groupBy("rec_id").agg(F.count("*").alias("found"))
    stated = clean_results.groupBy("rec_id").agg(F.max("pii_replacements").alias("stated"))
    return dialogues.select("rec_id").join(own, "rec_id", "left").join(stated, "rec_id", "left").select("rec_id", F.coalesce("found", F.lit(0)).alias("pii_replacements"), "stated")

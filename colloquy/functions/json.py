"""JSON in replies: the first object of a text, and scores out of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: Column) -> Column:
    """The first JSON object of a text as VARIANT; what follows it is ignored; NULL if there is none."""
    return F.try_parse_json(F.when(F.instr(text, "{") > 0, F.substring(text, F.instr(text, "{"), F.length(text))))


def parse_scores(text: Column, dimensions: Sequence[str], low: int = 1, high: int = 5) -> Column:
    """``struct<scores map, error, dimension>`` of a judge's reply.

    A score is a whole number, alone or as ``{"score": n}``. The first dimension
    that fails decides: ``missing_field``, ``bad_type`` or ``out_of_range``; a
    text without an object is ``not_json``.
    """
    found = first_object(text)
    checks, values = F.when(found.isNull(), F.struct(F.lit("not_json").alias("error"), F.lit(None).cast("string").alias("dimension"))), []
    for name in dimensions:
        inner = F.try_variant_get(found, f"$.{name}.score", "variant")
        raw = F.coalesce(inner, F.try_variant_get(found, f"$.{name}", "variant"))
        kind = F.schema_of_variant(raw)
        number = F.try_variant_get(raw, "$", "double")
        whole = (kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")) & (number == F.floor(number))
        error = (
            F.when(raw.isNull() | (kind == "VOID"), F.lit("missing_field"))
            .when(~F.coalesce(whole, F.lit(False)), F.lit("bad_type"))
            .when((number < low) | (number > high), F.lit("out_of_range"))
        )
        checks = checks.when(error.isNotNull(), F.struct(error.alias("error"), F.lit(name).alias("dimension")))
        values.append(F.when(error.isNull(), number.cast("int")))
    failure = checks
    scores = F.when(failure.isNull(), F.map_from_arrays(F.array(*(F.lit(d) for d in dimensions)), F.array(*values)))
    return F.struct(scores.alias("scores"), failure["error"].alias("error"), failure["dimension"].alias("dimension"))


def parse_sse(line: Column) -> Column:
    """``struct<is_data, done, content, tokens>`` of a line of a server-sent event stream; malformed data raise in ANSI mode."""
    data = F.when(line.startswith("data:"), F.trim(F.substring(line, F.lit(6), F.length(line))))
    done = F.coalesce(data == "[DONE]", F.lit(False))
    body = F.parse_json(F.when(data.isNotNull() & ~done & (data != ""), data))
    return F.struct(
        data.isNotNull().alias("is_data"), done.alias("done"), F.try_variant_get(body, "$.choices[0].delta.content", "string").alias("content"),
        F.try_variant_get(body, "$.usage.completion_tokens", "int").alias("tokens"),
    )

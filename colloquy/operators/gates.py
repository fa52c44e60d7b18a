"""Gates for generated records: JSON in a reply to a dialogue or preference pair, or the first reason why not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.functions.json import first_object


def _messages(found: Column, path: str) -> Column:
    """Typed messages of a JSON list; NULL unless every entry has a known role and a text."""
    raw = F.try_variant_get(found, path, "array<variant>")
    typed = F.transform(raw, lambda v: M.message(F.when(F.schema_of_variant(F.try_variant_get(v, "$.role", "variant")) == "STRING", F.try_variant_get(v, "$.role", "string")), F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", F.try_variant_get(v, "$.content", "string"))))
    bad = F.exists(typed, lambda m: m["role"].isNull() | m["content"].isNull() | ~m["role"].isin("system", "user", "assistant"))
    return F.when(~bad, typed)


def gate_dialogue(reply: Column, min_turns: int = 1, forbidden: Sequence[str] = ()) -> Column:
    """``struct<messages, error>``: not_json, schema, semantic, too_few_turns, forbidden_text, in this order; error is NULL for a pass."""
    found = first_object(reply)
    messages = _messages(found, "$.messages")
    errors = M.validation_errors(messages, M.n_assistant(messages), F.lit("en"))
    said = F.array_join(F.transform(M.of_role(messages, "assistant"), lambda m: m["content"]), "\n")
    error = (
        F.when(found.isNull(), "not_json").when(messages.isNull(), "schema").when(F.size(errors) > 0, "semantic")
        .when(M.n_assistant(messages) < min_turns, "too_few_turns").when(X.matches_any(said, list(forbidden)), "forbidden_text")
    )
    return F.struct(F.when(error.isNull(), messages).alias("messages"), error.alias("error"))


def gate_preference(reply: Column, min_divergence: float = 0.1, forbidden: Sequence[str] = ()) -> Column:
    """``struct<context, chosen, rejected, error>``: not_json, schema, forbidden_text (in the chosen side only), low_divergence."""
    found = first_object(reply)
    context = _messages(found, "$.context")
    side = lambda n: F.when(F.schema_of_variant(F.try_variant_get(found, f"$.{n}", "variant")) == "STRING", F.try_variant_get(found, f"$.{n}", "string"))
    chosen, rejected = side("chosen"), side("rejected")
    bad = context.isNull() | (F.size(M.preference_errors(context, chosen, rejected)) > 0)
    error = (
        F.when(found.isNull(), "not_json").when(F.coalesce(bad, F.lit(True)), "schema").when(X.matches_any(chosen, list(forbidden)), "forbidden_text")
        .when(X.edit_share(chosen, rejected) < min_divergence, "low_divergence")
    )
    keep = lambda c: F.when(error.isNull(), c)
    return F.struct(keep(context).alias("context"), keep(chosen).alias("chosen"), keep(rejected).alias("rejected"), error.alias("error"))

"""Column expressions over arrays of messages (struct of role and content).

NULL arrays give NULL or an error entry as stated; NULL contents count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions import text as X

MESSAGE_TYPE = "array<struct<role:string,content:string>>"
#: Marks of the chat template.
START, END = "<|im_start|>", "<|im_end|>"


def message(role: Column | str, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def empty() -> Column:
    return F.array().cast(MESSAGE_TYPE)


def of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: m["role"] == role)


def n_assistant(messages: Column) -> Column:
    return F.size(of_role(messages, "assistant"))


def canonical_text(messages: Column) -> Column:
    """``role: collapsed content`` per message, one per line; what identity is computed from."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(X.collapse(m["content"]), F.lit("")))), "\n")


def dialogue_id(messages: Column) -> Column:
    return X.short_id("dlg-", canonical_text(messages))


def preference_id(context: Column, chosen: Column, rejected: Column) -> Column:
    lowered = lambda c: F.lower(X.strip(c))
    return X.short_id("pref-", F.concat_ws("\n", canonical_text(context), lowered(chosen), lowered(rejected)))


def merge_runs(messages: Column) -> Column:
    """Neighbours of one role become one message, contents on lines of their own."""
    def add(done: Column, m: Column) -> Column:
        last = F.element_at(done, -1)
        same = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["role"] == m["role"])
        joined = message(m["role"], F.concat_ws("\n", last["content"], m["content"]))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(message(m["role"], m["content"]))))

    return F.aggregate(messages, empty(), lambda done, m: F.when(F.size(done) == 0, F.array(message(m["role"], m["content"]))).otherwise(add(done, m)))


def hoist_system(messages: Column) -> Column:
    """System texts joined to one leading message, runs of the rest merged."""
    systems = F.transform(of_role(messages, "system"), lambda m: m["content"])
    body = merge_runs(F.filter(messages, lambda m: m["role"] != "system"))
    return F.when(F.size(systems) > 0, F.concat(F.array(message("system", F.array_join(systems, "\n"))), body)).otherwise(body)


def cut_tail(messages: Column) -> Column:
    """Without what follows the last assistant message; empty if there is none."""
    back = F.array_position(F.transform(F.reverse(messages), lambda m: F.coalesce(m["role"], F.lit(""))), "assistant").cast("int")
    return F.when(back > 0, F.slice(messages, F.lit(1), F.size(messages) - back + 1)).otherwise(empty())


def select_context(messages: Column) -> Column:
    """Without one trailing assistant message; NULL unless a user message ends it."""
    last = F.get(messages, F.size(messages) - 1)["role"]
    cut = F.when(last == "assistant", F.slice(messages, F.lit(1), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.when(F.get(cut, F.size(cut) - 1)["role"] == "user", cut)


def prompt_and_gold(messages: Column) -> tuple[Column, Column]:
    """Everything but the last message, and the last assistant content; NULL where the last message isn't the assistant's or nothing precedes it."""
    fine = (F.size(messages) > 1) & (F.get(messages, F.size(messages) - 1)["role"] == "assistant")
    return F.when(fine, F.slice(messages, F.lit(1), F.size(messages) - 1)), F.when(fine, F.get(messages, F.size(messages) - 1)["content"])


def probe(messages: Column) -> tuple[Column, Column]:
    """Everything before the last assistant message, and its content; NULL without one or where nothing precedes it."""
    back = F.array_position(F.transform(F.reverse(messages), lambda m: F.coalesce(m["role"], F.lit(""))), "assistant").cast("int")
    at = F.size(messages) - back
    fine = (back > 0) & (at > 0)
    return F.when(fine, F.slice(messages, F.lit(1), at)), F.when(fine, F.get(messages, at)["content"])


def to_preference(context: Column, chosen: Column, rejected: Column, system: str | None = None) -> Column:
    """``struct<prompt, chosen, rejected>`` of messages as preference training takes them; a context that doesn't end with a user message raises."""
    last = F.get(context, F.size(context) - 1)["role"]
    fine = F.coalesce(last == "user", F.lit(False))
    prompt = F.when(fine, with_system(context, system)).otherwise(F.raise_error(F.lit("context must end with a user message")).cast(MESSAGE_TYPE))
    answer = lambda c: F.array(message("assistant", c))
    return F.struct(prompt.alias("prompt"), answer(chosen).alias("chosen"), answer(rejected).alias("rejected"))


def last_user(messages: Column) -> Column:
    users = of_role(messages, "user")
    return F.get(users, F.size(users) - 1)["content"]


def length(messages: Column) -> Column:
    """Characters of all contents."""
    return F.aggregate(messages, F.lit(0), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))


def full_text(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), " ")


def with_system(messages: Column, default: str | None) -> Column:
    """A default system message in front where there is none."""
    if default is None:
        return messages
    return F.when(F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False)), messages).otherwise(F.concat(F.array(message("system", F.lit(default))), messages))


def render_chat(messages: Column, generation_prompt: bool = False) -> Column:
    """The chat template as one string."""
    one = lambda m: F.concat(F.lit(START), F.coalesce(m["role"], F.lit("")), F.lit("\n"), F.coalesce(m["content"], F.lit("")), F.lit(f"{END}\n"))
    joined = F.array_join(F.transform(messages, one), "")
    return F.concat(joined, F.lit(f"{START}assistant\n")) if generation_prompt else joined


def transcript(messages: Column) -> Column:
    """``[Customer] ...`` lines for a reader; other roles by their capitalised name."""
    label = lambda r: F.when(r == "system", "System").when(r == "user", "Customer").when(r == "assistant", "Agent").otherwise(F.initcap(r))
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), label(m["role"]), F.lit("] "), X.strip(F.coalesce(m["content"], F.lit(""))))), "\n")


def assistant_spans(rendered: Column) -> Column:
    """``array<struct<start, end>>``: 0-based character spans of the assistant's contents in a rendered chat, without the end mark; empty ones are left out."""
    opener = f"{START}assistant\n"
    parts = F.split(rendered, r"\Q" + opener + r"\E")
    ends = F.transform(parts, lambda p: F.when(F.instr(p, END) > 0, F.instr(p, END) - 1).otherwise(F.length(p)))
    starts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i - 1), F.lit(0), lambda n, p: n + F.length(p)) + (i - 1) * len(opener))
    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (s + e).alias("end")))
    return F.filter(F.slice(pairs, F.lit(2), F.size(pairs)), lambda p: p["end"] > p["start"])


def turn_bucket(turns: Column) -> Column:
    return F.when(turns <= 4, "short").when(turns <= 8, "mid").when(turns.isNotNull(), "long")


def validation_errors(messages: Column, n_turns: Column, lang: Column) -> Column:
    """Names of all semantic errors of a dialogue, in a fixed order; an empty array if it is valid.

    Empty or NULL messages give only ``empty``. The order of roles is judged up
    to its first break, which also hides that the end is wrong.
    """
    numbered = F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), m["content"].alias("content"), i.alias("i")))
    misplaced = F.exists(numbered, lambda m: (m["role"] == "system") & (m["i"] > 0))
    body = F.filter(messages, lambda m: m["role"] != "system")
    broken = F.exists(F.transform(body, lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")), lambda wrong: F.coalesce(wrong, F.lit(True)))
    ends = F.coalesce(F.get(messages, F.size(messages) - 1)["role"] == "assistant", F.lit(False))
    blanks = F.exists(messages, lambda m: X.is_blank(m["content"]))
    errors = F.array(
        F.when(misplaced, "system_not_first"), F.when(broken, "role_sequence"), F.when(~broken & ~ends, "not_assistant_last"), F.when(blanks, "blank_content"),
        F.when(~n_turns.eqNullSafe(n_assistant(messages)), "n_turns"), F.when(~F.coalesce(lang == "en", F.lit(False)), "lang"),
    )
    return F.when(F.coalesce(F.size(messages), F.lit(0)) <= 0, F.array(F.lit("empty"))).otherwise(F.array_compact(errors))


def preference_errors(context: Column, chosen: Column, rejected: Column) -> Column:
    """Names of all errors of a preference pair."""
    numbered = F.transform(context, lambda m, i: F.struct(m["role"].alias("role"), i.alias("i")))
    last = F.get(context, F.size(context) - 1)["role"]
    return F.array_compact(F.array(
        F.when(F.coalesce(F.size(context), F.lit(0)) <= 0, "empty_context"), F.when(F.size(context) > 0, F.when(~F.coalesce(last == "user", F.lit(False)), "not_user_last")),
        F.when(F.coalesce(F.exists(numbered, lambda m: (m["role"] == "system") & (m["i"] > 0)), F.lit(False)), "system_not_first"),
        F.when(F.coalesce(F.exists(context, lambda m: X.is_blank(m["content"])), F.lit(False)), "blank_content"),
        F.when(X.is_blank(chosen), "blank_chosen"), F.when(X.is_blank(rejected), "blank_rejected"),
    ))

"""Text cut off by field limits (problem 7).

Lengths are computed as storage may have counted them: characters, bytes,
UTF-16 units, after entity escaping, after JSON escaping (with and without
ASCII only), with line ends as two characters, and in words and marks. Grouped
by source and way of counting, a hidden limit shows as a length at which texts
pile up, far above the lengths on both its sides, and mostly with an open end; it
need not be the greatest length, as a limit may have held for a while or a part. Texts at such a limit, or at their
own token limit, whose tail is open are cut; so are the open tails that the
endings of the corpus show to be unfinished, whatever cut them.

NULL and blank texts are neither cut nor counted as judged; a NULL source is a
source of its own; repeated rows are judged each. Ties between limits keep all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.endings import judge_endings
from colloquy.session import durable

#: A spike has at least so many texts, so many times the mean of the lengths just below and just above, and such a share of open ends.
SPIKE_TEXTS, SPIKE_TIMES, NEAR, OPEN_SHARE = 5, 5, 20, 0.5
#: The end of a text that is closed, whatever it says.
CLOSED_END = r"[.?!…。？！][\"'”’»)\]}*_]*\s*$"


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def storage_lengths(text: Column) -> dict[str, Column]:
    """The length of ``text`` under each way of counting."""
    chars = F.length(text)
    units = F.octet_length(F.encode(text, "UTF-16BE")) / 2
    escapes = count_of(text, r'["\\\n\r\t]')
    wide = count_of(text, r"[^\x00-\x7F]")
    entities = 4 * count_of(text, "&") + 3 * count_of(text, "[<>]") + 5 * count_of(text, '"') + 4 * count_of(text, "'")
    return {
        "characters": chars,
        "utf8_bytes": F.octet_length(text),
        "utf16_units": units.cast("int"),
        "entities": chars + entities,
        "json": chars + escapes,
        "json_ascii": (chars + escapes - wide + 6 * (wide + units - chars)).cast("int"),
        "crlf": chars + count_of(text, r"(?<!\r)\n"),
        "tokens": count_of(text, r"(?U)\w+|[^\w\s]"),
    }


def lengths_long(texts: DataFrame, text: str) -> DataFrame:
    """One row per text and way of counting, with ``open_end``: no mark closes the text."""
    ways = storage_lengths(F.col(text))
    pairs = F.array(*(F.struct(F.lit(name).alias("way"), c.cast("int").alias("length")) for name, c in ways.items()))
    own = texts.where(F.length(F.trim(text)) > 0).withColumn("open_end", ~F.col(text).rlike(CLOSED_END))
    return own.withColumn("_w", F.explode(pairs)).select("*", "_w.way", "_w.length").drop("_w")


def hidden_limits(long: DataFrame, group: list[str]) -> DataFrame:
    """``group, way, length, n_at``: the lengths at which a limit shows; works on counts per length only."""
    counts = long.groupBy(*group, "way", "length").agg(F.count("*").alias("n_at"), F.count_if("open_end").alias("n_open"))
    order = Window.partitionBy(*group, "way").orderBy("length")
    near = lambda low, high: F.coalesce(F.sum("n_at").over(order.rangeBetween(low, high)), F.lit(0)) / NEAR
    marked = counts.withColumn("beside", F.greatest(near(-NEAR, -1), near(1, NEAR)))
    sharp = (F.col("n_at") >= SPIKE_TEXTS) & (F.col("n_at") >= SPIKE_TIMES * F.col("beside"))
    return marked.where(sharp & (F.col("n_open") >= OPEN_SHARE * F.col("n_at"))).select(*group, "way", "length", "n_at")


def cut_texts(rows: DataFrame, corpus: DataFrame, key: str, text: str, source: str, token_limit: str | None = None) -> DataFrame:
    """``key, source, cut, at_limit, ways``: ``ways`` are the ways of counting whose limit the text meets."""
    own = rows.select(F.col(key).alias("key"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("text"), *([F.col(token_limit).alias("room")] if token_limit else []))
    long = lengths_long(own, "text").drop("text")
    limits = hidden_limits(long, ["source"])
    met = long.join(limits.drop("n_at"), ["source", "way", "length"]).select("key", "way")
    if token_limit:
        met = met.unionByName(long.where("way = 'tokens' AND length = room").select("key", F.lit("own_token_limit").alias("way")))
    at = met.groupBy("key").agg(F.sort_array(F.collect_set("way")).alias("ways"))
    judged = judge_endings(own, corpus, "key", "text")
    return own.select("key").join(judged, "key").join(at, "key", "left").select(
        F.col("key").alias(key), (F.col("cut") | (F.col("open") & F.col("ways").isNotNull())).alias("cut"), F.coalesce(F.col("ways"), F.array().cast("array<string>")).alias("ways"), "share_on"
    )


def spoken(messages: str) -> Column:
    return F.filter(F.transform(F.col(messages), lambda m: m["content"]), lambda c: c.isNotNull())


def result_corpus(results: DataFrame) -> DataFrame:
    prompts = results.select(F.explode(spoken("prompt_messages")).alias("text"))
    return results.select(F.col("completion").alias("text")).unionByName(prompts)


def cut_results(results: DataFrame) -> DataFrame:
    rows = results.select("result_id", "source", "completion", F.col("gen_config.max_tokens").alias("max_tokens"))
    return cut_texts(rows, result_corpus(results), "result_id", "completion", "source", "max_tokens")


def cut_report(results: DataFrame) -> DataFrame:
    """Per source: rows with text, cut ones, their share, and the hidden limits as way:length."""
    judged = durable(cut_results(results)).join(results.select("result_id", "source"), "result_id")
    shares = judged.groupBy("source").agg(F.count("cut").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    own = results.select(F.coalesce("source", F.lit("")).alias("source"), F.col("completion").alias("text"))
    limits = hidden_limits(lengths_long(own, "text").drop("text"), ["source"]).groupBy(F.nullif("source", F.lit("")).alias("source")).agg(
        F.sort_array(F.collect_set(F.concat_ws(":", "way", "length"))).alias("limits")
    )
    joined = shares.alias("s").join(limits.alias("l"), F.col("s.source").eqNullSafe(F.col("l.source")), "left")
    return joined.select("s.source", "n_texts", "n_cut", (F.col("n_cut") / F.col("n_texts")).alias("share_cut"), F.coalesce("limits", F.array().cast("array<string>")).alias("limits"))

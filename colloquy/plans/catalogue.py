"""The core's queries over the test tables: one per operator or family of operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import json as J
from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.operators import clean, dedup, judge, latency, manifest, ordered, rules, sample, tasks
from colloquy.session import spread, table
from colloquy.sources import formats
from colloquy.streaming import traces

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries.
KEYWORDS = {
    "objection_handling": ["too high", "not push", "unclear", "doubled"], "info_gathering": ["how many", "kwh", "could you read"],
    "cold_open": ["call me", "calls homes"], "closing": ["confirm", "send a written", "fresh quote"],
}
PHRASES = ["solar", "heat pump", "off-peak", "bill", "tariff"]
UNWANTED, ROLE = [r"\d+(?:\.\d+)? (?:percent|cents)"], [r"as an ai", r"language model", r"virtual assistant"]
ASKING = ["info_gathering", "cold_open"]
HIGH_VALUE = ["objection_handling", "info_gathering"]


def scenario_name(column: str = "scenario") -> Column:
    return F.coalesce(F.regexp_replace(F.lower(F.trim(column)), "[- ]", "_"), F.lit("none"))


def dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """The dialogues; one small file is spread over the cores, as the expressions over messages are heavy."""
    return spread(table(spark, folder, "dialogues"))


def q01_dialogue_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Tail cut, exact dedup in delivery order, validation, turn buckets."""
    df = dialogues(spark, folder).select("rec_id", "lang", M.cut_tail(F.coalesce("messages", M.empty())).alias("messages"))
    df = df.withColumn("turns", M.n_assistant(F.col("messages"))).withColumn("drop_reason", F.when(F.size("messages") == 0, "no_assistant"))
    live = F.col("drop_reason").isNull()
    content = F.when(live, M.canonical_text(F.col("messages"))).otherwise(F.col("rec_id").cast("string"))
    df = dedup.mark_first(df, X.content_hash(content), "rec_id")
    errors = M.validation_errors(F.col("messages"), F.col("turns"), F.col("lang"))
    reason = F.when(~live, F.col("drop_reason")).when(~F.col("is_first"), "duplicate").when(F.size(errors) > 0, "invalid").otherwise("kept")
    return df.groupBy(reason.alias("reason"), M.turn_bucket(F.col("turns")).alias("bucket")).agg(F.count("*").alias("n"))


def q02_dialogue_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues(spark, folder).select("rec_id", M.dialogue_id(F.coalesce("messages", M.empty())).alias("content_id"))


def q03_event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of one event type per user as gaps and islands."""
    df = table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    runs = ordered.islands(df, "user_id", "event_type", "ts", "event_id")
    return runs.groupBy("user_id", "run").agg(F.any_value("event_type").alias("event_type"), F.count("*").alias("n"))


def q04_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    df = dedup.dedup_exact(table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", "text"), F.col("text"), "doc_id")
    return df.groupBy("source").agg(F.count("*").alias("n"), F.count_if(~F.col("is_first")).alias("dropped"))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).select("source", "lang", "messages", F.lit(0).alias("_src"), F.col("rec_id").alias("_ord"))
    language = F.substring(F.lower(F.trim("lang")), 1, 2)
    return clean.mark_invalid(clean.mark_duplicates(clean.clean(df, 2, language)))


def q05_drop_report(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cleaning chain, counted per source and reason with totals."""
    return clean.drop_report(cleaned(spark, folder)).drop("pii")


def q06_email_counts(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(M.full_text(F.col("messages")), F.lit(""))
    return dialogues(spark, folder).select("rec_id", F.regexp_count(text, F.lit(X.EMAIL)).alias("emails"), F.regexp_replace(text, X.EMAIL, "[EMAIL]").alias("redacted"))


def q07_redaction(spark: SparkSession, folder: str) -> DataFrame:
    text, count = X.redact(F.coalesce(M.full_text(F.col("messages")), F.lit("")))
    return dialogues(spark, folder).select("rec_id", count.alias("replacements"), text.alias("redacted"))


def q08_scenario_tag(spark: SparkSession, folder: str) -> DataFrame:
    text = F.coalesce(M.full_text(F.col("messages")), F.lit(""))
    return dialogues(spark, folder).select("rec_id", clean.tag_scenario(text, KEYWORDS).alias("tag"))


def q09_keyword_boundary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.has_keyword(F.col("text"), PHRASES).alias("hit"))


def q10_token_stats(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))
    df = table(spark, folder, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), tokens.alias("t"))
    return df.groupBy("lang").agg(F.count("t").alias("n"), F.sum("t").cast("bigint").alias("total"), F.percentile("t", 0.5).alias("p50"), F.percentile("t", 0.95).alias("p95"))


def q11_strata(spark: SparkSession, folder: str) -> DataFrame:
    return dialogues(spark, folder).groupBy(scenario_name().alias("scenario"), M.turn_bucket(F.col("n_turns")).alias("bucket")).agg(F.count("*").alias("n"))


def q12_validation_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = M.validation_errors(F.col("messages"), F.col("n_turns"), F.col("lang"))
    return dialogues(spark, folder).select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def q13_eval_samples(spark: SparkSession, folder: str) -> DataFrame:
    prompt, gold = M.prompt_and_gold(F.col("messages"))
    return dialogues(spark, folder).select("rec_id", F.size(prompt).alias("prompt_messages"), F.length(gold).alias("gold_chars"), M.last_user(prompt).alias("last_user"))


def q14_chat_render(spark: SparkSession, folder: str) -> DataFrame:
    rendered = M.render_chat(M.with_system(F.coalesce("messages", M.empty()), "Be brief."), True)
    return dialogues(spark, folder).select("rec_id", F.md5(rendered).alias("digest"), F.length(rendered).alias("chars"))


def q15_rule_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = rules.rule_flags(F.col("completion"), scenario_name(), UNWANTED, ROLE, 60, ASKING)
    return table(spark, folder, "results").select("result_id", flags.alias("f")).select("result_id", "f.*")


def q16_rule_summary(spark: SparkSession, folder: str) -> DataFrame:
    flags = rules.rule_flags(F.col("completion"), scenario_name(), UNWANTED, ROLE, 60, ASKING)
    df = table(spark, folder, "results").select(scenario_name().alias("scenario"), flags.alias("flags"), F.regexp_count(F.coalesce("completion", F.lit("")), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).alias("tokens"))
    return rules.summarise(df, "flags", rules.RULES, "tokens")


def q17_quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).select("rec_id", scenario_name().alias("scenario"))
    return sample.quota_sample(df, "scenario", "rec_id", 500)


def q18_downsample(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).select("rec_id", "source", scenario_name().alias("scenario"), M.full_text(F.coalesce("messages", M.empty())).alias("text"))
    real = dedup.is_real(F.col("source"))
    out = sample.downsample(df, "rec_id", real, F.col("scenario").isin(*HIGH_VALUE), X.has_keyword(F.col("text"), PHRASES[:2]), 2.0)
    return out.select("rec_id", "why", "kept")


def q19_stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).select("rec_id", F.concat_ws("|", scenario_name(), M.turn_bucket(F.col("n_turns"))).alias("stratum"))
    return sample.stratified_split(df, "stratum", "rec_id")


def q20_merged_strata(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).where("n_turns IS NOT NULL").select("rec_id", scenario_name().alias("scenario"), M.turn_bucket(F.col("n_turns")).alias("bucket"))
    return sample.with_strata(df, "scenario", "bucket", 40).groupBy("stratum").agg(F.count("*").alias("n"))


def q21_distribution(spark: SparkSession, folder: str) -> DataFrame:
    df = dialogues(spark, folder).where("split IS NOT NULL").select("split", scenario_name().alias("stratum"))
    return sample.distribution_warnings(df, "split", "stratum", 0.5)


def document_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return dedup.similar_texts(table(spark, folder, "documents").where(F.col("text").isNotNull()), "doc_id", X.collapse(F.col("text")), 0.85)


def q22_near_duplicate_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Per row its text id and the number of rows linked to it."""
    members, links = document_links(spark, folder)
    sizes = members.groupBy("text_id").agg(F.count("*").alias("size"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes.select(F.col("text_id").alias("b"), "size"), "b").groupBy(F.col("a").alias("text_id")).agg(F.sum("size").alias("others"))
    joined = members.join(sizes, "text_id").join(others, "text_id", "left")
    return joined.select(F.col("key").alias("doc_id"), "text_id", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def q23_near_duplicate_clusters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where(F.col("text").isNotNull()).select("doc_id", "source", F.length("text").alias("chars"))
    grouped = dedup.clusters(*document_links(spark, folder)).withColumnRenamed("key", "doc_id")
    # Blank documents have no shingle; each is its own cluster.
    own = docs.join(grouped, "doc_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "doc_id"))
    best = dedup.keep_best(own, "cluster_id", "doc_id", ~dedup.is_real(F.col("source")), -F.col("chars"))
    return best.select("doc_id", "cluster_id", "kept")


def q25_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """Near-equal dialogues across splits, counted per pair of splits."""
    df = dialogues(spark, folder).where("split IS NOT NULL AND messages IS NOT NULL").select("rec_id", "split", M.canonical_text(F.col("messages")).alias("text"))
    pairs = dedup.leakage(df, "rec_id", F.col("text"), "split", 0.8)
    return pairs.groupBy(F.least("split_a", "split_b").alias("split_a"), F.greatest("split_a", "split_b").alias("split_b")).agg(F.sum("n_pairs").alias("n_pairs"))


def q27_common_ids(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "results").select(scenario_name().alias("scenario"), "gen_config.model_tag")
    return sample.common_ids(df, "scenario", "model_tag")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of two made-up dimensions, so that cross tables have something to count."""
    df = table(spark, folder, "results")
    length = F.coalesce(F.length("completion"), F.lit(0))
    return df.select(F.lit("judge-a").alias("judge"), F.col("gen_config.model_tag").alias("tag"), scenario_name().alias("scenario"), F.create_map(
        F.lit("length"), (1 + F.pmod(length, F.lit(5))).cast("int"), F.lit("tokens"), (1 + F.pmod(F.coalesce("n_tokens", F.lit(0)), F.lit(5))).cast("int")).alias("scores"))


def q28_cross_table(spark: SparkSession, folder: str) -> DataFrame:
    return judge.cross_table(judge.long_scores(scored(spark, folder), "scores", "judge", "tag", "scenario"), "judge", "tag", "scenario")


def q29_pairwise_means(spark: SparkSession, folder: str) -> DataFrame:
    whole = q28_cross_table(spark, folder).where("scenario = 'all'")
    return judge.pairwise(whole, "judge", "tag", 0.1).select("judge", "dimension", "tag_a", "tag_b", "no_diff")


def q30_cost(spark: SparkSession, folder: str) -> DataFrame:
    usage = table(spark, folder, "results").select(F.coalesce("gen_config.model_tag", F.lit("none")).alias("model"), F.coalesce("n_tokens", F.lit(0)).alias("prompt_tokens"), F.coalesce("usage_completion_tokens", F.lit(0)).alias("completion_tokens"))
    pricing = spark.createDataFrame([("base", 0.5, 1.5), ("sft", 0.25, 2.0)], "model string, prompt_usd double, completion_usd double")
    return judge.cost(usage, pricing)


def q31_json_props(spark: SparkSession, folder: str) -> DataFrame:
    found = J.first_object(F.col("props"))
    return table(spark, folder, "events").select("event_id", F.is_variant_null(found).alias("is_null"), F.size(F.json_object_keys("props")).alias("keys"))


def q32_tier_rollup(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "raw_1").select("concurrency", "start_ts", "ttft_ms", "itl_mean_ms", "n_output_tokens", "ok")
    return latency.tier_rollup(df, 2_592_000.0, 86_400.0, "concurrency")


def q33_stream_gaps(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    df = latency.gaps(table(spark, folder, "events"), "user_id", ts, "event_id")
    return df.groupBy("user_id").agg(F.count("*").alias("n"), F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.sum("gap").alias("gap_sum"))


def q34_length_buckets(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    return sample.length_buckets(df, F.col("chars"), "doc_id").select("doc_id", "bucket", "position")


def q35_edit_share(spark: SparkSession, folder: str) -> DataFrame:
    """How far the rejected answer is from the chosen one, over all pairs; characters outside ASCII count as one mark, as SQL would count their bytes."""
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x00-\x7F]", "?")
    df = spread(table(spark, folder, "preference_pairs").select("pair_id", "chosen", "rejected"))
    return df.select("pair_id", X.edit_share(plain("chosen"), plain("rejected")).alias("share"))


def q36_task_matrix(spark: SparkSession, folder: str) -> DataFrame:
    axes = [table(spark, folder, "region").select("r_name"), table(spark, folder, "nation").select("n_name")]
    return tasks.task_matrix(axes, 300).select("task_idx", "r_name", "n_name")


def q37_first_difference(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "preference_pairs").select("pair_id", F.coalesce("chosen", F.lit("")).alias("a"), F.coalesce("rejected", F.lit("")).alias("b"))
    return df.select("pair_id", (F.col("a") == F.col("b")).alias("same"), X.first_difference(F.col("a"), F.col("b")).alias("first_char"))


def q38_set_operations(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with and without orders, and the keys of both sides."""
    orders, customers = table(spark, folder, "orders").select(F.col("o_custkey").alias("k")), table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    parts = {"union": orders.union(customers).distinct(), "intersect": orders.intersect(customers), "except": customers.exceptAll(orders.distinct()), "semi": customers.join(orders, "k", "left_semi"), "anti": customers.join(orders, "k", "left_anti")}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("operation"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("key_sum"))
        out = one if out is None else out.unionByName(one)
    return out


def q39_event_windows(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id")
    out = traces.window_rollup(df, "ts", "event_id", "event_type", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def q39_event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = traces.sessions(df, "ts", "user_id", "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


MANIFEST = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    "documents": ["doc_id", "text", "lang", "source"], "eval_items": ["item_id", "text", "split"], "raw_1": ["request_id", "client_key", "concurrency", "n_output_tokens"],
}


def q40_manifest(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for name, columns in MANIFEST.items():
        one = manifest.table_digest(table(spark, folder, name), name, *columns)
        out = one if out is None else out.unionByName(one)
    return out


def q41_sse(spark: SparkSession, folder: str) -> DataFrame:
    """Server-sent lines built of the events, parsed again."""
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("event_type").alias("content")).alias("delta"))).alias("choices"), F.struct(F.pmod("event_id", F.lit(97)).alias("completion_tokens")).alias("usage")))
    line = F.when(F.pmod("event_id", F.lit(10)) == 0, "data: [DONE]").when(F.pmod("event_id", F.lit(10)) == 1, ": keep").otherwise(F.concat(F.lit("data: "), payload))
    return table(spark, folder, "events").select("event_id", J.parse_sse(line).alias("c")).select("event_id", "c.*")


def q42_assistant_spans(spark: SparkSession, folder: str) -> DataFrame:
    rendered = M.render_chat(F.coalesce("messages", M.empty()))
    df = dialogues(spark, folder).select("rec_id", M.assistant_spans(rendered).alias("spans"))
    chars = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return df.select("rec_id", F.size("spans").alias("n_spans"), chars.alias("chars"))


def q43_preference_errors(spark: SparkSession, folder: str) -> DataFrame:
    errors = M.preference_errors(F.col("context"), F.col("chosen"), F.col("rejected"))
    return table(spark, folder, "preference_pairs").select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("n"))


def q44_preference_ids(spark: SparkSession, folder: str) -> DataFrame:
    blank = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, folder, "preference_pairs").select("pair_id", M.preference_id(F.coalesce("context", M.empty()), blank("chosen"), blank("rejected")).alias("content_id"))


def q45_format_conversion(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues written in the conversation format and converted back; failures by NULL messages."""
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    raw = dialogues(spark, folder).where("messages IS NOT NULL").select("rec_id", F.transform("messages", lambda m: F.struct(speaker(m["role"]).alias("from"), m["content"].alias("value"))).alias("conversations"))
    out = formats.conversations(raw)
    return out.select("rec_id", F.col("messages").isNotNull().alias("converted"), F.size("messages").alias("n_messages"), F.md5(M.canonical_text(F.col("messages"))).alias("digest"))


def q46_context(spark: SparkSession, folder: str) -> DataFrame:
    context = M.select_context(F.col("messages"))
    return dialogues(spark, folder).select("rec_id", F.size(context).alias("n_messages"), M.length(context).alias("chars"), F.md5(M.transcript(context)).alias("digest"))


def q47_split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per split and scenario with totals of both."""
    df = dialogues(spark, folder).select(F.coalesce("split", F.lit("none")).alias("split"), scenario_name().alias("scenario"))
    return df.cube("split", "scenario").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("scenario", F.lit("all")).alias("scenario"), "n")


def q48_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with a block of reasoning in front, stripped again."""
    text = F.concat(F.lit(" <think>\n"), F.coalesce("scenario", F.lit("")), F.lit("</think>\n "), F.coalesce("completion", F.lit("")))
    return table(spark, folder, "results").select("result_id", F.md5(X.strip_reasoning(text)).alias("digest"))


def q49_pricing_join(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation and year of orders: joins of four tables with an aggregate combined before the shuffle."""
    items = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    named = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(named, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "year").agg(F.count("*").alias("n"), F.round(F.sum("revenue"), 0).alias("revenue"))


def queries() -> dict[str, Query]:
    from colloquy.plans import more

    return {name: f for name, f in globals().items() if name[0] == "q" and name[1].isdigit()} | more.queries()

"""Further queries: sources and sinks written and read again, formats, gates, runs with stand-in clients, comparisons and traces."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy import types as R
from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.operators import dedup, gates, judge, latency, logs, manifest, rules, runs, sample, tasks
from colloquy.plans.catalogue import ASKING, KEYWORDS, ROLE, UNWANTED, dialogues, scenario_name
from colloquy.session import durable, shared_folder, spread, table
from colloquy.sources import files, formats
from colloquy.streaming import traces


def workplace(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def digest(messages: Column) -> Column:
    """Of roles and contents as they are."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n"))


# Sources and sinks


def q50_jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as JSON lines and read by suffix."""
    place = workplace(spark, "documents") + ".jsonl"
    n = files.write_jsonl(table(spark, folder, "documents").select("doc_id", "text", "lang"), place)
    rows = files.read_local(spark, place, "doc_id bigint, text string, lang string")
    return rows.select("doc_id", F.md5("text").alias("digest"), "lang", F.lit(n).cast("bigint").alias("written"))


def q51_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """A small table as one JSON array."""
    place = workplace(spark, "nation") + ".json"
    whole = table(spark, folder, "nation").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value"))  # 25 rows by definition
    whole.coalesce(1).write.text(place)
    return files.read_local(spark, place, "n_nationkey int, n_name string, n_regionkey int").drop("_ord")


def q52_load_dialogues(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues as JSON lines through the validating loader: valid rows and errors."""
    place = workplace(spark, "dialogues") + ".jsonl"
    files.write_jsonl(table(spark, folder, "dialogues").select("id", "source", "scenario", "lang", "n_turns", "meta", "messages"), place)
    good, bad = files.read_dialogues(spark, place)
    return bad.groupBy("error").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("valid").alias("error"), F.count("*").alias("n")))


def q53_load_preferences(spark: SparkSession, folder: str) -> DataFrame:
    place = workplace(spark, "pairs") + ".jsonl"
    files.write_jsonl(table(spark, folder, "preference_pairs").select("id", "scenario", "context", "chosen", "rejected", "meta"), place)
    good, bad = files.read_preferences(spark, place)
    return bad.groupBy("error").agg(F.count("*").alias("n")).unionByName(good.agg(F.lit("valid").alias("error"), F.count("*").alias("n")))


def q54_load_probes(spark: SparkSession, folder: str) -> DataFrame:
    """The contexts that end with a user message, written and read as probes."""
    place = workplace(spark, "probes") + ".jsonl"
    context = F.col("context")
    rows = table(spark, folder, "preference_pairs").where(F.get(context, F.size(context) - 1)["role"] == "user")
    files.write_jsonl(rows.select(F.col("pair_id").cast("string").alias("id"), F.col("scenario").alias("category"), "context"), place)
    return files.read_probes(spark, place).select("id", "category", digest(F.col("context")).alias("digest"))


def q55_load_seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Test items as seeds; per scenario, how many there are."""
    place = workplace(spark, "seeds") + ".jsonl"
    files.write_jsonl(table(spark, folder, "eval_items").select(scenario_name().alias("scenario"), "item_id", "text"), place)
    return files.read_seeds(spark, place, "scenario", "scenario string, item_id bigint, text string").groupBy("scenario").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


def q56_load_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results in a folder per tag; the folder's name is the tag again."""
    base, rows = workplace(spark, "results"), table(spark, folder, "results").select("result_id", "completion", F.coalesce("gen_config.model_tag", F.lit("none")).alias("tag"))
    places = []
    for tag in sorted(r.tag for r in rows.select("tag").distinct().limit(100).collect()):
        files.write_jsonl(rows.where(F.col("tag") == tag).drop("tag"), f"{base}/{tag}/results.jsonl")
        places.append(f"{base}/{tag}")
    return files.read_results(spark, places, "result_id bigint, completion string").select("result_id", "model_tag", F.md5("completion").alias("digest"))


def q57_request_logs(spark: SparkSession, folder: str) -> DataFrame:
    """The request log as a CSV file per tier, read as a folder and summed per tier."""
    base = workplace(spark, "requests")
    rows = table(spark, folder, "raw_1")
    for tier in sorted(r.concurrency for r in rows.select("concurrency").distinct().limit(100).collect()):
        rows.where(F.col("concurrency") == tier).select(*files.REQUEST_COLUMNS).write.option("header", True).csv(f"{base}/raw_{tier}.csv")
    read = files.read_request_folder(spark, local(base))
    return read.groupBy("concurrency").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), F.count("ttft_ms").alias("n_ttft"), F.min("start_ts").alias("first"), F.max(F.when(~F.isnan("total_ms"), F.col("total_ms"))).alias("slowest"), F.sum("n_output_tokens").alias("tokens"))


def q58_csv_report(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per event type as a report file, read again."""
    place = workplace(spark, "report") + ".csv"
    counts = table(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("low"))
    files.write_csv_report(counts, place, ["event_type", "n", "low"], "event_type")
    return spark.read.option("header", True).schema("event_type string, n bigint, low double").csv(place)


# Projections and formats


def q59_merged_messages(spark: SparkSession, folder: str) -> DataFrame:
    merged = M.merge_runs(F.col("messages"))
    return dialogues(spark, folder).where("size(messages) > 0").select("rec_id", F.size(merged).alias("n_messages"), digest(merged).alias("digest"))


def q60_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("tokens"))


def q61_instruction_format(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs as instruction rows, converted; rows that fail have no messages."""
    raw = table(spark, folder, "preference_pairs").select("pair_id", M.last_user(F.col("context")).alias("instruction"), F.when(F.pmod("pair_id", F.lit(3)) == 0, F.col("scenario")).alias("input"), F.col("chosen").alias("output"))
    return formats.instruction_pairs(raw).select("pair_id", F.col("messages").isNotNull().alias("converted"), digest(F.col("messages")).alias("digest"))


def q62_prefixed_format(spark: SparkSession, folder: str) -> DataFrame:
    """The first six messages as cells with a speaker in front, and the pairs found in them."""
    cell = lambda m: F.concat(F.when(m["role"] == "user", "Customer: ").when(m["role"] == "assistant", "Salesman: ").otherwise("Note: "), m["content"])
    wide = dialogues(spark, folder).select("rec_id", *(cell(F.get("messages", F.lit(i))).alias(str(i)) for i in range(6)))
    return formats.prefixed_pairs(wide).select("rec_id", F.col("pair_idx").cast("bigint").alias("pair_idx"), F.col("messages").isNotNull().alias("converted"), digest(F.col("messages")).alias("digest"))


def q63_preference_training(spark: SparkSession, folder: str) -> DataFrame:
    context = F.col("context")
    rows = table(spark, folder, "preference_pairs").where(F.get(context, F.size(context) - 1)["role"] == "user")
    made = rows.select("pair_id", M.to_preference(context, F.col("chosen"), F.col("rejected"), "Be brief.").alias("p"))
    return made.select("pair_id", *(digest(F.col(f"p.{side}")).alias(side) for side in ("prompt", "chosen", "rejected")))


def q64_probes(spark: SparkSession, folder: str) -> DataFrame:
    prompt, gold = M.probe(F.col("messages"))
    return dialogues(spark, folder).select("rec_id", F.size(prompt).alias("n_prompt"), digest(prompt).alias("digest"), F.md5(gold).alias("gold"))


TEMPLATE = "Rate the reply.\n\n{context}\n\nReply: {reply}\n"


def q65_judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    prompt = runs.judge_prompt(TEMPLATE, F.col("prompt_messages"), F.coalesce("completion", F.lit("")))
    return table(spark, folder, "results").select("result_id", F.md5(prompt).alias("digest"))


def q66_reasoning_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Replies with a block of reasoning, an empty one or none, taken apart."""
    kind = F.pmod("result_id", F.lit(3))
    text = F.concat(F.when(kind == 0, "<think> why </think>\n").when(kind == 1, "<think>\n</think> ").otherwise(""), F.coalesce("completion", F.lit("")))
    content, reasoning = X.split_reasoning(text, F.when(F.pmod("result_id", F.lit(6)) == 0, "given"))
    return table(spark, folder, "results").select("result_id", F.md5(content).alias("content"), reasoning.alias("reasoning"), F.md5(X.strip_empty_reasoning(text)).alias("kept"))


# Gates and rules


def q67_dialogue_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Dialogues as replies in prose, some of them broken, through the gate."""
    broken = F.pmod("rec_id", F.lit(7))
    body = F.to_json(F.struct("messages"))
    reply = F.when(broken == 0, "nothing here").when(broken == 1, '{"other": 1}').when(broken == 2, F.concat(F.lit("Sure:\n"), body, F.lit("\nDone."))).otherwise(body)
    gate = gates.gate_dialogue(reply, 2, UNWANTED)
    return dialogues(spark, folder).select(F.coalesce(gate["error"], F.lit("passed")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def q68_preference_gate(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.when(F.pmod("pair_id", F.lit(5)) == 0, "no object").otherwise(F.to_json(F.struct("context", "chosen", "rejected")))
    gate = gates.gate_preference(reply, 0.0, UNWANTED)
    return spread(table(spark, folder, "preference_pairs")).select(F.coalesce(gate["error"], F.lit("passed")).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def q69_rule_failures(spark: SparkSession, folder: str) -> DataFrame:
    flags = rules.rule_flags(F.col("completion"), scenario_name(), UNWANTED, ROLE, 60, ASKING)
    return table(spark, folder, "results").select("result_id", F.posexplode(rules.failures(flags, F.col("n_tokens"))).alias("place", "f")).select("result_id", F.col("place").cast("bigint").alias("place"), "f.rule", "f.detail")


# Latency


def stream_columns() -> tuple[Column, Column]:
    """A start and three chunk times of a logged request; none where a time is missing."""
    start, first, gap = F.lit(0.0), F.col("ttft_ms") / 1000, F.col("itl_mean_ms") / 1000
    fine = (F.col("ttft_ms") >= 0) & (F.col("itl_mean_ms") >= 0) & ~F.isnan("ttft_ms") & ~F.isnan("itl_mean_ms")
    return start, F.when(F.coalesce(fine, F.lit(False)), F.array(first, first + gap, first + gap + gap)).otherwise(F.array().cast("array<double>"))


def q70_stream_summaries(spark: SparkSession, folder: str) -> DataFrame:
    start, chunks = stream_columns()
    stream = latency.summarise_stream(start, chunks, F.col("n_output_tokens"))
    row = latency.request_row(start, F.col("s"), F.col("ok"))
    return table(spark, folder, "raw_1").select("request_id", "ok", stream.alias("s")).select("request_id", row.alias("r"), F.size("s.gaps").alias("n_gaps")).select("request_id", "r.ttft_ms", "r.total_ms", "r.n_output_tokens", "r.ok", "n_gaps")


def q71_stream_rollup(spark: SparkSession, folder: str) -> DataFrame:
    start, chunks = stream_columns()
    df = table(spark, folder, "raw_1").select("concurrency", latency.summarise_stream(start, chunks, F.col("n_output_tokens")).alias("s"))
    return latency.aggregate_streams(df, "s", "concurrency").drop("ttft_mean", "total_mean")


def q72_speedup(spark: SparkSession, folder: str) -> DataFrame:
    """Of runs of one client: tokens per second and the speedup over calls one after another."""
    fine = F.col("total_ms").isNotNull() & ~F.isnan("total_ms") & (F.col("total_ms") > 0)
    sums = table(spark, folder, "raw_1").where(fine).groupBy("concurrency").agg(F.count("*").alias("n"), F.max("total_ms").alias("wall"), F.min("total_ms").alias("single"), F.sum("n_output_tokens").alias("tokens"))
    return sums.select("concurrency", latency.speedup(F.col("single"), F.col("wall"), F.col("n")).alias("speedup"), latency.throughput(F.col("tokens"), F.col("wall")).alias("per_ms"))


# Comparisons, matrices and logs


def compared(spark: SparkSession, folder: str, mode: str) -> DataFrame:
    rows = table(spark, folder, "preference_pairs")
    ids = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), " "), lambda w: F.length(w))
    side = lambda c: rows.select("pair_id", F.coalesce(c, F.lit("")).alias("text"), ids(c).alias("token_ids"))
    return tasks.compare_generations(side("chosen"), side("rejected"), "pair_id", mode, 2)


def q73_compared_generations(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "preference_pairs")
    tokens = lambda c: F.split(F.coalesce(c, F.lit("")), " ")
    place = rows.select("pair_id", tasks.first_token_difference(tokens("chosen"), tokens("rejected")).alias("first_token"))
    return compared(spark, folder, "prefix").select("pair_id", "match", "first_char").join(place, "pair_id")


def q74_consistency(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = durable(compared(spark, folder, "exact"))
    totals = tasks.consistency(verdicts, "pair_id").crossJoin(F.broadcast(tasks.count_changed(verdicts).select("n_changed")))  # one row each
    ids = tasks.mismatches(verdicts, "pair_id").agg(F.coalesce(F.sum("pair_id"), F.lit(0)).alias("mismatched_ids"))
    return totals.crossJoin(F.broadcast(ids))


def q75_zipped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts and replies paired by their position, as two files of a run would be."""
    rows = table(spark, folder, "results")
    prompts = rows.select(F.col("result_id").alias("prompt_id"))
    return tasks.zip_rows(prompts, ["prompt_id"], rows.select(F.col("result_id").alias("reply_id"), F.coalesce(F.length("completion"), F.lit(0)).alias("chars")), ["chars", "reply_id"])


def q76_parameter_grid(spark: SparkSession, folder: str) -> DataFrame:
    ranks = table(spark, folder, "region").select((4 * F.pow(F.lit(2), F.col("r_regionkey"))).cast("int").alias("rank"))
    return tasks.parameter_grid(ranks, table(spark, folder, "nation").select((F.col("n_nationkey") * 2).alias("rate")))


def q77_picked_examples(spark: SparkSession, folder: str) -> DataFrame:
    """For each of 200 tasks over scenarios, a seeded number of test items of its scenario."""
    items = table(spark, folder, "eval_items").select(scenario_name().alias("scenario"), "item_id")
    matrix = tasks.task_matrix([items.select("scenario").distinct()], 200)
    return tasks.pick_examples(matrix, items, "scenario", "item_id", 1, 3).select("task_idx", "scenario", "item_id", F.col("place").cast("bigint").alias("place"))


def q78_every_kth(spark: SparkSession, folder: str) -> DataFrame:
    return sample.every_kth(table(spark, folder, "documents").select("doc_id"), "doc_id", 37)


def q79_log_series(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of a nation as the log of a run; the series and the best value of each run."""
    entry = F.struct(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("step"), F.col("c_acctbal").alias("loss"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("eval_loss"))
    state = table(spark, folder, "customer").select(F.array(entry).alias("log_history"))
    return logs.log_series(state, ["loss", "eval_loss", "absent"])


def q80_ranked_runs(spark: SparkSession, folder: str) -> DataFrame:
    best = table(spark, folder, "customer").groupBy("c_nationkey").agg(F.min(F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal"))).alias("best_loss"))
    return logs.ranked_runs(best)


def q81_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Model shapes from JSON, bytes of the cache per token and size ratios, over the parts."""
    shape = F.to_json(F.struct((F.col("p_size") + 1).alias("num_hidden_layers"), F.lit(8).alias("num_attention_heads"), F.when(F.col("p_size") % 2 == 0, 2).alias("num_key_value_heads"), (F.col("p_size") * 64).alias("hidden_size"), F.when(F.col("p_size") % 3 == 0, 128).alias("head_dim")))
    sizes = manifest.size_columns(F.col("p_partkey"), F.col("p_size").cast("bigint"))
    m = manifest.model_shape("shape")
    return table(spark, folder, "part").withColumn("shape", shape).select("p_partkey", m["head_dim"].alias("head_dim"), manifest.kv_bytes_per_token(m["layers"], m["kv_heads"], m["head_dim"]).alias("bytes_per_token"), sizes["ratio"].alias("ratio"), manifest.kv_budget_gib(F.col("p_partkey"), F.col("p_size"), F.lit(2)).alias("budget"))


def q82_judge_average(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results").select(F.explode(F.array(F.lit("j1"), F.lit("j2"))).alias("judge"), F.col("gen_config.model_tag").alias("tag"), scenario_name().alias("scenario"), F.coalesce("n_tokens", F.lit(0)).alias("t"))
    long = rows.select("judge", "tag", "scenario", F.lit("size").alias("dimension"), (1 + F.pmod(F.col("t") + F.length("judge"), F.lit(5))).cast("int").alias("score"))
    return judge.average_over_judges(judge.cross_table(long, "judge", "tag", "scenario").where("scenario = 'all'"), "tag")


def q83_judge_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Pair ids that both sides have, a proportional sample of them, and its rows of each side."""
    rows = table(spark, folder, "preference_pairs").select("pair_id", scenario_name().alias("scenario"), F.explode(F.array(*(F.struct(F.lit(s).alias("tag"), F.col(s).alias("text")) for s in ("chosen", "rejected")))).alias("s")).where("s.text IS NOT NULL")
    return sample.judge_samples(rows.select("pair_id", "scenario", "s.tag", "s.text"), "pair_id", "tag", "scenario", 60).select("pair_id", "tag", "scenario")


def q84_lsh_links(spark: SparkSession, folder: str) -> DataFrame:
    """Near-equal documents by banded minimum hashes: per document its text and the number of linked texts."""
    members, links = dedup.near_dup_lsh(table(spark, folder, "documents").where(F.col("text").isNotNull()), "doc_id", X.collapse(F.col("text")), 0.85)
    both = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("text_id")).agg(F.count("*").alias("n_links"))
    return members.join(both, "text_id", "left").select(F.col("key").alias("doc_id"), "text_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Runs with stand-in clients


def echo_client():
    """Replies with the first line of a prompt and the length of it all."""
    return lambda prompt: (f"<think>x</think>{prompt.count(chr(10))} lines", len(prompt), 2)


def judge_client(name: str):
    """A judge whose scores follow the length of the prompt; every seventh length gives no object."""
    def make():
        def call(prompt: str) -> tuple[str, int, int]:
            n = len(prompt)
            reply = "no idea" if n % 7 == 0 else json.dumps({"clear": {"score": 1 + n % 5}, "kind": 1 + (n + len(name)) % 5})
            return reply, n, 3

        return call

    return make


def dialogue_client():
    """Writes dialogues; tasks whose number divides by five get none, by three one that breaks the rules."""
    def call(prompt: str) -> tuple[str, int, int]:
        number = int(re.search(r"\d+", prompt)[0])
        roles = ["user", "user"] if number % 3 == 0 else ["user", "assistant"]
        body = json.dumps({"messages": [{"role": r, "content": f"text {number}"} for r in roles]})
        return ("sorry" if number % 5 == 0 else f"Here: {body}"), number, 7

    return call


def q85_generate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "results").select("result_id", F.coalesce("prompt_messages", M.empty()).alias("prompt_messages"))
    out = runs.generate_all(rows, "result_id", "prompt_messages", echo_client, "Be brief.")
    return out.select("result_id", "ok", "completion", "prompt_tokens", "completion_tokens")


def judged(spark: SparkSession, folder: str) -> runs.JudgeRun:
    rows = table(spark, folder, "results").select(F.col("result_id").cast("string").alias("id"), F.coalesce("gen_config.model_tag", F.lit("none")).alias("tag"), scenario_name().alias("scenario"), F.coalesce("prompt_messages", M.empty()).alias("prompt_messages"), "completion")
    return runs.run_judge(rows, ["judge-a", "judge-bb"], TEMPLATE, judge_client, ["clear", "kind"], rounds=2, base_s=0.0)


def q86_judge_scores(spark: SparkSession, folder: str) -> DataFrame:
    run = judged(spark, folder)
    return run.scores.select("id", "tag", "judge", F.col("scores")["clear"].alias("clear"), F.col("scores")["kind"].alias("kind"), F.lit(None).cast("string").alias("error")).unionByName(
        run.failures.select("id", "tag", "judge", F.lit(None).cast("int").alias("clear"), F.lit(None).cast("int").alias("kind"), "error"))


def q87_judge_usage(spark: SparkSession, folder: str) -> DataFrame:
    return judged(spark, folder).usage


def synthesised(spark: SparkSession, folder: str) -> tuple[runs.Run, DataFrame]:
    matrix = tasks.task_matrix([table(spark, folder, "nation").select("n_name"), spark.createDataFrame([(k,) for k in KEYWORDS], "scenario string")], 300)
    own = durable(matrix.select(F.col("task_idx").cast("bigint").alias("task_idx"), "n_name", "scenario"))
    return runs.synthesise(own, "task_idx", "Task {n}: a {scenario} dialogue in {place}.", {"n": F.col("task_idx"), "scenario": F.col("scenario"), "place": F.col("n_name")}, dialogue_client, lambda r: gates.gate_dialogue(r, 1), rounds=2, base_s=0.0), own


def q88_synthesis_errors(spark: SparkSession, folder: str) -> DataFrame:
    run, _ = synthesised(spark, folder)
    return runs.error_histogram(run.abandoned).unionByName(run.accepted.agg(F.lit("accepted").alias("kind"), F.count("*").alias("n")))


def q89_synthesis_cost(spark: SparkSession, folder: str) -> DataFrame:
    run, own = synthesised(spark, folder)
    return runs.cost_report(run, own.withColumn("parity", F.pmod("task_idx", F.lit(2)).cast("string")), "task_idx", "parity")


# Traces


def turn_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = dialogues(spark, folder).select(F.col("rec_id").cast("string").alias("conversation_id"), F.posexplode("messages").alias("turn_index", "m"))
    flags = rules.rule_flags(F.col("m.content"), F.lit("none"), UNWANTED, ROLE, 60)
    return rows.select("conversation_id", "turn_index", F.coalesce("m.content", F.lit("")).alias("content"), F.length("m.content").cast("double").alias("latency_ms"), F.col("turn_index").cast("bigint").alias("prompt_tokens"), F.lit(1).cast("bigint").alias("completion_tokens"), rules.failures(flags, F.lit(None)).alias("failures"))


def q90_trace_summary(spark: SparkSession, folder: str) -> DataFrame:
    return traces.trace_summary(turn_rows(spark, folder))


def q91_trace_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Turns through a fan-out of sinks by micro-batches, read again from its files."""
    source, place = workplace(spark, "turns"), workplace(spark, "sink")
    turn_rows(spark, folder).drop("failures").write.parquet(source)
    sink = traces.make_sink(place, "remote", lambda batch, number: batch.count(), [])
    query = traces.record_turns(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), sink, workplace(spark, "progress"))
    query.awaitTermination()
    back = spark.read.schema("conversation_id string, turn_index int, content string").json(f"{place}/*")
    return back.select("conversation_id", F.col("turn_index").cast("bigint").alias("turn_index"), F.md5("content").alias("digest"))


def q92_stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Daily windows of the events as a stream with a watermark, kept until the input is used up."""
    source, name = workplace(spark, "events"), f"windows_{uuid.uuid4().hex}"
    table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "event_id").write.parquet(source)
    stream = spark.readStream.schema("ts timestamp, event_type string, event_id bigint").parquet(source)
    out = traces.window_rollup(stream, "ts", "event_id", "event_type", "1 day", late="2 hours")
    query = out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", workplace(spark, "progress")).trigger(availableNow=True).start()  # a row per day and type
    query.awaitTermination()
    return spark.table(name).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def q93_evaluation_turns(spark: SparkSession, folder: str) -> DataFrame:
    flags = rules.rule_flags(F.col("completion"), scenario_name(), UNWANTED, ROLE, 60, ASKING)
    rows = table(spark, folder, "results").withColumn("completion_tokens", F.col("usage_completion_tokens"))
    turns = traces.evaluation_turns(rows.withColumn("id", F.col("result_id").cast("string")), "m", flags)
    return turns.select("conversation_id", F.md5("content").alias("digest"), "completion_tokens", F.size("failures").alias("n_failures"))


def q94_usage(spark: SparkSession, folder: str) -> DataFrame:
    reply = F.to_json(F.struct(F.struct(F.col("n_tokens").alias("prompt_tokens"), F.col("usage_completion_tokens").alias("completion_tokens")).alias("usage")))
    return table(spark, folder, "results").select("result_id", traces.usage_struct(reply).alias("u"), traces.readiness_url(F.concat(F.lit("http://host/"), F.coalesce("source", F.lit("")), F.lit("/"))).alias("url")).select("result_id", "u.*", "url")


def q95_whole_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of all columns of every table."""
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "dialogues", "clean_results", "preference_pairs", "results", "raw_1", "eval_items", "sample_targets"]
    out = None
    for name in names:
        one = manifest.whole_digest(table(spark, folder, name), name)
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "q" and name[1].isdigit()}

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import clean, config, dedup, graph, judge, latency, manifest, remote, rules, sample, tasks
from colloquy.sources import files, formats
from colloquy.streaming import traces


def test_components_on_paths_rings_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 51), (51, 52), (52, 50), (70, 70), (None, 3)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 31)) and {got[50], got[51], got[52]} == {50} and got[70] == 70
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)]
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for e in edges for n in e}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [[rng.choice(vocabulary) for _ in range(40)] for _ in range(20)]
    for i in range(20):
        changed = list(texts[i])
        for _ in range(i % 4):
            changed[rng.randrange(40)] = "z"
        texts.append(changed)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, " ".join(texts[0])), (91, ""), (92, None), (93, "two words")]
    sets = {k: {" ".join(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    members, links = dedup.similar_texts(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), 0.5)
    got = {(r.a, r.b) for r in dedup.near_pairs(members, links).collect()}
    assert got == want and (0, 90) in got


def test_keep_best_prefers_real_then_long_then_early(spark):
    rows = spark.createDataFrame([(1, 1, "synthetic:x", 9), (2, 1, "hub", 5), (3, 1, "hub", 7), (4, 1, "hub", 7), (5, 2, None, 1)], "id long, c long, source string, n int")
    best = dedup.keep_best(rows, "c", "id", ~dedup.is_real(F.col("source")), -F.col("n"))
    assert {r.id for r in best.where("kept").collect()} == {3, 5}


def test_first_wins_across_sources_and_invalid_repeats(spark):
    m = lambda *x: [{"role": r, "content": c} for r, c in x]
    good, bad = m(("user", "hello there"), ("assistant", "fine thanks")), m(("assistant", "starts wrong"))
    rows = [(0, 1, "a", good), (1, 1, "b", good), (0, 2, "a", bad), (1, 2, "b", bad), (1, 3, "b", None), (1, 4, "b", m(("user", "only me")))]
    df = spark.createDataFrame(rows, "_src int, _ord int, source string, messages array<struct<role:string,content:string>>")
    out = {(r["_src"], r["_ord"]): r.drop_reason for r in clean.mark_invalid(clean.mark_duplicates(clean.clean(df, 2, F.lit("en")))).collect()}
    assert out == {(0, 1): None, (1, 1): "duplicate", (0, 2): "validation_failed", (1, 2): "duplicate", (1, 3): "conversion_failed", (1, 4): "empty_after_filter"}
    report = {(r.source, r.reason): r.n for r in clean.drop_report(clean.clean(df, 2, F.lit("en"))).collect()}
    assert report["all", "all"] == 6 and report["b", "conversion_failed"] == 1


def test_tags(spark):
    tag = clean.tag_scenario(F.col("t"), {"a": ["xx"], "b": ["yy", "zz"]})
    got = [r.t for r in spark.createDataFrame([("xx yy",), ("YY zz xx",), ("none",), (None,)], "t string").select(tag.alias("t")).collect()]
    assert got == ["a", "b", "general", "general"]
    assert clean.tag_scenario(F.col("t"), {}) is not None


def test_group_rank_with_a_hot_group_and_partitions(spark):
    rows = [(i % 3 if i % 4 else 7, (i * 7919) % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o int, id int")
    want = {}
    for g in {r[0] for r in rows}:
        for n, r in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == g), 1):
            want[r[1]] = n
    for parts in (1, 7):
        got = {r.id: r.rank for r in sample.group_rank(df.repartition(parts), ["g"], ["o", "id"]).collect()}
        assert got == want


def test_quota_sample_is_exact_and_stable(spark):
    rows = [(i, "abc"[min(2, i % 7)]) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, s string")
    a = {(r.id, r.s) for r in sample.quota_sample(df, "s", "id", 101).collect()}
    b = {(r.id, r.s) for r in sample.quota_sample(df.repartition(5).orderBy(F.desc("id")), "s", "id", 101).collect()}
    assert len(a) == 101 and a == b
    assert sample.quota_sample(df, "s", "id", 5000).count() == 700
    assert sample.quota_sample(df.limit(0), "s", "id", 10).count() == 0


def test_downsample_edges(spark):
    df = spark.createDataFrame([(i, i < 3, i in (3, 4), i in (4, 5)) for i in range(20)], "id long, syn boolean, high boolean, word boolean")
    run = lambda ratio, d=df: {r.id: r.why for r in sample.downsample(d, "id", ~F.col("syn"), F.col("high"), F.col("word"), ratio).collect()}
    out = run(2.0)
    assert (out[3], out[4], out[5]) == ("label_only", "both", "keyword_only") and sum(w == "filled" for w in out.values()) == 3
    assert all(w in ("synthetic", "dropped") for w in run(0.0).values())
    assert sum(w == "filled" for w in run(2.0, df.where("NOT syn")).values()) == 0


def test_split_cuts_and_strata(spark):
    df = spark.createDataFrame([(i, "s") for i in range(100)] + [(i, None) for i in range(100, 110)], "id long, s string")
    out = sample.stratified_split(df, "s", "id")
    counts = {(r.s, r.split): r["count"] for r in out.groupBy("s", "split").count().collect()}
    assert counts["s", "train"] == 90 and counts["s", "val"] == 5 and counts["s", "test"] == 5 and sum(counts.values()) == 110
    labels = sample.merge_small_strata([("a", "short", 30), ("a", "mid", 5), ("a", "long", 40), ("b", "short", 3), ("c", "mid", 4)], 20)
    assert labels["a", "short"] == "a|short" and labels["a", "mid"] == labels["a", "long"] == "a|mid+long" and labels["b", "short"] == labels["c", "mid"] == "a|mid+long"
    assert set(sample.merge_small_strata([("a", "short", 3)], 20).values()) == {"misc|all"}


@pytest.mark.parametrize("n,k", [(0, 3), (2, 3), (10, 3), (11, 4)])
def test_length_buckets_rotate(spark, n, k):
    df = spark.createDataFrame([(i, (i * 37) % 11) for i in range(n)], "id long, n int")
    rows = sample.length_buckets(df, F.col("n"), "id", k).orderBy("position").collect()
    assert [r.position for r in rows] == list(range(1, n + 1))
    assert [r.bucket for r in rows[: min(n, k)]] == list(range(1, min(n, k) + 1))


def test_every_kth(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id long")
    assert sorted(r.id for r in sample.every_kth(df, "id", 4).collect()) == [0, 2, 4, 6]


def test_rule_flags(spark):
    df = spark.createDataFrame([("It is 5 percent.", "info"), ("As an AI, no", "x"), (None, "info"), ("ok?", "info")], "t string, s string")
    flags = rules.rule_flags(F.col("t"), F.col("s"), [r"\d+ percent"], ["as an ai"], 3, ["info"])
    rows = [tuple(r.f) for r in df.select(flags.alias("f")).collect()]
    assert rows == [(True, True, False, True), (False, True, True, False), (False, False, False, True), (False, False, False, False)]


def test_judge_tables(spark):
    long = spark.createDataFrame([("j", "base", "s", "d", 2), ("j", "base", "s", "d", 4), ("j", "sft", None, "d", 3)], "judge string, tag string, scenario string, dimension string, score int")
    table = {(r.tag, r.scenario): (r["mean"], r["std"], r.n) for r in judge.cross_table(long, "judge", "tag", "scenario").collect()}
    assert table["base", "all"] == (3.0, 1.0, 2) and table["sft", "(none)"] == (3.0, 0.0, 1)
    pairs = judge.pairwise(judge.cross_table(long, "judge", "tag", "scenario").where("scenario = 'all'"), "judge", "tag").collect()
    assert [(p.tag_a, p.tag_b, p.diff, p.no_diff) for p in pairs] == [("base", "sft", 0.0, True)]


def test_stream_summary_and_rollup(spark):
    df = spark.createDataFrame([(10.0, [10.5, 11.0, 12.0], 3), (10.0, [], None), (10.0, [11.0], None)], "s double, c array<double>, n int")
    rows = [r.x for r in df.select(latency.summarise_stream(F.col("s"), F.col("c"), F.col("n")).alias("x")).collect()]
    assert (rows[0].ttft, rows[0].total, rows[0].gap_mean) == (0.5, 2.0, 0.75) and rows[1].ttft is None and rows[2].gap_mean is None
    with pytest.raises(Exception, match="decrease"):
        spark.createDataFrame([(1.0, [3.0, 2.0], 1)], "s double, c array<double>, n int").select(latency.summarise_stream(F.col("s"), F.col("c"), F.col("n"))).collect()
    log = spark.createDataFrame([(1, 0.0, 1.0, 1.0, 5, False), (1, 9.0, 5.0, 1.0, 5, True), (1, 10.0, 10.0, 2.0, 5, True), (1, 11.0, 30.0, None, None, True), (1, 12.0, None, None, 9, False), (2, 0.0, 1.0, 1.0, 1, False)], "c int, start_ts double, ttft_ms double, itl_mean_ms double, n_output_tokens int, ok boolean")
    got = {r.c: r for r in latency.tier_rollup(log, 100.0, 10.0, "c").collect()}
    assert set(got) == {1} and (got[1].n, got[1].n_ok, got[1].ttft_p50, got[1].tokens_per_s) == (3, 2, 20.0, 5 / 90)
    with pytest.raises(ValueError):
        latency.tier_rollup(log, 10.0, 10.0, "c")


def test_generations(spark):
    a = spark.createDataFrame([("p", "hello", [1, 2, 3]), ("q", "x", [1])], "id string, text string, token_ids array<int>")
    b = spark.createDataFrame([("p", "help", [1, 2, 4]), ("q", "x", [1])], "id string, text string, token_ids array<int>")
    verdicts = tasks.compare_generations(a, b, "id")
    totals = tasks.consistency(verdicts, "id").first()
    assert (totals.n_total, totals.n_mismatch, totals.consistent) == (2, 1, False) and [r.id for r in tasks.mismatches(verdicts, "id").collect()] == ["p"]
    assert tuple(tasks.count_changed(verdicts).first()) == (1, 2) and tasks.consistency(verdicts.limit(0), "id").first().consistent
    assert tasks.consistency(tasks.compare_generations(a, b, "id", "prefix", 2), "id").first().consistent
    with pytest.raises(Exception, match="unpaired"):
        tasks.compare_generations(a, b.limit(1), "id").collect()
    with pytest.raises(ValueError):
        tasks.compare_generations(a, b, "id", "other")
    diff = tasks.first_token_difference(F.col("a"), F.col("b"))
    rows = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1, 2]), ([1], [1])], "a array<int>, b array<int>").select(diff.alias("d")).collect()
    assert [r.d for r in rows] == [1, 1, None]


def test_remote_calls_retry_and_count(spark):
    def client():
        seen = {}

        def call(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "flaky" and seen[prompt] < 3:
                raise remote.Retryable("busy")
            return ("bad" if prompt == "wrong" else f"re: {prompt}"), 2, 3

        return call

    df = spark.createDataFrame([(1, "flaky"), (2, "wrong"), (3, None)], "id long, prompt string").coalesce(1)
    out = {r.id: r for r in remote.call_rows(df, "id", "prompt", client, retries=3, base_s=0.0, check=lambda r: "rejected" if r == "bad" else None).collect()}
    assert (out[1].ok, out[1].attempts) == (True, 3) and (out[2].ok, out[2].error, out[2].prompt_tokens) == (False, "rejected", 6) and out[3].error == "null_prompt"


def test_formats(spark):
    pairs = spark.createDataFrame([(" q ", "more", "a"), ("q", None, "a"), ("", None, "a"), ("q", None, " ")], "instruction string, input string, output string")
    got = [None if r.messages is None else r.messages[0].content for r in formats.instruction_pairs(pairs).collect()]
    assert got == ["q\n\nmore", "q", None, None]
    assert formats.instruction_pairs(spark.createDataFrame([("q",)], "instruction string")).first().messages is None
    rows = [([("system", "s"), ("human", "a"), ("human", "b"), ("gpt", "c")],), ([("robot", "a")],), ([("human", None)],), ([],), (None,), ([("system", "s")],)]
    out = [r.messages for r in formats.conversations(spark.createDataFrame(rows, "conversations array<struct<from:string,value:string>>")).collect()]
    assert [tuple(m) for m in out[0]] == [("system", "s"), ("user", "a\nb"), ("assistant", "c")] and out[1:] == [None] * 5
    wide = spark.createDataFrame([("Customer: hi", "Salesman: hello", " ", "Customer: x", "note", "Salesman: y", "Customer: z")], "`0` string, `1` string, `2` string, `3` string, `5` string, `10` string, `9` string")
    assert [(r.messages[0].content, r.messages[1].content) for r in formats.prefixed_pairs(wide).collect()] == [("hi", "hello"), ("z", "y")]
    with pytest.raises(ValueError):
        formats.to_records(pairs, "nope", "s")


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.jsonl")
    (tmp_path / "x.jsonl").write_text('{"id":"1","lang":"en","n_turns":1,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}\n\n{"id":"2","messages":[]}\n')
    good, bad = files.read_dialogues(spark, path)
    assert [r.id for r in good.collect()] == ["1"] and [r.error for r in bad.collect()] == ["empty"]
    assert files.write_jsonl(good.drop("_ord"), str(tmp_path / "out")) == 1
    (tmp_path / "raw_4.csv").write_text("start_ts,ttft_ms,itl_mean_ms,total_ms,n_output_tokens,ok\n1.5,2,,4,12.0,TRUE\n2,,1,1,,false\n")
    rows = files.read_request_folder(spark, str(tmp_path)).orderBy("start_ts").collect()
    assert (rows[0].n_output_tokens, rows[0].ok, rows[0].itl_mean_ms, rows[0].concurrency) == (12, True, None, 4) and rows[1].ok is False
    (tmp_path / "raw_5.csv").write_text("start_ts\n1\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_requests(spark, str(tmp_path / "raw_5.csv"))
    assert files.folder_size(spark, str(tmp_path), "raw_5.csv") == 11


def test_config_and_manifest(tmp_path):
    (tmp_path / "c.yaml").write_text("out_dir: data\nnested: {files: [a, /b]}\nname: x\n")
    own = config.load_config(str(tmp_path / "c.yaml"))
    assert own == {"seed": 42, "out_dir": str(tmp_path / "data"), "nested": {"files": [str(tmp_path / "a"), "/b"]}, "name": "x"}
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "l.yaml"))
    (tmp_path / "e.yaml").write_text("")
    assert config.load_config(str(tmp_path / "e.yaml")) == {"seed": 42}
    (tmp_path / "pyproject.toml").write_text("")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.yaml").write_text("seed: 7\npath_like: a\nlog_file: a/b\nlists: {in_dirs: [[x], y]}\nmodels_dir: {name: kept}\n")
    assert config.load_config(str(tmp_path / "sub" / "c.yaml")) == {"seed": 7, "path_like": "a", "log_file": str(tmp_path / "a/b"), "lists": {"in_dirs": [[str(tmp_path / "x")], str(tmp_path / "y")]}, "models_dir": {"name": "kept"}}
    path = manifest.Manifest([manifest.Input.of(str(tmp_path / "l.yaml"))], stats={"n": 1}, git_commit="c").save(str(tmp_path / "m"))
    stored = json.load(open(path))
    assert stored["inputs"][0]["size_bytes"] == 4 and stored["git_commit"] == "c" and stored["created_at"].endswith("+00:00")
    assert manifest.commit_of(str(tmp_path)) is None
    assert manifest.size_report(8, 2)["ratio"] == 4 and manifest.size_report(0, 0)["ratio"] is None


def test_streaming_windows_and_sinks(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    pd.DataFrame({"conversation_id": ["a", "a", "b"], "latency_ms": [1.0, 2.0, 3.0], "ts": pd.to_datetime(["2026-01-01 00:00:10", "2026-01-01 00:00:50", "2026-01-01 00:02:00"])}).to_parquet(source / "p.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    schema = "conversation_id string, latency_ms double, ts timestamp_ntz"
    stream = spark.readStream.schema(schema).parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp"))
    failures = []

    def broken(batch, number):
        raise RuntimeError("down")

    query = traces.record_turns(stream, traces.fan_out([broken, traces.json_sink(str(tmp_path / "out"))], failures), str(tmp_path / "ck"))
    assert query.awaitTermination(60) and len(failures) == 1
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    rolled = traces.window_rollup(spark.read.schema(schema).parquet(str(source)).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "latency_ms", "conversation_id", "1 minute").collect()
    assert sorted((r.conversation_id, r.n, r.total) for r in rolled) == [("a", 2, 3.0), ("b", 1, 3.0)]
    live = traces.window_rollup(stream, "ts", "latency_ms", "conversation_id", "1 minute", late="1 minute")
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60) and spark.table("live").count() == 2


def test_task_matrix_cycles(spark):
    axes = [spark.createDataFrame([("a",), ("b",)], "p string"), spark.createDataFrame([(1,), (2,), (3,)], "q int")]
    rows = tasks.task_matrix(axes, 14).orderBy("task_idx").collect()
    assert [r.task_idx for r in rows] == list(range(14)) and len({(r.p, r.q) for r in rows[:6]}) == 6
    assert tasks.task_matrix(axes, 4).count() == 4


def test_shingles_of_short_texts(spark):
    out = spark.createDataFrame([("a b",), ("",), (None,), ("a b c d e f",)], "t string").select(F.size(X.shingle_hashes(5)(F.col("t"))).alias("n")).collect()
    assert [r.n for r in out] == [1, 0, 0, 2]

import json

import pytest
from pyspark.sql import functions as F

from colloquy.functions import messages as M
from colloquy.functions import text as X
from colloquy.operators import dedup, gates, latency, logs, manifest, ordered, percentiles, remote, runs, sample, tasks
from colloquy.streaming import traces

MSG = "array<struct<role:string,content:string>>"


def test_rounds_ask_again_only_for_what_failed(spark):
    def client():
        def call(prompt):
            return ("no" if "bad" in prompt else json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]})), 1, 2

        return call

    rows = spark.createDataFrame([(1, "fine", "x"), (2, "bad", "x"), (3, None, None)], "id long, word string, topic string")
    run = runs.synthesise(rows, "id", "Write: {word}", {"word": F.col("word")}, client, lambda r: gates.gate_dialogue(r, 1), rounds=3, base_s=0.0)
    assert {r.id for r in run.accepted.collect()} == {1, 3} and [(r.id, r.error) for r in run.abandoned.collect()] == [(2, "not_json")]
    assert run.usage.groupBy("id").count().where("id = 2").first()["count"] == 3 and run.usage.count() == 5
    assert [tuple(r) for r in runs.error_histogram(run.abandoned).collect()] == [("not_json", 1)]
    report = {r.topic: (r.tasks, r.accepted, r.requests, r.prompt_tokens) for r in runs.cost_report(run, rows, "id", "topic").collect()}
    assert report == {"x": (2, 1, 4, 4), "(none)": (1, 1, 1, 1)}
    empty = runs.synthesise(rows.limit(0), "id", "{word}", {"word": F.col("word")}, client, lambda r: gates.gate_dialogue(r, 1))
    assert empty.accepted.count() == empty.abandoned.count() == empty.usage.count() == 0


def test_judge_run(spark):
    def judge(name):
        return lambda: lambda prompt: ("hm" if "odd" in prompt else json.dumps({"clear": 3 if name == "a" else 5}), 10, 1)

    rows = spark.createDataFrame([("1", "base", "s", [("user", "q")], "good"), ("1", "sft", None, None, "odd"), ("2", "sft", "s", [], None)], f"id string, tag string, scenario string, prompt_messages {MSG}, completion string")
    run = runs.run_judge(rows, ["a", "b"], "{context}|{reply}", judge, ["clear"], rounds=2, base_s=0.0)
    assert sorted((r.id, r.tag, r.judge, r.scores["clear"]) for r in run.scores.collect()) == [("1", "base", "a", 3), ("1", "base", "b", 5), ("2", "sft", "a", 3), ("2", "sft", "b", 5)]
    assert {(r.tag, r.judge, r.error) for r in run.failures.collect()} == {("sft", "a", "not_json"), ("sft", "b", "not_json")}
    assert {(r.judge, r.requests, r.prompt_tokens) for r in run.usage.collect()} == {("a", 4, 40), ("b", 4, 40)}
    whole, pairs = run.tables()
    assert whole.where("scenario = 'all'").count() == 4 and pairs.count() == 2


def test_streamed_calls(spark):
    def client():
        def call(prompt):
            if prompt == "broken":
                raise RuntimeError("down")
            yield from ["a", "", "b"]

        return call

    class Clock:
        now = 0.0

        def __call__(self):
            Clock.now += 1.0
            return Clock.now

    df = spark.createDataFrame([(1, "x"), (2, "broken"), (3, None)], "id long, prompt string").coalesce(1)
    rows = {r.id: r for r in runs.stream_rows(df, "id", "prompt", client, 1, Clock()).collect()}
    assert rows[1].text == "ab" and len(rows[1].chunk_times) == 2 and rows[2].error == "RuntimeError: down" and rows[3].error == "null_prompt"
    told = spark.createDataFrame([("g", 0.0, [1.0, 2.0], None), ("g", 0.0, [2.0, 4.0], None), ("g", 0.0, [], "x")], "g string, start double, chunk_times array<double>, error string")
    got = runs.stream_rollup(told, "g").first()
    assert (got.n, got.wall_s, got.tokens_per_s, got.speedup, got.ttft_p50) == (2, 4.0, 1.0, 1.5, 1.5)


def test_exact_percentiles_of_hot_and_empty_groups(spark):
    rows = [("a", float(i)) for i in range(101)] + [("b", None), ("c", float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r.x for r in percentiles.exact_percentiles(df, ["g"], {"x": (F.col("v"), (0.5, 0.95, 0.001))}).collect()}
    assert set(got) == {"a", None} and (got["a"].p50, got["a"].p95) == (50.0, 95.0) and got[None].p50 == 3.0
    whole = percentiles.exact_percentiles(df, [], {"x": (F.col("v"), (0.5,))}).first()
    assert whole.x.p50 == 49.5


def test_gaps_across_partitions(spark):
    df = spark.createDataFrame([("u", 10 * i, i) for i in range(200)] + [("v", 5, 0), (None, 1, 0), (None, 4, 1)], "u string, t long, o long").repartition(7)
    out = latency.gaps(df, "u", F.col("t"), "o").collect()
    assert sum(r.gap is None for r in out) == 3 and all(r.gap == 10 for r in out if r.u == "u" and r.o) and len(out) == 203


def test_islands_across_partitions(spark):
    rows = [("u", i, "ab"[(i // 7) % 2]) for i in range(140)] + [("v", 1, None), ("v", 2, None), (None, 1, "a"), (None, 2, "a")]
    out = ordered.islands(spark.createDataFrame(rows, "k string, t int, v string").repartition(6), "k", "v", "t").collect()
    assert {(r.t, r.run) for r in out if r.k == "u"} == {(i, i // 7 + 1) for i in range(140)}
    assert sorted(r.run for r in out if r.k == "v") == [1, 2] and [r.run for r in out if r.k is None] == [1, 1]
    assert ordered.islands(spark.createDataFrame([], "k string, t int, v string"), "k", "v", "t").count() == 0


def test_banded_links_against_the_exact_join(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:-1] + ["x"])), (3 * i + 2, " ".join(words[:30] + [f"y{i}"] + words[31:]))]
    df = spark.createDataFrame(rows + [(1000, ""), (1001, None), (1002, rows[0][1])], "id long, text string")
    exact, banded = (f(df, "id", F.col("text"), 0.85)[1] for f in (dedup.similar_texts, dedup.near_dup_lsh))
    want, got = ({(r.a, r.b) for r in x.collect()} for x in (exact, banded))
    assert got <= want and len(got) >= 0.95 * len(want) > 50


def edited_texts(rng, groups: int, length: int) -> list[str]:
    """Groups of a text, copies of it and texts with one to four words changed, lost or added; all share some sentences."""
    common, texts = [[f"c{i}_{j}" for j in range(12)] for i in range(6)], []
    for g in range(groups):
        words = [w for _ in range(max(1, length // 30)) for w in [*rng.choice(common), *(f"w{rng.randrange(4000)}" for _ in range(18))]][: 3 + rng.randrange(length)]
        for edits in (0, 0, 1, 2, 4):
            own = list(words)
            for e in range(edits):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = [f"x{g}_{e}"] * rng.randrange(2)
                own = own or ["left"]
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.85])
def test_near_duplicates_against_all_pairs(spark, similarity):
    import random

    texts = edited_texts(random.Random(5), 60, 120) + edited_texts(random.Random(6), 20, 900)
    sets = [set(dedup.X.word_runs(t)) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity}
    members, links = dedup.similar_texts(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5), "id", F.col("text"), similarity)
    pairs = [(r.a, r.b) for r in dedup.near_pairs(members, links).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 150


def stored(spark) -> int:
    from pathlib import Path

    from colloquy.session import shared_folder

    return sum(p.stat().st_size for p in Path(shared_folder(spark).removeprefix("file:")).rglob("part-*"))


def test_hashes_of_runs_are_those_of_the_words():
    import random

    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a b c d", "d c b a", "a b c d e", "a  b c\td e"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(300)]
    words = [(text or "").split() for text in texts]
    runs = [{tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set() for own in words]
    sizes, hashes = dedup.X.run_hashes(texts)
    assert sizes.tolist() == [len(own) for own in runs]
    own, at = {}, 0
    for want, n in zip(runs, sizes):
        got = tuple(hashes[at : at + n].tolist())
        assert list(got) == sorted(set(got)) and own.setdefault(frozenset(want), got) == got
        at += n
    # As many hashes as runs: no two runs share one, and each has the same in every text.
    assert at == len(hashes) and len(set(hashes.tolist())) == len(set().union(*runs)) and len(set(own.values())) == len(own)


def shuffled(spark) -> int:
    """Bytes of shuffle files on disk."""
    from pathlib import Path

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for folder in folders for p in Path(folder).rglob("shuffle_*.data"))


def test_durable_tables_leave_no_shuffle_files(spark):
    from colloquy.session import CLEANUP, durable

    df = spark.range(200_000).groupBy((F.col("id") % 70_000).alias("k")).agg(F.count("*").alias("n"))
    before = shuffled(spark)
    out = durable(df)
    assert shuffled(spark) <= before and spark.conf.get(CLEANUP) == "false"
    # The table and the plan it came from can still be read.
    assert out.agg(F.sum("n")).first()[0] == df.agg(F.sum("n")).first()[0] == 200_000 and out.count() == 70_000


def test_leakage_keeps_no_shuffles_of_its_search(spark):
    df, before = long_texts(spark), shuffled(spark)
    links = dedup.similar_texts(df, "id", F.col("text"), 0.8)[1]
    assert shuffled(spark) - before < 8 * 200 * 60 and links.count() == 0


def test_clusters_keep_no_shuffles_of_their_rounds(spark):
    from colloquy.operators.graph import components

    links, before = spark.range(30_000).select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 10).alias("b")), shuffled(spark)
    found = components(links)
    assert shuffled(spark) - before < 30_000
    assert found.where("component = node - node % 10").count() == found.count() == 30_000


def long_texts(spark):
    """200 texts of 296 shingles."""
    import random

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(99)}_{j}" for j in range(300)) for _ in range(200)]
    return spark.createDataFrame([(i, t, "train" if i % 2 else "val") for i, t in enumerate(texts)], "id long, text string, split string")


def test_near_duplicates_store_no_whole_sets(spark):
    df, before = long_texts(spark), stored(spark)
    dedup.similar_texts(df, "id", F.col("text"), 0.85)
    assert stored(spark) - before < 8 * 296 * 200


def test_leakage_stores_no_whole_sets(spark):
    df, before = long_texts(spark), stored(spark)
    df = df.union(df.where("id < 3").select(F.col("id") + 1000, F.concat("text", F.lit(" x")), F.lit("test")))
    out = dedup.leakage(df, "id", F.col("text"), "split", 0.8).collect()
    assert {(r.text_a, r.text_b, r.split_a, r.split_b, r.n_pairs) for r in out} == {(i, i + 1000, "train" if i % 2 else "val", "test", 1) for i in range(3)}
    assert stored(spark) - before < 8 * 296 * 200


def test_clusters_store_no_whole_sets(spark):
    df, before = long_texts(spark), stored(spark)
    df = df.select("id", "text").union(df.where("id < 3").select(F.col("id") + 1000, F.concat("text", F.lit(" x")))).union(df.where("id < 2").select(F.col("id") + 2000, "text"))
    out = {r.key: r.cluster_id for r in dedup.clusters(*dedup.similar_texts(df, "id", F.col("text"), 0.85)).collect()}
    assert out == {**{i: i for i in range(200)}, **{1000 + i: i for i in range(3)}, 2000: 0, 2001: 1}
    assert stored(spark) - before < 8 * 296 * 200


def test_leakage_counts_copies_without_expanding_them(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, text, "train") for i in range(50)] + [(100, text, "val"), (101, text, None), (102, "other words here entirely now", "val"), (103, None, "train")]
    out = dedup.leakage(spark.createDataFrame(rows, "id long, text string, split string"), "id", F.col("text"), "split").collect()
    assert [(r.text_a, r.text_b, r.split_a, r.split_b, r.n_pairs) for r in out] == [(0, 0, "train", "val", 50)]


def test_zip_and_examples(spark):
    a, b = spark.createDataFrame([(3,), (1,)], "x int"), spark.createDataFrame([("p",), ("q",)], "y string")
    assert {(r.x, r.y) for r in tasks.zip_rows(a, ["x"], b, ["y"]).collect()} == {(1, "p"), (3, "q")}
    with pytest.raises(Exception, match="different size"):
        tasks.zip_rows(a, ["x"], b.limit(1), ["y"]).collect()
    seeds = spark.createDataFrame([("s", i) for i in range(9)], "k string, seed int")
    matrix = spark.createDataFrame([(i, "s") for i in range(20)] + [(99, "none")], "task_idx int, k string")
    out = tasks.pick_examples(matrix, seeds, "k", "seed", 2, 4)
    counts = {r.task_idx: r["count"] for r in out.groupBy("task_idx").count().collect()}
    assert set(counts) == set(range(20)) and set(counts.values()) == {2, 3, 4} and out.select("task_idx", "seed").distinct().count() == out.count()
    with pytest.raises(ValueError, match="axis"):
        tasks.task_matrix([spark.range(tasks.AXIS_ROWS + 1)], 3)


def test_judge_samples(spark):
    df = spark.createDataFrame([(i, t, "ab"[i % 2]) for i in range(10) for t in ("base", "sft") if i != 3 or t == "base"], "id int, tag string, s string")
    out = sample.judge_samples(df, "id", "tag", "s", 4).collect()
    assert len(out) == 8 and 3 not in {r.id for r in out}
    with pytest.raises(ValueError):
        sample.judge_samples(df.where("id = 3 OR tag = 'sft' AND id = 4"), "id", "tag", "s")
    with pytest.raises(Exception, match="without id"):
        sample.judge_samples(spark.createDataFrame([(None, "base", "a"), (1, "base", "a")], "id int, tag string, s string"), "id", "tag", "s").collect()


def test_group_ids():
    assert sample.group_ids([30, 5, 40], 20) == [0, 1, 1] and sample.group_ids([30, 5], 20) == [0, 0] and sample.group_ids([3, 5], 20) == [-1, -1] and sample.group_ids([], 1) == []
    assert sample.merge_small_strata([], 5) == {} and sample.merge_small_strata([("a", "odd", 9), ("b", "short", 1)], 5) == {("a", "odd"): "a|odd", ("b", "short"): "a|odd"}


def test_preference_messages(spark):
    df = spark.createDataFrame([([("user", "q")], "a", None)], f"c {MSG}, x string, y string")
    p = df.select(M.to_preference(F.col("c"), F.col("x"), F.col("y"), "s").alias("p")).first().p
    assert [m.role for m in p.prompt] == ["system", "user"] and p.chosen[0].content == "a" and p.rejected[0].content is None
    for bad in ([("assistant", "q")], [], None):
        with pytest.raises(Exception, match="user message"):
            spark.createDataFrame([(bad,)], f"c {MSG}").select(M.to_preference(F.col("c"), F.lit("a"), F.lit("b"))).collect()


def test_sinks(spark, tmp_path):
    noted = []

    def down(batch, number):
        raise RuntimeError("away")

    sink = traces.make_sink(str(tmp_path / "a"), "remote", down, noted)
    sink(spark.range(3), 0)
    assert spark.read.json(str(tmp_path / "a")).count() == 3 and noted == ["batch 0: away"]
    assert traces.make_sink("x", "disabled") is None and traces.sink_provider({"K": " "}, ["K"]) == "local" and traces.sink_provider({"K": "v"}, ["K"]) == "remote"
    with pytest.raises(ValueError):
        traces.make_sink("x", "other")
    shape = spark.createDataFrame([('{"num_hidden_layers": 2, "num_attention_heads": 4, "hidden_size": 64}',)], "c string").select(manifest.model_shape("c").alias("m")).first().m
    assert tuple(shape) == (2, 4, 16)
    assert remote.RESULT and X.band_hashes(2, 2) is not None and logs.strip_keys([], ["a"]) == []

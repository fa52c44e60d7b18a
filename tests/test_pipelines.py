import random

import pytest
from pyspark.sql import functions as F

from colloquy import sqlapi
from colloquy.operators import gates, logs
from colloquy.plans import catalogue, oracles, pipeline

MSG = "array<struct<role:string,content:string>>"


def test_normalise_two_sources(spark):
    alpaca = spark.createDataFrame([(1, "How do I read the meter and what is the bill", "You can read the number on the label and send it to us"), (2, "", "x")], "_ord long, instruction string, output string")
    chats = spark.createDataFrame([(1, [("human", "How do I read the meter and what is the bill"), ("gpt", "You can read the number on the label and send it to us")]), (2, [("human", "hello is this the right desk for you"), ("gpt", "yes it is the desk"), ("human", "good")])], "_ord long, conversations array<struct<from:string,value:string>>")
    kept, report = pipeline.normalise_sources([("a", "alpaca", alpaca), ("b", "sharegpt", chats)], {"bills": ["bill"]})
    rows = {r.source: r for r in kept.collect()}
    assert rows["a"].scenario == "bills" and rows["b"].scenario == "general" and rows["b"].n_turns == 1 and len(rows["b"].messages) == 2
    counts = {(r.source, r.reason): r.n for r in report.collect()}
    assert counts["b", "duplicate"] == 1 and counts["a", "conversion_failed"] == 1 and counts["all", "kept"] == 2


def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, "synthetic:x" if i < 40 else "hub", rng.choice(["a", "b"]), rng.choice([1, 6]), [("user", text), ("assistant", text[::-1])]))
    rows.append((500, "hub", "a", 1, rows[50][4]))
    return spark.createDataFrame(rows, f"id long, source string, scenario string, n_turns int, messages {MSG}")


def test_split_pipeline(spark):
    out = pipeline.split_with_gate(corpus(spark), "id", ["w1"], ["a"], 2.0, least=10)
    blank = corpus(spark).limit(1).withColumn("id", F.lit(900).cast("long")).withColumn("messages", F.lit(None).cast(MSG))
    kept = pipeline.split_with_gate(corpus(spark).unionByName(blank.withColumn("source", F.lit("synthetic:y"))), "id", least=10)
    assert kept.rows.where("id = 900").count() == 1
    assert out.stats["leaks"] == 0 and sum(v for k, v in out.stats.items() if k != "leaks") == out.rows.count()
    assert not out.rows.where("id = 500").count() or not out.rows.where("id = 50").count()


def test_leak_gate_raises(spark, monkeypatch):
    monkeypatch.setattr(pipeline.dedup, "leakage", lambda *a, **k: spark.createDataFrame([(1, 2, "train", "val", 1.0, 3)], "text_a long, text_b long, split_a string, split_b string, similarity double, n_pairs long"))
    with pytest.raises(pipeline.LeakageFound):
        pipeline.split_with_gate(corpus(spark).limit(30), "id")


def test_gates(spark):
    good = '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'
    cases = [(f"```json\n{good}\n```", None), ("no", "not_json"), ('{"x":1}', "schema"), (good.replace('"b"', "3"), "schema"), (good.replace("assistant", "robot"), "schema"), (good.replace('"b"', '" "'), "semantic"), (good.replace('"b"', '"5 dollars"'), "forbidden_text")]
    got = [r.g.error for r in spark.createDataFrame([(c[0],) for c in cases], "t string").select(gates.gate_dialogue(F.col("t"), 1, [r"\d+ dollars"]).alias("g")).collect()]
    assert got == [c[1] for c in cases]
    assert spark.createDataFrame([(good,)], "t string").select(gates.gate_dialogue(F.col("t"), 2).alias("g")).first().g.error == "too_few_turns"
    pair = '{"context":[{"role":"user","content":"a"}],"chosen":"one two","rejected":"three"}'
    cases = [(pair, None), ("x", "not_json"), (pair.replace('"three"', '""'), "schema"), (pair.replace("three", "one two"), "low_divergence"), (pair.replace("one two", "5 dollars"), "forbidden_text"), ('{"context":[]}', "schema")]
    got = [r.g.error for r in spark.createDataFrame([(c[0],) for c in cases], "t string").select(gates.gate_preference(F.col("t"), 0.2, [r"\d+ dollars"]).alias("g")).collect()]
    assert got == [c[1] for c in cases]


def test_trainer_logs(spark):
    df = spark.createDataFrame([([(1, 2.0, None), (2, None, 1.5), (None, 9.0, None)],)], "log_history array<struct<step:int,loss:double,eval_loss:double>>")
    assert sorted(tuple(r) for r in logs.log_series(df, ["loss", "eval_loss", "absent"]).collect()) == [("eval_loss", 2, 1.5), ("loss", 1, 2.0)]
    assert logs.best_loss(df) == 1.5 and logs.best_loss(df, metric="absent") is None
    node = {"a": {"drop": 1, "b": [{"drop": 2}]}}
    assert logs.strip_keys(node, ["drop"]) == ["a.drop", "a.b[0].drop"] and logs.strip_keys(node, ["drop"]) == []


def test_sql_functions(spark):
    assert "count_tokens" in sqlapi.register(spark)
    row = spark.sql("SELECT strip_space('\t a '), collapse_space(' A  b '), count_tokens('Über, ja'), turn_bucket(7), short_id('x-', 'a')").first()
    assert tuple(row)[:4] == ("a", "a b", 3, "mid") and row[4].startswith("x-ca978112")


def test_evaluate(spark):
    df = spark.createDataFrame([("<think>x</think>ok?", "s"), ("as an AI", None)], "completion string, scenario string")
    rows = {r.scenario: r for r in pipeline.evaluate(df, role_patterns=["as an ai"]).collect()}
    assert rows["all"].n == 2 and rows["all"].n_role_break == 1 and rows["s"].tokens_p50 == 2.0


def test_catalogue_has_sql_for_known_queries():
    assert set(oracles.oracle_sql()) <= set(catalogue.queries())

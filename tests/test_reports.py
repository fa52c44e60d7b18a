import pandas as pd
import pytest
from pyspark.sql import functions as F

from colloquy.functions import text as X
from colloquy.operators import judge, manifest, report, rules
from colloquy.streaming import traces


def test_templates_and_reasoning(spark):
    df = spark.createDataFrame([("<think> why </think> so", None), ("so", "given")], "c string, r string")
    content, reasoning = X.split_reasoning(F.col("c"), F.col("r"))
    assert [tuple(r) for r in df.select(content, reasoning).collect()] == [("so", "why"), ("so", "given")]
    assert df.select(X.fill_template("a {c}-{r}!", c=F.lit(1), r=F.col("r")).alias("x")).first().x == "a 1-!"
    with pytest.raises(ValueError):
        X.fill_template("{nope}")


def test_tables_and_pages(spark):
    rows = report.rounded(report.bounded_rows(spark.createDataFrame([("a|b", 2.675), (None, None)], "n string, v double")), {"v": 2})
    assert report.markdown_table(rows, ["n", "v"]).splitlines()[2:] == ["| a\\|b | 2.67 |", "|  |  |"]
    with pytest.raises(ValueError):
        report.bounded_rows(spark.range(10), 5)
    flags = rules.rule_flags(F.lit("no"), F.lit("s"), ["no"])
    turns = spark.createDataFrame([("c", 2, "<b>", 5.0), ("c", 1, "x", 1.0)], "conversation_id string, turn_index int, content string, latency_ms double").withColumn("failures", rules.failures(flags, F.col("turn_index")))
    page = report.trace_page(turns)
    assert page.index("<p>x") < page.index("&lt;b&gt;") and "pattern_hit" in page
    summary = traces.trace_summary(turns.withColumn("prompt_tokens", F.lit(1)).withColumn("completion_tokens", F.lit(2))).first()
    assert (summary.turns, summary.failed_turns, summary.latency_ms) == (2, 2, 6.0)


def test_averages_and_ids(spark):
    table = spark.createDataFrame([("j1", "t", "d", 2.0), ("j2", "t", "d", 4.0)], "judge string, tag string, dimension string, mean double")
    assert judge.average_over_judges(table, "tag").first()["mean"] == 3.0
    assert manifest.new_run_id("x").startswith("x-") and manifest.kv_budget_gib(10, 4, 1) == 5 and manifest.kv_bytes_per_token(36, 8, 128) == 147456


def test_conversation_state_over_two_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, n in enumerate((2, 3)):
        pd.DataFrame({"conversation_id": ["c"] * n, "failed": [True] + [False] * (n - 1), "latency_ms": [1.0] * n}).to_parquet(folder / f"{i}.parquet")
    stream = spark.readStream.schema("conversation_id string, failed boolean, latency_ms double").option("maxFilesPerTrigger", 1).parquet(str(folder))
    out = []
    query = traces.conversation_state(stream, None).writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    assert [(r.turns, r.failures, r.latency_ms) for r in out] == [(2, 1, 2.0), (5, 2, 5.0)]

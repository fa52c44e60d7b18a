"""Readers and writers: JSON lines, JSON arrays, Parquet exports, CSV request logs, reports, and digests.

Every reader of ordered files adds ``_ord``, an ordinal that keeps the order of
the rows in the file where the first of equal rows must win.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy import types as R
from colloquy.functions import messages as M


def with_order(df: DataFrame) -> DataFrame:
    """Adds ``_ord``: increasing within and across the partitions of a file scan."""
    return df.withColumn("_ord", F.monotonically_increasing_id())


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, malformed ones raise."""
    reader = spark.read.option("mode", "FAILFAST")
    return with_order((reader.schema(schema) if schema else reader).json(path))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One JSON array per file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return with_order((reader.schema(schema) if schema else reader).json(path))


def read_local(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: ``.jsonl`` as lines, ``.parquet`` as an exported hub split, anything else as a JSON array."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if path.endswith(".parquet"):
        return with_order(spark.read.parquet(path))
    return read_json_array(spark, path, schema)


def write_jsonl(df: DataFrame, path: str) -> int:
    """Overwrites JSON lines with explicit nulls; returns the number of rows without a second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return seen.get["rows"]


def split_valid(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and one row per error of the others."""
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0).withColumn("error", F.explode(errors)).drop(errors)


def read_dialogues(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid dialogues and the errors of the rest."""
    rows = read_jsonl(spark, path, R.DIALOGUE)
    return split_valid(rows.withColumn("errors", M.validation_errors(F.col("messages"), F.col("n_turns"), F.col("lang"))))


def read_preferences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = read_jsonl(spark, path, R.PREFERENCE)
    return split_valid(rows.withColumn("errors", M.preference_errors(F.col("context"), F.col("chosen"), F.col("rejected"))))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Prompts that must end with a user message; others raise."""
    rows = read_jsonl(spark, path, T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.StringType()), T.StructField("context", R.MESSAGES)]))
    fine = F.coalesce(F.get("context", F.size("context") - 1)["role"] == "user", F.lit(False))
    return rows.withColumn("id", F.when(fine, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("context must end with a user message: "), "id"))))


def read_seeds(spark: SparkSession, path: str, key: str, schema: T.StructType | None = None) -> DataFrame:
    """Seed rows as they are, with ``_ord``; rows without a key raise. Grouping by key is left to the joins that use them."""
    rows = read_jsonl(spark, path, schema)
    return rows.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit(f"a seed without {key}")).cast("string")))


def read_results(spark: SparkSession, folders: Sequence[str], schema: T.StructType | None = None, file: str = "results.jsonl") -> DataFrame:
    """One results file per folder; the folder's name is the tag. An empty file raises."""
    frames = []
    for folder in folders:
        df = read_jsonl(spark, os.path.join(folder, file), schema)
        if df.isEmpty():
            raise ValueError(f"no rows in {folder}/{file}")
        frames.append(df.withColumn("model_tag", F.lit(os.path.basename(folder.rstrip("/")))))
    if not frames:
        raise ValueError("no result folders")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


REQUEST_COLUMNS = [f.name for f in R.REQUEST.fields]


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """A CSV request log: blank is NULL, ``true`` in any case is true, ``12.0`` is an integer; missing columns raise."""
    raw = spark.read.option("header", True).csv(path)
    missing = sorted(set(REQUEST_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    value = lambda c: F.nullif(F.trim(c), F.lit(""))
    numbers = [value(c).cast("double").alias(c) for c in REQUEST_COLUMNS[:4]]
    return raw.select(*numbers, value("n_output_tokens").cast("double").cast("int").alias("n_output_tokens"), (F.lower(F.trim("ok")) == "true").alias("ok"))


def read_request_folder(spark: SparkSession, folder: str) -> DataFrame:
    """All ``raw_<concurrency>.csv`` of a folder with the tier from the file's name."""
    paths = [os.path.join(folder, x) for x in sorted(os.listdir(folder)) if x.startswith("raw_") and x.endswith(".csv")]
    if not paths:
        raise ValueError(f"no request logs in {folder}")
    out = None
    for path in paths:
        tier = int(os.path.basename(path)[4:-4])
        df = read_requests(spark, path).withColumn("concurrency", F.lit(tier))
        out = df if out is None else out.unionByName(df)
    return out


def write_csv_report(df: DataFrame, path: str, columns: Sequence[str], order: str) -> None:
    """A small report as one ordered CSV file; NULL is blank."""
    df.select(*columns).orderBy(order).coalesce(1).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_json_report(report: dict, path: str) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        json.dump(report, file, ensure_ascii=False, indent=2, sort_keys=True)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, sha256, size_bytes`` of files, read in parallel."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def folder_size(spark: SparkSession, path: str, pattern: str) -> int:
    """Bytes of all files that match; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

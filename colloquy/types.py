"""Record types: a message, a dialogue, a preference pair, an evaluation result, a request row."""

from __future__ import annotations

from pyspark.sql import types as T

ROLES = ("system", "user", "assistant")

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
MESSAGES = T.ArrayType(MESSAGE)
META = T.MapType(T.StringType(), T.StringType())

DIALOGUE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("source", T.StringType()), T.StructField("scenario", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("n_turns", T.IntegerType()), T.StructField("meta", META), T.StructField("messages", MESSAGES),
])
PREFERENCE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("scenario", T.StringType()), T.StructField("context", MESSAGES),
    T.StructField("chosen", T.StringType()), T.StructField("rejected", T.StringType()), T.StructField("meta", META),
])
REQUEST = T.StructType([
    T.StructField("start_ts", T.DoubleType()), T.StructField("ttft_ms", T.DoubleType()), T.StructField("itl_mean_ms", T.DoubleType()),
    T.StructField("total_ms", T.DoubleType()), T.StructField("n_output_tokens", T.IntegerType()), T.StructField("ok", T.BooleanType()),
])
TRACE_TURN = T.StructType([
    T.StructField("conversation_id", T.StringType()), T.StructField("turn_index", T.IntegerType()), T.StructField("scenario", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()), T.StructField("prompt_tokens", T.IntegerType()), T.StructField("completion_tokens", T.IntegerType()), T.StructField("ts", T.TimestampType()),
])

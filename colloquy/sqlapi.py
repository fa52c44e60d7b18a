"""The string functions for SQL: temporary functions with SQL bodies, so the optimiser sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from colloquy.functions import text as X


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    space = X.SPACE
    bodies = {
        "strip_space(t STRING) RETURNS STRING": f"regexp_replace(t, {_literal(f'^{space}+|{space}+' + chr(92) + 'z')}, '')",
        "collapse_space(t STRING) RETURNS STRING": f"regexp_replace(lower(regexp_replace(t, {_literal(f'^{space}+|{space}+' + chr(92) + 'z')}, '')), {_literal(space + '+')}, ' ')",
        "count_tokens(t STRING) RETURNS INT": f"regexp_count(t, {_literal(X.TOKEN)})",
        "count_emails(t STRING) RETURNS INT": f"regexp_count(t, {_literal(X.EMAIL)})",
        "short_id(prefix STRING, t STRING) RETURNS STRING": "concat(prefix, substring(sha2(t, 256), 1, 12))",
        "turn_bucket(n INT) RETURNS STRING": "CASE WHEN n <= 4 THEN 'short' WHEN n <= 8 THEN 'mid' WHEN n IS NOT NULL THEN 'long' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.split("(")[0] for head in bodies]

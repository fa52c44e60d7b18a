"""Small results as text: rounded rows, Markdown tables, an HTML page of conversations.

Reports are for results of a bounded size; the bound is checked.
"""

from __future__ import annotations

import html
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 10_000


def bounded_rows(df: DataFrame, limit: int = REPORT_ROWS) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    return rows


def rounded(rows: Sequence[Mapping], digits: Mapping[str, int]) -> list[dict]:
    """Rounds half to even on the binary value, as reports do; other columns stay."""
    return [{k: round(v, digits[k]) if k in digits and v is not None else v for k, v in row.items()} for row in rows]


def markdown_table(rows: Sequence[Mapping], columns: Sequence[str]) -> str:
    """NULL is an empty cell; bars are escaped."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def trace_page(turns: DataFrame, title: str = "Traces", limit: int = REPORT_ROWS) -> str:
    """One section per conversation with its turns in order and their failures; more than ``limit`` turns raise."""
    rows = bounded_rows(turns.select("conversation_id", "turn_index", "content", "latency_ms", F.to_json("failures").alias("failures")), limit)
    parts, current = [f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"], object()
    for row in sorted(rows, key=lambda r: (r["conversation_id"] or "", r["turn_index"] or 0)):
        if row["conversation_id"] != current:
            parts += ["</ol>"] * (len(parts) > 1) + [f"<h2>{html.escape(row['conversation_id'] or '')}</h2><ol>"]
            current = row["conversation_id"]
        parts.append(f"<li><p>{html.escape(row['content'] or '')}</p><small>{row['latency_ms']} ms {html.escape(row['failures'] or '')}</small></li>")
    return "\n".join(parts + ["</ol>"] * (len(parts) > 1))

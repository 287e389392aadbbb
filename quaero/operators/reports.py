"""Summaries of runs and their acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaero.operators.evidence import MARKER


def run_summary(records: DataFrame, *keys: str, packed: bool = False) -> DataFrame:
    """For each of ``keys``: records, queries, statuses, truncation, blocks and tokens.

    ``records`` has query_id, prompt, status, truncated, tokens, packed_tokens,
    visible, full, partial, included.  Evidence of packed runs is also checked:
    what was included must be what is visible, and marked.
    """
    size = lambda c: F.coalesce(F.sum(F.size(F.coalesce(c, F.array().cast("array<bigint>")))), F.lit(0))
    count = F.coalesce("packed_tokens", "tokens")
    wrong = ~(F.col("visible").eqNullSafe(F.col("included")) & F.col("full").eqNullSafe(F.col("included")))
    own = [
        F.count("*").alias("record_count"), F.countDistinct("query_id").alias("unique_query_count"), F.count_if(F.col("status") == "ok").alias("ok_count"), F.count_if(F.col("status") == "error").alias("error_count"),
        F.count_if(F.col("truncated")).alias("truncated_count"), F.round(F.count_if(F.col("truncated")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("truncation_rate"),
        size("partial").alias("partial_blocks"), size("full").alias("full_blocks"), size("included" if packed else "full").alias("visible_evidence_ids"),
        (F.count_if(wrong) if packed else F.lit(0).cast("long")).alias("consistency_failures"), (F.count_if(~F.col("prompt").contains(f"[{MARKER} ")) if packed else F.lit(0).cast("long")).alias("marker_missing"),
        F.round(F.avg(count), 3).alias("token_mean"), F.max(count).alias("token_max"),
    ]
    return records.groupBy(*keys).agg(*own) if keys else records.agg(*own)


def acceptance(summary: DataFrame, expected: int) -> DataFrame:
    """A summary with whether each run is whole, without errors, and ready."""
    whole = (F.col("record_count") == expected) & (F.col("ok_count") == expected)
    ready = whole & (F.col("unique_query_count") == expected) & (F.col("partial_blocks") == 0) & (F.col("consistency_failures") == 0) & (F.col("marker_missing") == 0) & (F.col("truncated_count") == 0)
    return summary.withColumns({"all_ok": whole, "ready": ready})


def audit_by_method(audits: DataFrame) -> DataFrame:
    """Records, truncated ones, and partial and whole blocks for each method."""
    return audits.groupBy("method").agg(F.count("*").alias("record_count"), F.count_if("truncated").alias("truncated_count"), F.sum(F.size("partial")).alias("partial_blocks"), F.sum(F.size("full")).alias("full_blocks"))


def latency(results: DataFrame) -> DataFrame:
    """Mean latency of each retriever, to four places."""
    return results.groupBy("retriever").agg(F.round(F.avg("latency_ms"), 4).alias("avg_latency_ms"))


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small summary as a Markdown table (``limit`` rows at most; more are an error)."""
    rows = table.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    head = "| " + " | ".join(table.columns) + " |\n|" + "-|" * len(table.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def bundle(parts: dict[str, str | None]) -> dict:
    """JSON documents by name, read from texts; what is absent is pending."""
    import json

    return {k: json.loads(v) if v else {"status": "pending"} for k, v in sorted(parts.items())}

"""Batch requests and job manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.requests import chat_body, request_line


def build_request(
    df: DataFrame, source: str, kind: str, model: str, key: str = "row_idx", **prompts
) -> DataFrame:
    """(row_idx, line): one request line per row; NULL for a row without a source.

    ``kind`` is 'image' (binary column) or 'text' (string column).
    """
    body = chat_body(F.col(source), kind, model, **prompts)
    return df.select(F.col(key).alias("row_idx"), request_line(F.col(key), body).alias("line"))


def batch_gate(manifest: DataFrame, by: str | None = None) -> DataFrame:
    """Whether every batch is completed and has an output file, overall or per job."""
    has_file = F.coalesce("output_file_id", F.lit("")) != ""
    done = F.coalesce(F.col("status") == "completed", F.lit(False)) & has_file
    grouped = manifest.groupBy(by) if by else manifest.groupBy()
    return grouped.agg(F.coalesce(F.bool_and(done), F.lit(True)).alias("ready"))


def batch_status_report(manifest: DataFrame) -> DataFrame:
    """One line per batch and error, or one line for a batch without errors."""
    return manifest.select(
        "id", F.upper("status").alias("status"),
        F.col("request_counts.total").alias("total"),
        F.col("request_counts.completed").alias("completed"),
        F.col("request_counts.failed").alias("failed"),
        F.timestamp_seconds("created_at").alias("created_at"),
        F.explode_outer("errors.data").alias("e"),
    ).select("id", "status", "total", "completed", "failed", "created_at",
             F.col("e.code").alias("error_code"), F.col("e.message").alias("error_message"))

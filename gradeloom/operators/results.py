"""Result rows and their classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import FAILED_CALL_IMAGE, FAILED_IN_BENCHMARK
from gradeloom.functions.diagrams import check_diagram, render_error


def result_row(
    df: DataFrame,
    code: str = "uml_code",
    errors: str = "errors",
    failed_message: str = FAILED_CALL_IMAGE,
    keys: Sequence[str] = ("row_idx",),
) -> DataFrame:
    """Conversion results from (code, list of validation errors).

    A NULL code is a failed call; otherwise the row is valid when it has no errors.
    """
    failed = F.col(code).isNull()
    found = F.coalesce(F.col(errors), F.array().cast("array<string>"))
    return df.select(
        *keys,
        F.coalesce(F.col(code), F.lit("")).alias("uml_code"),
        (~failed & (F.size(found) == 0)).alias("uml_valid"),
        F.when(failed, F.lit(failed_message)).otherwise(F.array_join(found, "; "))
        .alias("uml_error"),
        failed.alias("llm_failed"),
    )


def check_predictions(
    df: DataFrame, code: str = "uml_pred", failed_message: str = FAILED_IN_BENCHMARK
) -> DataFrame:
    """Add validity columns to predictions by the local check; NULL is a failed call."""
    verdict = df.withColumn("_check", check_diagram(F.col(code)))
    failed = F.col(code).isNull()
    return verdict.withColumns({
        "uml_valid": ~failed & F.col("_check.valid"),
        "uml_error": F.when(failed, F.lit(failed_message)).otherwise(F.col("_check.error")),
        "llm_failed": failed,
        code: F.coalesce(F.col(code), F.lit("")),
    }).drop("_check")


def classify_render_response(df: DataFrame) -> DataFrame:
    """(row_idx, uml_valid, errors) from captured rendering responses."""
    reason = F.col("reason") if "reason" in df.columns else F.lit(None).cast("string")
    judged = df.select("row_idx", render_error(
        F.col("http_code"), reason, F.col("content_type"), F.col("body")).alias("_error"))
    return judged.select(
        "row_idx", F.col("_error").isNull().alias("uml_valid"),
        F.array_compact(F.array("_error")).alias("errors"))


def classify_outcome(failed: Column, valid: Column) -> Column:
    """One class per row; a row that is both valid and failed counts as valid."""
    return F.when(valid, "valid").when(failed, "llm_failure").otherwise("invalid")


def outcome_counts() -> dict[str, Column]:
    """The overlapping counts of the reports.

    ``invalid`` is what remains of the total; ``invalid_strict`` counts rows that are
    neither valid nor failed. They differ when a row is both.
    """
    n, valid, failed = F.count(F.lit(1)), F.count_if("uml_valid"), F.count_if("llm_failed")
    return {
        "n": n,
        "llm_failures": failed,
        "invalid": n - valid - failed,
        "valid": valid,
        "invalid_strict": F.count_if(~F.col("uml_valid") & ~F.col("llm_failed")),
    }


def fill_missing_text(df: DataFrame, columns: Sequence[str] = ("uml_pred", "uml_code_gt")) -> DataFrame:
    return df.na.fill("", list(columns))


def empty_reference_count(df: DataFrame, column: str = "uml_code_gt") -> DataFrame:
    return df.agg(F.count_if(F.col(column) == "").alias("n_empty"))

"""A model's answers to an evaluation split: checked, written and summarised."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.operators.joins import attach_results
from gradeloom.operators.reports import benchmark_summary, top_errors
from gradeloom.operators.results import check_predictions
from gradeloom.sources.sinks import write_results
from gradeloom.sources.splits import read_eval_split

RESULT = ("row_idx", "uml_code_gt", "uml_pred", "uml_valid", "uml_error", "llm_failed")


def benchmark_rows(split: DataFrame, answers: DataFrame) -> DataFrame:
    """Result rows of every row of an evaluation split.

    ``answers`` has (row_idx, uml_code), as ``latest_response`` gives it; a row without an
    answer, or with a NULL one, is a failed call. Images are not carried along.
    """
    answered = attach_results(split.drop("image_bytes"), answers.withColumnRenamed("uml_code", "uml_pred"))
    return check_predictions(answered).select(*RESULT)


def run_benchmark(spark: SparkSession, split_path: str, answers: DataFrame, target: str) -> dict[str, DataFrame]:
    """Write the result rows of a split and return their summary and most common errors."""
    write_results(benchmark_rows(read_eval_split(spark, split_path), answers), target)
    rows = spark.read.parquet(target)
    return {"summary": benchmark_summary(rows), "top_errors": top_errors(rows)}

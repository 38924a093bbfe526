"""Joins and unions on the row id. Sizes are left to the optimizer: no side is broadcast by hint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import BASE, FAILED_IN_BATCH, FINETUNED
from gradeloom.functions.diagrams import preflight_diagram
from gradeloom.operators.results import result_row
from gradeloom.sources.shards import table_rows, with_row_index
from gradeloom.sources.splits import reference_texts


def attach_results(source: DataFrame, results: DataFrame) -> DataFrame:
    """Source rows with their results; a row without one keeps NULLs."""
    return source.join(results, "row_idx", "left")


def attach_ground_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Replace the reference text by the authoritative one.

    Both must hold the same ids, once each and none of them NULL: otherwise they are not the
    same test split.
    """
    ids = predictions.select("row_idx", F.lit(1).alias("p"), F.lit(0).alias("t")).unionAll(
        truth.select("row_idx", F.lit(0), F.lit(1)))
    unpaired = ids.groupBy("row_idx").agg(F.sum("p").alias("p"), F.sum("t").alias("t")).where(
        "p <> 1 OR t <> 1 OR row_idx IS NULL")
    found = unpaired.agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first")).first()
    if found.n:
        raise ValueError(
            f"{found.n} row ids are missing, NULL or repeated in the predictions or the ground truth, "
            f"the first is {found['first']}; they must be the same test split")
    return predictions.drop("uml_code_gt").join(
        truth.select("row_idx", "uml_code_gt"), "row_idx")


def align_rows(left: DataFrame, right: DataFrame, out: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """Number two tables read from files by position, so that their n-th rows get one id.

    The two sets of files may be cut at different rows: the ids come from the row counts in the
    footers of either side. Unequal totals raise before any row is read. Filters on either side
    keep the ids of the whole table.
    """
    totals = table_rows(left), table_rows(right)
    if totals[0] != totals[1]:
        raise ValueError(
            f"{totals[0]} rows on one side and {totals[1]} on the other; they must be the same "
            "test split in the same order")
    return with_row_index(left, out), with_row_index(right, out)


def attach_ground_truth_by_position(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Replace the reference text of predictions without ids by the truth at the same position.

    Ids made from positions are dense and unique, so unlike ``attach_ground_truth`` nothing
    has to be counted by id: each side moves once, for the join.
    """
    predictions, truth = align_rows(predictions, truth)
    return predictions.drop("uml_code_gt").join(
        reference_texts(truth).select("row_idx", "uml_code_gt"), "row_idx")


def latest_response(responses: DataFrame, order: Sequence[str] = ("file_ord", "line_no")) -> DataFrame:
    """One response per row: the last one read, also when it is a failure.

    The running maximum is combined before the shuffle, so a row id that is repeated
    without end moves one record per task.
    """
    # Inside a struct a NULL text can win; on its own max_by would skip nothing but lose it.
    last = F.max_by(F.struct("uml_code"), F.struct(*order))
    return responses.groupBy("row_idx").agg(last.alias("_last")).select(
        "row_idx", F.col("_last.uml_code").alias("uml_code"))


def merge_responses(
    source: DataFrame, responses: DataFrame, failed_message: str = FAILED_IN_BATCH,
    check: Callable[[Column], Column] = preflight_diagram, keys: Sequence[str] = ("row_idx",),
) -> DataFrame:
    """Result rows for every source row; a row without a response is a failed call.

    ``responses`` may carry an ``errors`` list from validation; where it is NULL or missing,
    ``check`` gives the error of a code, or NULL: no answer counts as valid unchecked. Columns of ``source`` named in ``keys`` are kept.
    """
    found = F.array_compact(F.array(check(F.col("uml_code"))))
    if "errors" in responses.columns:
        found = F.coalesce("errors", found)
    responses = responses.withColumn("errors", found)
    joined = source.select(*keys).join(responses, "row_idx", "left")
    return result_row(joined, failed_message=failed_message, keys=keys)


def resume_increment(todo: DataFrame, done: DataFrame) -> DataFrame:
    """Rows not processed yet."""
    return todo.join(done.select("row_idx"), "row_idx", "left_anti")


def union_models(base: DataFrame, finetuned: DataFrame) -> DataFrame:
    """Both models' rows under a ``model`` label."""
    return base.withColumn("model", F.lit(BASE)).unionByName(
        finetuned.withColumn("model", F.lit(FINETUNED)))


def pair_models(measures: DataFrame, value: str = "value") -> DataFrame:
    """(measure, base, finetuned) from (model, measure, value)."""
    return measures.groupBy("measure").pivot("model", [BASE, FINETUNED]).agg(F.first(value))

"""Two models' predictions to scores, summaries and figure data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gradeloom.constants import BASE, FINETUNED
from gradeloom.operators import distributions as D
from gradeloom.operators import reports as R
from gradeloom.operators.joins import attach_ground_truth, attach_ground_truth_by_position, union_models
from gradeloom.operators.scoring import DETAIL, score_pairs
from gradeloom.sources.sinks import write_detail_csv
from gradeloom.sources.splits import reference_texts

DISTRIBUTION_METRICS = ("bleu", "codebleu", "emb_sim", "token_f1")


def score_models(
    base: DataFrame, finetuned: DataFrame, truth: DataFrame | None = None, detail: Sequence[str] = DETAIL,
) -> DataFrame:
    """Metric detail of both models, against the authoritative truth when given.

    A truth table without ids is matched by position, and so are predictions without ids.
    """
    if truth is not None:
        base, finetuned = (_with_truth(p, truth) for p in (base, finetuned))
    return union_models(score_pairs(base, BASE, detail=detail).drop("model"),
                        score_pairs(finetuned, FINETUNED, detail=detail).drop("model"))


def _with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    if "row_idx" in predictions.columns and "row_idx" in truth.columns:
        return attach_ground_truth(predictions, reference_texts(truth))
    return attach_ground_truth_by_position(predictions.drop("row_idx"), truth.drop("row_idx"))


def compare_models(
    base: DataFrame, finetuned: DataFrame, truth: DataFrame, target: str
) -> dict[str, DataFrame]:
    """Score once, write the detail, and return every report over the written table."""
    table = f"{target}/metrics_detail"
    score_models(base, finetuned, truth).write.mode("overwrite").parquet(table)
    scores = base.sparkSession.read.parquet(table)
    write_detail_csv(scores, f"{target}/metrics_detail_csv")
    reports = {
        "summary": R.metric_summary(scores),
        "delta": R.metric_delta(scores),
        "outcome_comparison": R.outcome_comparison(scores),
        "outcome_shares": R.outcome_shares(scores),
        "metric_means": R.metric_means(scores),
        "scatter": D.metric_scatter(scores),
        "validity_correctness": D.validity_correctness(scores),
    }
    for metric in DISTRIBUTION_METRICS:
        reports[f"density_{metric}"] = D.score_density(scores, metric)
        reports[f"histogram_{metric}"] = D.score_histogram(scores, metric)
    return reports

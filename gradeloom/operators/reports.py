"""Summaries and model comparisons.

Missing metric values are NULL; NaN from foreign tables is treated as missing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import BASE, FINETUNED, METRICS
from gradeloom.operators.joins import pair_models
from gradeloom.operators.results import outcome_counts


def present(metric: str) -> Column:
    return F.nullif(F.col(metric).cast("double"), F.lit(float("nan")))


def percent(part: Column, whole: Column) -> Column:
    """NULL for an empty table."""
    return F.try_divide(100.0 * part, whole)


def shard_census(df: DataFrame, by: Sequence[str] = ("file_name", "split")) -> DataFrame:
    """Rows per file and split."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def split_census(df: DataFrame) -> DataFrame:
    """Total rows, number of splits and the sorted split names, from the per-split counts."""
    per_split = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return per_split.agg(
        F.sum("n").alias("total"), F.count("split").alias("n_splits"),
        F.array_sort(F.collect_set("split")).alias("splits"))


def conversion_summary(df: DataFrame) -> DataFrame:
    """Overall counts (scope 'all') and one row per named split (scope 'split').

    The rows are reduced to one record per split first; the rollup runs over those.
    """
    counts = outcome_counts()
    names = ("n", "valid", "llm_failures")
    per_split = df.groupBy("split").agg(*[counts[c].alias(c) for c in names])
    overall = F.grouping("split") == 1
    n, valid, failed = (F.sum(c) for c in names)
    rolled = per_split.rollup("split").agg(
        F.when(overall, "all").otherwise("split").alias("scope"),
        n.alias("total"), valid.alias("uml_valid"), failed.alias("llm_failures"),
        (n - valid - failed).alias("uml_invalid"), percent(valid, n).alias("valid_pct"))
    return rolled.where((F.col("scope") == "all") | F.col("split").isNotNull())


def benchmark_summary(df: DataFrame) -> DataFrame:
    """n, failures, invalid and valid with their percentages."""
    counts = outcome_counts()
    names = ("llm_failures", "invalid", "valid")
    totals = df.agg(*[counts[c].alias(c) for c in ("n", *names)])
    return totals.select("n", *names, *[
        percent(F.col(c), F.col("n")).alias(f"{c}_pct") for c in names])


def top_errors(df: DataFrame, k: int = 5, key: str = "row_idx") -> DataFrame:
    """Most common errors of rows that did not fail; ties go to the first seen."""
    errors = df.where((F.col("uml_error") != "") & ~F.col("llm_failed"))
    return (
        errors.groupBy("uml_error")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_idx"))
        .orderBy(F.desc("n_rows"), "first_idx").limit(k)
    )


def outcome_comparison(df: DataFrame) -> DataFrame:
    """valid / invalid / failed of both models: count, percent and delta in points.

    A model without rows counts 0 of 1.
    """
    outcomes = ("valid", "invalid", "failed")

    def totals(model):
        of_model = F.col("model") == model
        n, valid, failed = (F.count_if(of_model & c) for c in (
            F.lit(True), F.col("uml_valid"), F.col("llm_failed")))
        return {"n": n, "valid": valid, "invalid": n - valid - failed, "failed": failed}

    wide = df.agg(*[c.alias(f"{m}_{name}") for m in (BASE, FINETUNED)
                    for name, c in totals(m).items()])
    rows = F.explode(F.array(*[F.struct(
        F.lit(o).alias("outcome"), *[F.col(f"{m}_{o}").alias(f"{m}_rows") for m in (BASE, FINETUNED)],
    ) for o in outcomes]))
    paired = wide.select(f"{BASE}_n", f"{FINETUNED}_n", rows.alias("o")).select("*", "o.*")
    share = {m: 100.0 * F.col(f"{m}_rows") / F.greatest(F.col(f"{m}_n"), F.lit(1))
             for m in (BASE, FINETUNED)}
    return paired.select(
        "outcome", f"{BASE}_rows", share[BASE].alias(f"{BASE}_pct"),
        f"{FINETUNED}_rows", share[FINETUNED].alias(f"{FINETUNED}_pct"),
        (share[FINETUNED] - share[BASE]).alias("delta_pp"))


def outcome_shares(df: DataFrame, denominator: str = BASE) -> DataFrame:
    """Percent of each outcome per model, over base's row count or each model's own ('own')."""
    counts = outcome_counts()
    columns = {"llm_failures": "llm_failures", "invalid": "invalid_strict", "valid": "valid"}
    per_model = df.groupBy("model").agg(
        counts["n"].alias("n"), *[counts[c].alias(o) for o, c in columns.items()])
    if denominator == "own":
        whole = F.col("n")
    else:
        whole = df.where(F.col("model") == denominator).agg(F.count(F.lit(1))).scalar()
    shares = per_model.select("model", *[percent(F.col(o), whole).alias(o) for o in columns])
    return shares.unpivot("model", list(columns), "outcome", "share_pct")


def available_metrics(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Metrics with at least one value, with the number of values."""
    counts = df.agg(*[F.count(present(m)).alias(m) for m in metrics])
    return counts.unpivot([], list(metrics), "metric", "n_values").where("n_values > 0")


def metric_means(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean of each metric per model; missing values are skipped."""
    return df.groupBy("model").agg(*[F.avg(present(m)).alias(m) for m in metrics])


def metric_summary(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """n, percent valid and the metric means as rows, one column per model.

    A metric without any value is left out.
    """
    per_model = df.groupBy("model").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(F.col("uml_valid").cast("double") * 100.0).alias("valid_pct"),
        *[F.avg(present(m)).alias(m) for m in metrics])
    measures = per_model.unpivot("model", ["n", "valid_pct", *metrics], "measure", "value")
    return pair_models(measures).where(F.coalesce(BASE, FINETUNED).isNotNull())


def metric_delta(df: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """finetuned − base per metric; the arrow points up only for a gain."""
    measures = metric_means(df, metrics).unpivot("model", list(metrics), "measure", "value")
    delta = F.col(FINETUNED) - F.col(BASE)
    return pair_models(measures).where(F.coalesce(BASE, FINETUNED).isNotNull()).select(
        F.col("measure").alias("metric"), delta.alias("delta"),
        F.when(delta > 0, "↑").otherwise("↓").alias("arrow"))

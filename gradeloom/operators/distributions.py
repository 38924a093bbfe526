"""Score distributions. Inputs are read more than once: pass a written score table."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import BASE, DEFAULT_THRESHOLD, FINETUNED, THRESHOLD_METRICS
from gradeloom.operators.reports import percent, present
from gradeloom.operators.selection import median_value

# The functions for the executors travel whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FLAT = 1e-6
# Kernels evaluated together.
KERNELS = 256


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the exact median of a column, selected without sorting or gathering it."""
    return df.sparkSession.range(1).select(F.lit(median_value(df, value)).cast("double").alias("median"))


def _similarity(df: DataFrame) -> tuple[Column, Column]:
    """Name and value of the first threshold metric that has any value."""
    counts = df.agg(*[F.count(present(m)).alias(m) for m in THRESHOLD_METRICS])
    name = counts.select(F.coalesce(*[
        F.when(F.col(m) > 0, m) for m in THRESHOLD_METRICS])).scalar()
    value = F.coalesce(*[F.when(name == m, present(m)) for m in THRESHOLD_METRICS])
    return name, value


def correctness_threshold(df: DataFrame) -> DataFrame:
    """(metric, threshold): median of the chosen metric over valid finetuned rows.

    Without such rows the threshold is 0.5. The median is selected by the values' bits in a fixed
    number of passes, so no column is sorted or gathered.
    """
    name, value = _similarity(df)
    judged = df.where((F.col("model") == FINETUNED) & F.col("uml_valid")).select(value.alias("v"))
    median = median_value(judged, "v")
    return df.sparkSession.range(1).select(
        name.alias("metric"), F.lit(DEFAULT_THRESHOLD if median is None else median).alias("threshold"))


def validity_correctness(df: DataFrame) -> DataFrame:
    """Percent invalid, valid but imprecise, and valid and correct, per model."""
    _, value = _similarity(df)
    threshold = correctness_threshold(df).select("threshold").scalar()
    good = F.coalesce(value, F.lit(0.0)) >= threshold
    n = F.count(F.lit(1))
    return df.where(F.col("model").isin(BASE, FINETUNED)).groupBy("model").agg(
        percent(F.count_if(~F.col("uml_valid")), n).alias("invalid_pct"),
        percent(F.count_if(F.col("uml_valid") & ~good), n).alias("imprecise_pct"),
        percent(F.count_if(F.col("uml_valid") & good), n).alias("correct_pct"))


def _spread(df: DataFrame, column: str) -> DataFrame:
    """Row count, mean, deviation and range of a metric per model."""
    values = df.select("model", present(column).alias("v")).where("v IS NOT NULL")
    return values.groupBy("model").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"),
        F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("std"),
        F.min("v").alias("low"), F.max("v").alias("high"))


def _with_spread(df: DataFrame, column: str, spread: DataFrame) -> DataFrame:
    # One row per compared model, and the two models are fixed.
    return df.where(F.col("model").isin(BASE, FINETUNED)).select(
        "model", present(column).alias("v")).where("v IS NOT NULL").join(
        F.broadcast(spread.where(F.col("model").isin(BASE, FINETUNED))), "model")


def score_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Density histogram per model, with the mean; flat data gives one bin at its value.

    Empty bins are kept and the last bin is closed.
    """
    spread = _spread(df, column)
    flat = F.col("std") <= FLAT
    width = (F.col("high") - F.col("low")) / bins
    slot = F.when(flat, 0).otherwise(F.least(
        F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    filled = _with_spread(df, column, spread).groupBy("model", slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n_rows"))
    last = F.when(flat, 0).otherwise(bins - 1)
    grid = spread.where(F.col("model").isin(BASE, FINETUNED)).select(
        "*", F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    rows = F.coalesce("n_rows", F.lit(0))
    return grid.join(filled, ["model", "bin"], "left").select(
        "model", "bin",
        F.when(flat, F.col("low")).otherwise(F.col("low") + F.col("bin") * width).alias("bin_low"),
        rows.alias("n_rows"),
        F.when(~flat, rows / (F.col("n") * width)).alias("density"),
        "mean")


def _masses(points: int):
    """Per task one dense grid of kernel sums for each model, whatever the number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("model").to_pylist(), object)
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "h", "x0", "dx")}
            for model in sorted(set(names.tolist())):
                mine = np.flatnonzero(names == model)
                values, repeats = np.unique(columns["v"][mine], return_counts=True)
                h, x0, dx = (columns[c][mine[0]] for c in ("h", "x0", "dx"))
                grid, x = grids.setdefault(model, np.zeros(points)), x0 + np.arange(points) * dx
                for low in range(0, len(values), KERNELS):
                    z = (x - values[low:low + KERNELS, None]) / h
                    grid += repeats[low:low + KERNELS] @ np.exp(-0.5 * z * z)
        for model, grid in grids.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * points), pa.array(np.arange(points, dtype=np.int32)), pa.array(grid)], ["model", "i", "mass"])
    return run


def score_density(df: DataFrame, column: str, points: int = 1000) -> DataFrame:
    """Gaussian kernel density per model (Scott bandwidth) on an even grid.

    The grid runs half a range beyond the data on both sides. Every row's kernel is summed at
    every point: a task adds its rows to one grid per model, and only the grids are shuffled.
    """
    spread = _spread(df, column).where(
        F.col("model").isin(BASE, FINETUNED) & (F.col("std") > FLAT)).select(
        "*", (F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        (F.col("low") - 0.5 * (F.col("high") - F.col("low"))).alias("x0"),
        (2.0 * (F.col("high") - F.col("low")) / (points - 1)).alias("dx"))
    sums = _with_spread(df, column, spread).select("model", "v", "h", "x0", "dx").mapInArrow(
        _masses(points), "model string, i int, mass double").groupBy("model", "i").agg(F.sum("mass").alias("mass"))
    grid = spread.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    scale = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    return grid.join(sums, ["model", "i"], "left").select(
        "model", "i", (F.col("x0") + F.col("i") * F.col("dx")).alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / scale).alias("density"))


def metric_scatter(df: DataFrame, x: str = "bleu", y: str = "emb_sim") -> DataFrame:
    """(model, x, y) points of rows that have both metrics."""
    return df.where(F.col("model").isin(BASE, FINETUNED)).select(
        "model", present(x).alias(x), present(y).alias(y)).dropna(subset=[x, y])

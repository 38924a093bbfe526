"""Readers of evaluation splits and ground truth; the layout is chosen from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.messages import assistant_text
from gradeloom.sources.shards import with_row_index


def _from_messages(df: DataFrame) -> Column:
    return assistant_text(F.col("messages"), df.schema["messages"].dataType)


def eval_split(df: DataFrame) -> DataFrame:
    """(image_bytes, uml_code_gt) from any of the three split layouts.

    The direct ground truth wins and an empty one falls back to the messages. Without an
    image column there is nothing to evaluate, so no rows are returned.
    """
    columns = set(df.columns)
    if "image_bytes" in columns:
        image = F.col("image_bytes")
    elif "sketch_image" in columns:
        image = F.col("sketch_image.bytes")
    else:
        return df.select(F.lit(None).cast("binary").alias("image_bytes"),
                         F.lit("").alias("uml_code_gt")).where(F.lit(False))
    truth = []
    if "uml_code" in columns:
        truth.append(F.nullif(F.col("uml_code"), F.lit("")))
    if "messages" in columns:
        truth.append(_from_messages(df))
    keep = ["row_idx"] if "row_idx" in columns else []
    return df.select(*keep, image.alias("image_bytes"),
                     F.coalesce(*truth, F.lit("")).alias("uml_code_gt"))


def ground_truth(df: DataFrame) -> DataFrame:
    """(row_idx, uml_code_gt) from a ``uml_code`` column or the assistant turns."""
    if "uml_code" in df.columns:
        truth = F.coalesce("uml_code", F.lit(""))
    elif "messages" in df.columns:
        truth = _from_messages(df)
    else:
        raise ValueError(
            f"no 'uml_code' or 'messages' column in ground truth; available: {df.columns}")
    keep = ["row_idx"] if "row_idx" in df.columns else []
    return df.select(*keep, truth.alias("uml_code_gt"))


def reference_texts(df: DataFrame) -> DataFrame:
    """A table that has ``uml_code_gt`` already, or its ``ground_truth``."""
    return df if "uml_code_gt" in df.columns else ground_truth(df)


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df if "row_idx" in df.columns else with_row_index(df)


def read_eval_split(spark: SparkSession, path: str) -> DataFrame:
    return eval_split(_indexed(spark, path))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return ground_truth(_indexed(spark, path))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Result rows of one model; rows without ids are numbered by position."""
    return _indexed(spark, path)

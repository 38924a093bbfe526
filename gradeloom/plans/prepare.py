"""A converted dataset to training data."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gradeloom.operators.curation import assign_split, format_training_chat, keep_valid
from gradeloom.sources.sinks import export_split


def prepare_training(df: DataFrame, test_path: str | None = None, key: str = "row_idx") -> DataFrame:
    """Valid rows, split and reshaped to chats; the test split is exported when asked for."""
    chats = format_training_chat(assign_split(keep_valid(df), key))
    if test_path:
        export_split(chats, "test", test_path)
    return chats

"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import REQUEST_FILE_CAP
from gradeloom.operators.chunks import BLOCK_ROWS, FAN_IN, part_index, request_sizes, with_part

LONG_TEXT = ("uml_code_gt", "uml_pred")


def write_results(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Persist results as Parquet; partitioned by split, later reads can prune."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def export_split(df: DataFrame, name: str, path: str) -> None:
    """Write one prepared split, in the chat layout."""
    df.where(F.col("split") == name).drop("split").write.mode("overwrite").parquet(path)


def write_detail_csv(df: DataFrame, path: str) -> None:
    """Metric detail without the long text columns, with a header.

    Quotes are doubled inside quoted fields, the usual CSV convention.
    """
    (df.drop(*LONG_TEXT).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def write_request_chunks(
    lines: DataFrame, path: str, cap: int = REQUEST_FILE_CAP,
    block_rows: int = BLOCK_ROWS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Write (row_idx, line) as text files of at most ``cap`` bytes, in row order.

    Each part becomes ``part=<n>/`` with one file, so a task holds one part at a time. The lines
    are shuffled once, to their parts. Returns the plan: row_idx, bytes, part.
    """
    usable = lines.where(F.col("line").isNotNull()).select("row_idx", "line")
    sizes = request_sizes(usable)
    index = part_index(sizes, cap, block_rows, fan_in)
    (with_part(usable, index, block_rows).repartition("part").sortWithinPartitions("part", "row_idx")
     .select("part", F.col("line").alias("value"))
     .write.mode("overwrite").partitionBy("part").option("lineSep", "\n").text(path))
    return with_part(sizes, index, block_rows)

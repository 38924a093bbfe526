"""Response files as they arrive, each processed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.sources.responses import parse_responses
from gradeloom.sources.store import ResultStore


def ingest_responses(
    spark: SparkSession,
    source: str,
    target: str | ResultStore,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Parse new response files into ``target``, a folder or a store, then stop.

    Progress is saved after every batch of files, so a restart continues where the last run
    ended. A batch that is repeated after a failure overwrites its own folder.
    """
    lines = (
        spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_batch)
        .text(source)
        .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_ord"),
                F.col("_metadata.file_block_start").alias("block"))
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        # Positions inside a file block exist only once the batch is a plain table.
        placed = batch.withColumn(
            "line_no", F.struct("block", F.monotonically_increasing_id().alias("pos")))
        answers = parse_responses(placed, ("file_ord", "line_no"))
        if isinstance(target, ResultStore):
            target.write(answers.select("row_idx", "uml_code", "file_ord", "line_no.*"), batch_id)
        else:
            answers.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        lines.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, target: str) -> DataFrame:
    """Everything ingested so far; ``batch_id`` gives the order of arrival."""
    return spark.read.parquet(target)

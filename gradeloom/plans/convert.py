"""Source rows to requests, and responses to a converted dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from gradeloom.constants import REQUEST_FILE_CAP
from gradeloom.operators.batches import batch_gate, build_request
from gradeloom.operators.chunks import chunk_sizes
from gradeloom.operators.joins import latest_response, merge_responses
from gradeloom.operators.reports import conversion_summary
from gradeloom.sources.responses import read_batch_responses
from gradeloom.sources.shards import read_shards, tag_split, with_row_index
from gradeloom.sources.sinks import write_request_chunks, write_results
from gradeloom.sources.store import ResultStore
from gradeloom.streaming.ingest import ingest_responses


def source_rows(spark: SparkSession, path: str, columns: Sequence[str], **reading) -> DataFrame:
    """Shards with their split and dense row ids."""
    return with_row_index(tag_split(read_shards(spark, path, columns, **reading)))


def submit_batch(
    spark: SparkSession, path: str, target: str, kind: str, model: str,
    cap: int = REQUEST_FILE_CAP, store: ResultStore | None = None, **reading,
) -> DataFrame:
    """Write the request files of a dataset; returns requests and megabytes per file.

    With a ``store`` only rows that have no answer there are asked for.
    """
    column = "sketch_image.bytes" if kind == "image" else "tikz_code"
    source = source_rows(spark, path, [column.split(".")[0]], **reading)
    source = store.pending(source) if store else source
    return chunk_sizes(write_request_chunks(
        build_request(source, column, kind, model), target, cap))


def resume_batch(
    spark: SparkSession, path: str, columns: Sequence[str], responses: str, checkpoint: str,
    store: ResultStore, target: str, **reading,
) -> DataFrame:
    """Add new response files to the store, write the dataset as far as it is answered, return its summary.

    May be called again whenever files have arrived in the folder ``responses``: each file is
    read once, later answers replace earlier ones, and only rows with an answer are written.
    """
    ingest_responses(spark, responses, store, checkpoint).awaitTermination()
    source = source_rows(spark, path, columns, **reading)
    answered = source.join(store.rows().select("row_idx"), "row_idx", "left_semi")
    write_results(merge_responses(answered, store.latest(), keys=source.columns), target, partition_by="split")
    return conversion_summary(spark.read.parquet(target))


def retrieve_batch(
    spark: SparkSession, path: str, columns: Sequence[str], manifest: DataFrame,
    responses: Sequence[str], target: str, validated: DataFrame | None = None, **reading,
) -> DataFrame:
    """Merge the response files into the dataset, write it and return its summary.

    Stops while a batch is unfinished. ``validated`` may hold (row_idx, errors); otherwise every
    answer is checked before it counts as valid.
    """
    if not batch_gate(manifest).first()["ready"]:
        raise RuntimeError("not all batches have completed; nothing was merged")
    source = source_rows(spark, path, columns, **reading)
    latest = latest_response(read_batch_responses(spark, responses))
    if validated is not None:
        latest = latest.join(validated, "row_idx", "left")
    merged = merge_responses(source, latest, keys=source.columns)
    write_results(merged, target, partition_by="split")
    return conversion_summary(spark.read.parquet(target))

"""Answers kept between runs, bucketed by row id, one folder per batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "row_idx long, uml_code string, file_ord string, block long, pos long"
ORDER = ("batch", "file_ord", "block", "pos")
BUCKETS = 64


class ResultStore:
    """Answers at a path that many runs add to.

    Every batch is a folder ``batch=<n>``, a delta that is written as a whole: a batch repeated
    after a failure replaces its own folder. Within each folder rows lie in ``buckets`` files by
    a hash of their row id, so one scan over all deltas is already partitioned by it: joining
    pending rows against the store moves the pending side only, and the latest answer of every
    row is found without a shuffle. ``buckets`` is fixed by the first run.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path
        self.table = "answers_" + hashlib.md5(path.encode()).hexdigest()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
        # The session's catalogue may be new: the files themselves carry their bucket and batch.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({COLUMNS}, batch long) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (row_idx) INTO {buckets} BUCKETS LOCATION '{path}'")
        self.buckets = buckets
        self.refresh()

    def refresh(self) -> None:
        """See the folders that other runs have written."""
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(self.table)

    def write(self, answers: DataFrame, batch: int) -> None:
        """Add (row_idx, uml_code, file_ord, block, pos) as one batch, instead of what the batch held."""
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        # Dealt as the buckets are, each task writes one file. Naming the partition leaves all others
        # alone. A streaming batch has a session of its own; the catalogue is one.
        answers.sparkSession.sql(
            f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = {int(batch)}) SELECT * FROM {{rows}}",
            rows=answers.select(*names).repartition(self.buckets, "row_idx"))
        self.refresh()

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def pending(self, todo: DataFrame) -> DataFrame:
        """Rows of ``todo`` without any answer, failed ones included."""
        return todo.join(self.rows().select("row_idx"), "row_idx", "left_anti")

    def latest(self) -> DataFrame:
        """(row_idx, uml_code): the last answer of each row, by batch, then by place in its files."""
        last = F.max_by(F.struct("uml_code"), F.struct(*ORDER))
        return self.rows().groupBy("row_idx").agg(last.alias("last")).select("row_idx", "last.uml_code")

"""Sharded Parquet input with stable row identity."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from fnmatch import fnmatchcase
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FILE_NAME = "_metadata.file_name"
# No file needs to have this column: for passes that list or count only.
NO_COLUMNS = T.StructType([T.StructField("none", T.BooleanType())])
# A shard is a file, or a folder of part files that is named like one: its name, and what follows it.
SHARD = r"([^/]+\.parquet)(?:(?:/[^/=]+=[^/]*)*/[^/]+)?$"
# So many paths, of up to a few hundred bytes each, stay below 100 MB.
BROADCAST_FILES = 200_000


def split_name(file_name: Column, sep: str = "-") -> Column:
    """The part of a file's base name before the first separator."""
    return F.split_part(file_name, F.lit(sep), F.lit(1))


def shard_name() -> Column:
    """The name of the file a row is read from, or of the folder if that is one shard in parts."""
    found = F.regexp_extract(F.col("_metadata.file_path"), SHARD, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.col(FILE_NAME))


def exclude_files(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Leave out files or shards by base name; Spark drops them while planning the scan."""
    names = list(names)
    return df.where(~F.col(FILE_NAME).isin(names) & ~shard_name().isin(names)) if names else df


def _files(df: DataFrame) -> list[str]:
    """Paths of all files of the scan, in the order of the row ids."""
    return sorted(unquote(f) for f in df.inputFiles())


def _in_parts(files: Iterable[str], paths: Sequence[str]) -> dict[str, list[str]]:
    """Folders that are one shard each, directly below one of ``paths``, with their files."""
    wanted = ["*/" + re.sub(r"^(\w+:(//[^/]*)?)?(\.?/)*", "", p).rstrip("/") for p in paths]
    shards: dict[str, list[str]] = {}
    for file in files:
        found = re.search(SHARD, file)
        if found and found.end(1) < len(file) and any(fnmatchcase(file[:found.start() - 1], w) for w in wanted):
            shards.setdefault(file[:found.end(1)], []).append(file)
    return shards


def read_shards(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
    exclude: Iterable[str] = (),
) -> DataFrame:
    """All Parquet shards under ``path``, only the listed columns read.

    A shard is a file, or a folder named like one that holds its part files. Files and shards named
    in ``exclude`` are no part of the table. File metadata stays available, so ``tag_split`` and
    ``with_row_index`` can follow.
    """
    paths = [path] if isinstance(path, str) else list(path)

    def read(*found: str, **options: str) -> DataFrame:
        reader = spark.read.option("pathGlobFilter", "*.parquet").options(**options)
        return (reader.schema(schema) if schema is not None else reader).parquet(*found)

    # The file lists are the scans' own; no data is read here.
    listing = spark.read.schema(NO_COLUMNS).option("pathGlobFilter", "*.parquet")
    files, left_out = _files(listing.parquet(*paths)), set(exclude)
    deeper = set(_files(listing.option("recursiveFileLookup", True).parquet(*paths))).difference(files)
    kept = [f for f in files if f.rsplit("/", 1)[-1] not in left_out]
    in_parts = {s: f for s, f in _in_parts(deeper, paths).items() if s.rsplit("/", 1)[-1] not in left_out}
    for shard, parts in in_parts.items():
        some = [f for f in parts if f.rsplit("/", 1)[-1] not in left_out]
        kept += [shard] if len(some) == len(parts) else some
    if not kept:
        raise FileNotFoundError(f"no parquet files under {', '.join(paths)}")
    if len(kept) == len(files) and not in_parts:
        df = read(*paths)
    else:
        # Columns named by folders are found relative to the folder that was asked for.
        folder = len(paths) == 1 and not re.search(r"[*?\[{]", path := paths[0])
        df = read(*sorted(kept), **({"basePath": path} if folder else {}))
    return df.select(*columns) if columns else df


def tag_split(df: DataFrame, sep: str = "-") -> DataFrame:
    return df.withColumn("split", split_name(shard_name(), sep))


def file_offsets(df: DataFrame) -> DataFrame:
    """(file, rows, offset) of every file ``df`` is read from, filters of ``df`` set aside.

    The row counts come from the files' footers: this pass reads no column. ``offset`` counts
    the rows of all files before, in path order.
    """
    files = _files(df)
    counts = df.sparkSession.read.schema(NO_COLUMNS).parquet(*files).groupBy(
        F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    # One row per file.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "rows", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))


def table_rows(df: DataFrame) -> int:
    """Rows of the files ``df`` is read from, filters of ``df`` set aside."""
    return file_offsets(df).agg(F.sum("rows")).first()[0] or 0


def with_row_index(df: DataFrame, out: str = "row_idx") -> DataFrame:
    """Dense 0-based row ids in (file path, position in file) order.

    The id is the row's position in its file plus the rows of all files before it. Only
    the table of per-file counts is ordered; the rows themselves are neither sorted nor
    shuffled, and the id does not depend on how the scan is partitioned. Rows filtered away
    before keep their numbers: a filtered table has the ids of the whole one.
    """
    n_files = len(df.inputFiles())
    if not n_files:
        # Planned without a scan, so it is known to be empty.
        return df.withColumn(out, F.lit(None).cast("long"))
    kept = df.columns
    offsets = file_offsets(df).select(F.col("file").alias("_file"), F.col("offset").alias("_offset"))
    # A path and two numbers per file. Estimates see the files' bytes, not their number.
    offsets = F.broadcast(offsets) if n_files <= BROADCAST_FILES else offsets
    return (
        df.select("*", F.col("_metadata.file_path").alias("_file"),
                  F.col("_metadata.row_index").alias("_pos"))
        .join(offsets, "_file")
        .select(*kept, (F.col("_offset") + F.col("_pos")).alias(out))
    )


def union_shards(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name of sources that cannot be read in one scan."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first

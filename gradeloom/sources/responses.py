"""Batch response files: one JSON object per line."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom import schemas
from gradeloom.functions.requests import parse_request_id
from gradeloom.functions.text import SPACE, strip_think
from gradeloom.sources.shards import BROADCAST_FILES


def response_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(line, file_ord, line_no): lines with their reading order.

    ``file_ord`` follows the order of ``paths``, each a file, a folder or a pattern; a file
    found by several belongs to the one that names most of its path. ``line_no`` orders the
    lines of one file: a file is cut into blocks, and inside a block the generated id grows with
    the position.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(paths)
    places = _places([unquote(_uri(spark, p)) for p in paths], sorted({_short(f) for f in read.inputFiles()}))
    order = spark.createDataFrame(places, "file string, listed int")
    if len(places) <= BROADCAST_FILES:
        order = F.broadcast(order)
    lines = read.select(
        F.col("value").alias("line"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("line_no"))
    return lines.join(order, "file").select("line", F.struct("listed", "file").alias("file_ord"), "line_no")


def _short(uri: str) -> str:
    return re.sub("^file:/+", "file:/", uri)


def _places(listed: list[str], files: list[str]) -> list[tuple[str, int]]:
    """(file, place in the list): of the entries a file lies at or below, the longest, then the first."""
    exact: dict[str, int] = {}
    patterns = []
    for i, entry in enumerate(listed):
        entry = entry.rstrip("/")
        if re.search(r"[*?\[{]", entry):
            patterns.append((_pattern(entry), i))
        else:
            exact.setdefault(entry, i)
    found = []
    for file in files:
        best, name = None, unquote(file)
        while name and best is None:
            best = exact.get(name)
            name = name.rpartition("/")[0] if best is None else name
        matched = [(m.end(), -i) for pattern, i in patterns if (m := pattern.match(unquote(file)))]
        if matched and (best is None or max(matched)[0] > len(name)):
            best = -max(matched)[1]
        if best is None:
            raise ValueError(f"{file} lies below none of the listed paths")
        found.append((file, best))
    return found


def _pattern(entry: str) -> re.Pattern:
    """A path pattern in Hadoop's notation, matching a file or a folder above it."""
    out = []
    for c in re.findall(r"\[[^\]]*\]|\\.|.", entry, re.S):
        if c[0] == "[" and len(c) > 1:
            out.append(c.replace("[!", "[^"))
        else:
            out.append({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if "{" in entry else ","}.get(c, re.escape(c)))
    return re.compile("".join(out) + "(?=/|$)")


def _uri(spark: SparkSession, path: str) -> str:
    """The path as file metadata shows it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    named = jvm.org.apache.hadoop.fs.Path(path)
    full = named.getFileSystem(conf).makeQualified(named).toUri().toString()
    return _short(full)


def parse_responses(lines: DataFrame, order: Sequence[str] = (), keep_unreadable: bool = False) -> DataFrame:
    """(row_idx, uml_code): cleaned text of successful responses, NULL for failed ones.

    Blank lines are skipped. ``order`` names columns to carry along. A line that is no response
    stops the job; with ``keep_unreadable`` it is kept in the column ``unreadable``.
    """
    parsed = lines.where(~F.col("line").rlike(rf"\A{SPACE}*\z")).select(
        "line", F.from_json("line", schemas.RESPONSE_LINE).alias("r"), *order)
    unreadable = F.col("r.custom_id").isNull()
    stop = F.raise_error(F.concat(F.lit("unreadable response line: "), F.left("line", F.lit(200)))).cast("long")
    row_idx = parse_request_id(F.col("r.custom_id"))
    content = F.get(F.col("r.response.body.choices"), F.lit(0))["message"]["content"]
    return parsed.select(
        (row_idx if keep_unreadable else F.when(unreadable, stop).otherwise(row_idx)).alias("row_idx"),
        F.when(F.col("r.response.status_code") == 200, strip_think(content)).alias("uml_code"),
        *order, *([F.when(unreadable, F.col("line")).alias("unreadable")] if keep_unreadable else []),
    )


def read_batch_responses(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(row_idx, uml_code, file_ord, line_no) of all response files."""
    return parse_responses(response_lines(spark, paths), ("file_ord", "line_no"))


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """(file, n_lines, n_unreadable, first_unreadable): what the lines of each response file hold.

    A line counts as unreadable where ``parse_responses`` would stop: it is no JSON object, or it
    names no request. Blank lines do not count. ``first_unreadable`` is the earliest such line,
    cut to 200 characters.
    """
    corrupt = T.StructType([*schemas.RESPONSE_LINE.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.where(~F.col("line").rlike(rf"\A{SPACE}*\z")).select(
        "line", F.col("file_ord.file").alias("file"), "line_no",
        F.from_json("line", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | F.col("r.custom_id").isNull()
    return parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(bad).alias("n_unreadable"),
        F.min_by(F.when(bad, F.left("line", F.lit(200))), F.when(bad, F.col("line_no"))).alias("first_unreadable"))

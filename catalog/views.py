"""Inputs for the operators, derived from the driver's tables (see FIXTURES.md)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.operators.joins import union_models
from gradeloom.sources.shards import read_shards

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` and ``labels`` as two shards of one directory, all other files left out."""
    schema = T.StructType([T.StructField("doc_id", T.LongType())])
    others = [f"{t}.parquet" for t in TABLES if t not in ("documents", "labels")]
    return read_shards(spark, sf_dir, schema=schema, exclude=others)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as converted rows: (row_idx, text, split, uml_valid, uml_error, llm_failed)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_idx"), "text", F.col("source").alias("split"),
        good.alias("uml_valid"),
        F.when(good, "").otherwise(F.concat(
            F.lit("quality "), F.coalesce("quality", F.lit(-1)).cast("string"))).alias("uml_error"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("llm_failed"))


FLAGS = ("uml_valid", "uml_error", "llm_failed")
# A table of one row group is one task. The benchmark deals the pairs out to this many; a table
# of many files needs no such step, and no query takes it.
DEALT: int | None = None


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(DEALT) if DEALT else rows


def base_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction: the next document's text."""
    rows = flagged(spark, sf_dir)
    following = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") - 1).alias("row_idx"), F.col("text").alias("uml_pred"))
    return _dealt(rows.join(following, "row_idx", "left").select(
        "row_idx", F.coalesce("uml_pred", F.lit("")).alias("uml_pred"),
        F.col("text").alias("uml_code_gt"), *FLAGS))


def finetuned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction: by row id the same code in other spacing, its first half, or nothing."""
    kind = F.col("row_idx") % 3
    half = F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    same = F.concat(F.lit("@startuml\n"), F.replace("text", F.lit(" "), F.lit("  ")),
                    F.lit("\n@enduml"))
    valid = F.col("uml_valid") | (kind == 0)
    return _dealt(flagged(spark, sf_dir).select(
        "row_idx", F.when(kind == 0, same).when(kind == 1, half).otherwise("").alias("uml_pred"),
        F.col("text").alias("uml_code_gt"), valid.alias("uml_valid"),
        F.when(valid, "").otherwise(F.col("uml_error")).alias("uml_error"), "llm_failed"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_models(base_pairs(spark, sf_dir), finetuned_pairs(spark, sf_dir))


def diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, code): documents as good and bad diagram code."""
    def wrapped(start, end):
        return F.concat(F.lit(start), F.col("text"), F.lit(end))
    kind = F.col("doc_id") % 6
    code = (
        F.when(kind == 0, F.col("text")).when(kind == 1, wrapped("@startuml ", ""))
        .when(kind == 2, wrapped("@startuml\n", "\n@enduml")).when(kind == 3, "@startuml @enduml")
        .when(kind == 4, "").otherwise(wrapped("@StartUML\n", "\n@EndUML"))
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"),
                                                    code.alias("code"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, messages): each conversation turn between a system turn and a closing one.

    Even turns have an image part first; the closing assistant turn has no text, so the
    extraction has to skip it.
    """
    def part(kind, text):
        return F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))

    def turn(role, parts):
        return F.struct(role.alias("role"), parts.alias("content"))

    text, image = part("text", F.col("text")), part("image", F.lit(None))
    parts = F.when(F.col("turn") % 2 == 0, F.array(image, text)).otherwise(F.array(text))
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"), "role", "text",
        F.array(turn(F.lit("system"), F.array(part("text", F.lit("fixed")))),
                turn(F.lit("assistant"), F.array(image)),
                turn(F.col("role"), parts)).alias("messages"))


def response_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, file_ord, line_no): response JSON per document, some missing, some repeated."""
    return _responses(table(spark, sf_dir, "documents").where(F.col("doc_id") % 11 != 0))


def response_files(spark: SparkSession, sf_dir: str, path: str) -> list[str]:
    """A response to every document in files of JSON lines, repeated ones in a second folder."""
    _responses(table(spark, sf_dir, "documents")).select(F.col("file_ord").alias("copy"), "line").write.partitionBy(
        "copy").option("lineSep", "\n").text(path)
    return [f"{path}/copy=0", f"{path}/copy=1"]


def _responses(docs: DataFrame) -> DataFrame:
    copies = F.when(F.col("doc_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    rows = docs.select("doc_id", "text", F.explode(copies).alias("copy"))
    content = F.concat(F.lit("<think>x\ny</think> "), F.col("text"),
                       F.when(F.col("copy") == 1, " again").otherwise(""))
    status = F.when((F.col("doc_id") + F.col("copy")) % 7 == 0, 500).otherwise(200)
    line = F.to_json(F.struct(
        F.concat(F.lit("req_"), "doc_id").alias("custom_id"),
        F.struct(status.alias("status_code"), F.struct(F.array(F.struct(
            F.struct(content.alias("content")).alias("message"))).alias("choices"))
            .alias("body")).alias("response")))
    return rows.select(line.alias("line"), F.col("copy").alias("file_ord"),
                       F.col("doc_id").alias("line_no"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per event, five batches to a job."""
    failed = F.col("event_type") == "error"
    lost = (F.col("event_type") == "signup") & (F.col("event_id") % 2 == 0)
    bad = F.col("event_id") % 3
    error = F.struct(F.col("event_type").alias("code"), F.col("props").alias("message"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.expr("event_id div 5").alias("job"),
        F.when(failed, "failed").otherwise("completed").alias("status"),
        F.when(~lost, F.concat(F.lit("file_"), "event_id")).alias("output_file_id"),
        F.lit(None).cast("string").alias("error_file_id"),
        F.struct(F.lit(10).cast("long").alias("total"), (10 - bad).alias("completed"),
                 bad.alias("failed")).alias("request_counts"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"),
        F.struct(F.when(failed, F.array(error)).alias("data")).alias("errors"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_idx, batch, input_ids): a small integer per word, in batches of four documents."""
    word_id = lambda w: (F.ascii(w) % 50 + F.length(w) * 50).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), F.expr("doc_id div 4").alias("batch"),
        F.transform(F.filter(F.split("text", " "), lambda w: w != ""), word_id).alias("input_ids"))


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _length_prefix(data: Column) -> Column:
    return F.unhex(F.lpad(F.hex(F.length(data).cast("long")), 8, "0"))


def _chunk(name: str, data: Column) -> Column:
    return F.concat(_length_prefix(data), _bytes(F.lit(name)), data, F.unhex(F.lit("00000000")))


def renders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured rendering responses built from events: rejections, pages, and PNG images with
    the event text in a text chunk or in the image data."""
    kind = F.col("event_id") % 7
    said = F.concat(F.lit(" "), F.col("event_type"), F.lit(" in "), F.col("props"), F.lit(" "))
    note = F.concat(_bytes(F.lit("plantuml")), F.unhex(F.lit("00")), _bytes(said))
    image = F.concat(_bytes(F.lit("rows ")), _bytes(F.initcap("event_type")), _bytes(F.col("props")))
    end = _chunk("IEND", F.unhex(F.lit("")))

    def png(*chunks):
        return F.concat(F.unhex(F.lit("89504E470D0A1A0A")), *chunks, end)

    body = F.when(kind <= 2, _bytes(F.lit("<html>"))).when(
        kind <= 4, png(_chunk("IHDR", F.unhex(F.lit("00" * 13))), _chunk("tEXt", note))
    ).otherwise(png(_chunk("IDAT", image)))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_idx"),
        F.when(kind == 0, 400).when(kind == 1, 503).otherwise(200).alias("http_code"),
        F.when(kind == 1, "Service Unavailable").otherwise("").alias("reason"),
        F.when(kind == 2, "text/html").otherwise("image/png").alias("content_type"),
        body.alias("body"))


def long_measures(rows: DataFrame) -> DataFrame:
    """(model, measure, value) from the result rows of both models."""
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("uml_pred")).alias("pred_chars"),
        F.sum(F.length("uml_code_gt")).alias("gt_chars"),
    ).unpivot("model", ["n", "pred_chars", "gt_chars"], "measure", "value")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not matter."""
    return reduce(
        lambda d, c: d.withColumn(c, F.round(c, digits)),
        [n for n, t in df.dtypes if t == "double"], df)

"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one beside the warehouse tables."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/llm/{context.applicationId}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    The copy cuts the lineage and outlives every executor. It stays until the folder of the
    application is deleted, since lazily evaluated results may still read it.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on ``keys`` where two nulls are equal; the keys of ``left`` stay."""
    names = {k: unused(left, f"_r_{k}") for k in keys}
    renamed = right.withColumnsRenamed(names)
    on: Column = F.lit(True)
    for k, name in names.items():
        on = on & left[k].eqNullSafe(renamed[name])
    return left.join(renamed, on, how).drop(*names.values())


def text_hash() -> Column:
    """A hash of ``text``, null counting as empty: with the doc_id it tells repeated ids apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))

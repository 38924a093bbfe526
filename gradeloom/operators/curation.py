"""From converted rows to training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import MAX_SEQUENCE_LENGTH
from gradeloom.functions.messages import training_messages
from gradeloom.functions.tokens import pad_ids, prompt_masked_labels
from gradeloom.operators.selection import values_at
from gradeloom.session import written

SPLIT_ORDER = ("train", "validation", "test")
# A key and a number each: below 100 MB.
BROADCAST_BATCHES = 1_000_000


def _valid(df: DataFrame) -> Column:
    # Comparisons with literals are what the Parquet reader can push down.
    keep = F.lit(True)
    if "uml_valid" in df.columns:
        keep = keep & (F.col("uml_valid") == F.lit(True))
    if "llm_failed" in df.columns:
        keep = keep & (F.col("llm_failed") == F.lit(False))
    return keep


def keep_valid(df: DataFrame) -> DataFrame:
    """Valid, not failed rows; a NULL flag drops the row, a missing column keeps all."""
    return df.where(_valid(df))


def kept_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(_valid(df)).alias("kept"), F.count(F.lit(1)).alias("initial"))


def assign_split(df: DataFrame, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """Keep an existing ``split``; otherwise 80/10/10 by a hash of the key.

    The hash makes the split independent of partitioning and stable when rows are added.
    """
    if "split" in df.columns:
        return df
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    slot = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long") % 10
    train, validation, test = SPLIT_ORDER
    return df.withColumn(
        "split", F.when(slot < 8, train).when(slot == 8, validation).otherwise(test))


def assign_exact_split(df: DataFrame, key: str = "row_idx", seed: int = 42) -> DataFrame:
    """Keep an existing ``split``; otherwise 80/10/10 with exact sizes, in random order of the key.

    A fifth of the rows, rounded up, is held out, and half of that, rounded up, is the test
    split. Rows are ordered by a hash of their key, then by the key, an integer; the two rows at
    which a split begins are selected by counting hashes, so nothing is sorted or shuffled but
    counters. Rows with one key stay together, even where that makes a split larger.
    """
    if "split" in df.columns:
        return df
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    order = F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")
    keyed = df.where(F.col(key).isNotNull()).select(order.alias("order"), F.col(key).cast("long").alias("key"))
    n = keyed.count()
    held_out = -(-n // 5)
    tested = -(-held_out // 2)
    edges = [rank for rank in (n - held_out, n - tested) if rank < n]
    ranked = values_at(keyed, "order", edges)
    split = F.lit(SPLIT_ORDER[2])
    for name, rank, found in reversed(list(zip(SPLIT_ORDER, edges, ranked))):
        # Two keys seldom share a hash: then the key decides.
        tied = keyed.where(F.col("order") == found.value)
        first = values_at(tied, "key", [rank - found.smaller])[0].value
        before = (order < found.value) | (order == found.value) & (F.col(key) < first)
        split = F.when(before, name).otherwise(split)
    return df.withColumn("split", F.when(F.col(key).isNotNull(), split))


def split_sizes(df: DataFrame) -> DataFrame:
    return df.where(F.col("split").isNotNull()).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"))


def pick_splits(names: list[str]) -> tuple[str, str | None]:
    """Training split (or else the first by name) and evaluation split, if any."""
    train = "train" if "train" in names else sorted(names)[0]
    held_out = [n for n in ("validation", "test") if n in names]
    return train, held_out[0] if held_out else None


def train_eval(df: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Training and evaluation rows; only the distinct split names reach the driver."""
    names = [r.split for r in split_sizes(df).select("split").toLocalIterator()]
    train, held_out = pick_splits(names)
    return (df.where(F.col("split") == train),
            None if held_out is None else df.where(F.col("split") == held_out))


def format_training_chat(df: DataFrame, **prompts) -> DataFrame:
    """(messages, image_bytes), plus ``split`` when there is one; other columns are dropped."""
    image = F.col("sketch_image.bytes") if "sketch_image" in df.columns else F.col("image_bytes")
    keep = ["split"] if "split" in df.columns else []
    return df.select(training_messages(F.col("uml_code"), **prompts).alias("messages"),
                     image.alias("image_bytes"), *keep)


def mask_prompt_labels(
    df: DataFrame,
    header: list[int],
    pad_id: int,
    max_len: int = MAX_SEQUENCE_LENGTH,
    batch: str | None = None,
) -> DataFrame:
    """Truncate, pad to the longest row of the batch, and add ``labels``.

    Only the batch widths are aggregated and written. Up to ``BROADCAST_BATCHES`` of them are
    broadcast, and the token arrays stay where they are; beyond that the arrays are shuffled once,
    but not sorted. Rows without a batch form one.
    """
    cut = df.withColumn("input_ids", F.slice("input_ids", 1, max_len))
    longest = F.max(F.least(F.size("input_ids"), F.lit(max_len))).alias("_width")
    if batch is None:
        sized = cut.withColumn("_width", df.agg(longest).scalar())
    else:
        widths = written(df.groupBy(F.col(batch).alias("_batch")).agg(longest))
        widths = F.broadcast(widths) if widths.count() <= BROADCAST_BATCHES else widths.hint("shuffle_hash")
        sized = cut.join(widths, cut[batch].eqNullSafe(widths["_batch"])).drop("_batch")
    padded = sized.withColumn(
        "input_ids", pad_ids(F.col("input_ids"), F.col("_width"), pad_id)).drop("_width")
    return padded.withColumn(
        "labels", prompt_masked_labels(F.col("input_ids"), header, pad_id))


def sample_rows(
    df: DataFrame, n: int = 5, key: str = "row_idx",
    hide: tuple[str, ...] = ("sketch_image", "image_bytes"), width: int = 120,
) -> DataFrame:
    """Preview of the first rows: no images, long text cut."""
    shown = df.drop(*hide)
    first = shown.orderBy(key).limit(n)
    return first.select([
        F.substring(c, 1, width).alias(c) if t == "string" else F.col(c) for c, t in shown.dtypes
    ])

"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-gram hashes the smallest is kept, so any two texts that share
``WINDOW + GRAM - 1`` = 13 words share a kept hash at the same place of that span. Kept hashes of
documents are joined with those of benchmark items, and each hit is extended to both sides over
the words that came along with it. An item of fewer than 13 words is matched whole, by a hash of
all its words that is looked up at every place of a document.

Before the join a bitmap of the benchmark's hashes, whose size is fixed, drops hashes that no
item has. It only saves work: what it lets through is joined and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import null_safe, stored, text_hash, unused
from gradeloom.llm.words import alnum_words, distinct_places, encoded, grams, rightmost_minima, word_hashes

SPAN, GRAM = 13, 7
WINDOW = SPAN - GRAM + 1
FILTER_BITS = 24
HITS = "m int, h long, q int, before int, context string"
MARKS = f"doc_id long, text_hash long, n_words long, {HITS}"


def _around(words: list[bytes], q: int, m: int) -> tuple[int, str]:
    """Words to compare at place ``q``: for a short item its own, else all that a span may reach."""
    low, high = (q, q + m) if m < SPAN else (max(0, q - SPAN + GRAM), q + SPAN)
    return q - low, b" ".join(words[low:high]).decode()


def _item_prints(words: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(length, hash, place) of what stands for one item."""
    hashes = word_hashes(words)
    if 0 < len(words) < SPAN:
        yield len(words), grams(hashes, len(words)).view(np.int64)[0], 0
    elif words:
        values = grams(hashes, GRAM)
        for q in distinct_places(rightmost_minima(values, WINDOW)):
            yield SPAN, values.view(np.int64)[q], int(q)


def _columns(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), t) for v, t in zip(values, types.values(), strict=True)], list(types))


_HIT_TYPES = {"m": pa.int32(), "h": pa.int64(), "q": pa.int32(), "before": pa.int32(), "context": pa.string()}


def item_prints(benchmark: DataFrame) -> DataFrame:
    """(item_id, m, h, q, before, context) of every item; item ids as strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), encoded(batch.column("text")), strict=True):
                words = alnum_words(text or b"")
                rows += [(item, m, h, q, *_around(words, q, m)) for m, h, q in _item_prints(words)]
            yield _columns(rows, {"item_id": pa.string()} | _HIT_TYPES)
    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, f"item_id string, {HITS}")


def _marks(docs: DataFrame, bits, short: list[int]) -> DataFrame:
    """Per document one row with its number of words, and a row for each hash the bitmap has."""
    types = {"doc_id": pa.int64(), "text_hash": pa.int64(), "n_words": pa.int64()} | _HIT_TYPES

    def known(values: np.ndarray) -> np.ndarray:
        at = values >> np.uint64(64 - FILTER_BITS)
        return (bits.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def places(hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for m in short:
            values = grams(hashes, m)
            yield m, values, np.flatnonzero(known(values))
        if len(hashes) >= SPAN:
            values = grams(hashes, GRAM)
            hit = known(values)
            if hit.any():
                kept = distinct_places(rightmost_minima(values, WINDOW))
                yield SPAN, values, kept[hit[kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            rows = []
            for doc, text_hash, text in zip(ids, hashes, encoded(batch.column("text")), strict=True):
                words = alnum_words(text or b"")
                rows.append((doc, text_hash, len(words), None, None, None, None, None))
                for m, values, found in places(word_hashes(words)):
                    for q in found.tolist():
                        rows.append((doc, text_hash, None, m, values[q].astype(np.int64), q,
                                     *_around(words, q, m)))
                        if len(rows) >= 20_000:
                            yield _columns(rows, types)
                            rows = []
            yield _columns(rows, types)

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text").mapInArrow(run, MARKS)


def _spans(hits: DataFrame) -> DataFrame:
    """(doc_id, text_hash, s, e, item_id): hits extended word by word, if long enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["m"] < SPAN:
                    if r["context"] == r["i_context"]:
                        rows.append((r["doc_id"], r["text_hash"], r["q"], r["q"] + r["m"], r["item_id"]))
                    continue
                a, b, i, j = r["context"].split(" "), r["i_context"].split(" "), r["before"], r["i_before"]
                low = 0
                while low < min(i, j) and a[i - low - 1] == b[j - low - 1]:
                    low += 1
                high = 0
                while high < min(len(a) - i, len(b) - j) and a[i + high] == b[j + high]:
                    high += 1
                if high >= GRAM and low + high >= SPAN:
                    rows.append((r["doc_id"], r["text_hash"], r["q"] - low, r["q"] + high, r["item_id"]))
            yield _columns(rows, {"doc_id": pa.int64(), "text_hash": pa.int64(), "s": pa.int32(),
                                  "e": pa.int32(), "item_id": pa.string()})
    return hits.mapInArrow(run, "doc_id long, text_hash long, s int, e int, item_id string")


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    ``docs`` has doc_id and text, ``benchmark`` has item_id and text, both perhaps more. A null or
    empty text has no words: such a document is clean, such an item never matches. Repeated rows
    are judged alike. Items of equal text each count; repeated item_ids count once; an item
    without an id marks words but is not listed. Empty tables give no rows or clean documents.
    """
    spark = docs.sparkSession
    items = stored(item_prints(benchmark))
    at = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    words = items.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int)))").alias("bits"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for word, value in words.toLocalIterator():
        bitmap[word] = np.uint64(value & (2**64 - 1))
    short = sorted(r.m for r in items.where(F.col("m") < SPAN).select("m").distinct().collect())
    marks = stored(_marks(docs, spark.sparkContext.broadcast(bitmap), short))
    found = marks.where(F.col("h").isNotNull()).drop("n_words").join(
        items.withColumnsRenamed({"q": "i_q", "before": "i_before", "context": "i_context"}), ["m", "h"])
    spans = _spans(found).distinct()
    keys = ["doc_id", "text_hash"]
    earlier = Window.partitionBy(*keys).orderBy("s", "e", "item_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("s"), F.coalesce(F.max("e").over(earlier), F.col("s")))
    hits = spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - reach)).groupBy(*keys).agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    base = marks.where(F.col("n_words").isNotNull()).select(*keys, "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return null_safe(base, hits, keys, "left").select(
        *keys, "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns kept."""
    name = unused(docs, "_text_hash")
    bad = judged(docs, benchmark).where("contaminated").select("doc_id", F.col("text_hash").alias(name)).distinct()
    return null_safe(docs.withColumn(name, text_hash()), bad, ["doc_id", name], "left_anti").drop(name)

"""Order MinHash fingerprints, and how they change when half of a text is replaced.

A sketch takes the ``PICK`` k-mers of a text with the smallest hashes, each k-mer numbered by its
occurrence so that repeats count, puts them back in text order, and hashes the tuple. Texts
within a small edit distance share many sketches, texts with the same k-mers in another order
do not. ``SKETCHES`` independent hashes make up the fingerprint; likeness is the share of equal
ones.

For the neighbour in descending doc_id order, documents are range-partitioned and streamed in
order; only the first and last document of each partition travel again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored
from gradeloom.llm.words import mix

KMER, PICK, SKETCHES = 8, 2, 32
_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_OCCURRENCE = np.uint64(0x9E3779B97F4A7C15)
_EACH = 1 << 14


def _kmers(points: np.ndarray) -> np.ndarray:
    """A hash per run of KMER code points, by doubling; the whole text if it is shorter."""
    h = mix(points.astype(np.uint64) + np.uint64(1))
    if len(h) < KMER:
        return mix(np.array([sum(int(x) * pow(31, i, 1 << 64) for i, x in enumerate(h)) % 2**64], np.uint64))
    size = 1
    while size < KMER:
        h = mix(h[:-size] * np.uint64(0xD1342543DE82EF95) + h[size:])
        size *= 2
    return h


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, its occurrence number in the text)."""
    n = len(h)
    place = np.arange(n, dtype=np.uint64)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((h >> bits << bits) | place)
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = (key[1:] >> bits) != (key[:-1] >> bits)
    index = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[at] = (index - np.maximum.accumulate(np.where(fresh, index, 0))).astype(np.uint64)
    return mix(h + occurrence * _OCCURRENCE)


def _below(h: np.ndarray, bound: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sketch, place, value) of all hashes up to ``bound``, by sketch, then value, then place."""
    found = []
    for low in range(0, len(h), _EACH):
        value = h[low:low + _EACH] * _SEEDS[:, None]
        sketch, place = np.nonzero(value <= bound)
        found.append((sketch, place + low, value[sketch, place]))
    sketch, place, value = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((place, value, sketch))
    return sketch[order], place[order], value[order]


def sketches(text: str) -> np.ndarray:
    """SKETCHES 32-bit tuple hashes; an empty text has zeros."""
    if not text:
        return np.zeros(SKETCHES, np.uint32)
    h = _numbered(_kmers(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")))
    n = len(h)
    pick = min(PICK, n)
    # Few hashes lie below the bound; where too few do in some sketch, it is raised.
    bound = 0
    sketch = place = np.empty(0, np.int64)
    share = 6 * PICK
    while bound < 2**64 - 1 and np.bincount(sketch, minlength=SKETCHES).min() < pick:
        bound = min(2**64 - 1, 2**64 // n * share)
        sketch, place, _ = _below(h, np.uint64(bound))
        share *= 2
    first = np.searchsorted(sketch, np.arange(SKETCHES))
    chosen = np.sort(place[first[:, None] + np.arange(pick)], axis=1)
    total = np.full(SKETCHES, pick, np.uint64)
    for i in range(pick):
        total = mix((total ^ h[chosen[:, i]]) * np.uint64(0xA0761D6478BD642F))
    return (total >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many first characters of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_EDGE = "part int, place int, text string"


def _result(doc: int | None, text: str, mine: np.ndarray, following: str, other: np.ndarray) -> tuple:
    new = edited(text, following)
    changed = mine if new == text else sketches(new)
    return (doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine),
            as_text(changed), likeness(mine, changed), likeness(mine, other))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in f"{_RESULT}, {_EDGE}".split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows but the last; the first (place 0) and last row (place 1) with their texts."""
    part, held = TaskContext.get().partitionId(), None
    rows: list[tuple] = []
    blank = (None,) * 6
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            mine = sketches(text)
            if held is None:
                rows.append((doc, *blank, part, 0, text))
            else:
                rows.append((*_result(*held, text, mine), None, None, None))
            held = doc, text, mine
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
    if held:
        rows.append((held[0], *blank, part, 1, held[1]))
    yield _batch(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            text, following = r["text"], r["following"]
            rows.append((*_result(r["doc_id"], text, sketches(text), following, sketches(following)), None, None, None))
        yield _batch(rows).select([x.split()[0] for x in _RESULT.split(", ")])


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    ``docs`` has doc_id and text, perhaps more. The next document is the one with the largest
    smaller doc_id; after the last comes the first. Rows with one doc_id follow each other by a
    hash of their texts; rows with a null doc_id come last; a single row follows itself. A null
    text is an empty one: its fingerprint is all zeros, and like only to another empty text's.
    An empty table gives no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("salt"))
    order = [F.desc_nulls_last("doc_id"), F.asc("salt")]
    work = stored(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(
        _stream, f"{_RESULT}, {_EDGE}"))
    # Two rows per partition: the window orders partitions, not documents.
    heads = work.where("place = 0").select("part", F.col("text").alias("following"))
    parts = heads.select("part")
    ordered = Window.orderBy("part")
    after = parts.select("part", F.coalesce(
        F.lead("part").over(ordered), F.min("part").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).alias("next"))
    tails = work.where("place = 1").select("doc_id", "part", "text").join(after, "part").join(
        heads.withColumnRenamed("part", "next"), "next")
    names = [x.split()[0] for x in _RESULT.split(", ")]
    return work.where("place IS NULL").select(*names).unionAll(
        tails.select("doc_id", "text", "following").mapInArrow(_joined, _RESULT))

"""Near-duplicates by SimHash: fingerprints within a few bits, found through covering-code anchors.

The 64 bits are cut into ``chunks`` parts. Of two fingerprints that differ in at most
``distance`` bits, one part differs in at most ``distance // chunks``. For each part the
anchors are a covering code: words whose first bits are a Hamming code (one word within one
bit of every value) and whose other bits are free, so the covering radius is 1. A fingerprint
has its home at the nearest anchor and is replicated to every anchor within the radius plus
the part's distance; then the home of one of the two is always among the anchors of the other.

The number of anchors is set by ``chunks``: three parts give about 5 * 10**5 anchors and 16
replicas a part; two parts give 2 * 10**8 anchors and about 200 replicas a part, for corpora of
more than some 10**8 different fingerprints. The links found are the same.

Copies share one fingerprint and take part once. Anchors with more homes than a fixed share of
all are split: the homes are dealt out, the replicas go to every part. A task compares homes
with replicas in blocks and passes on only a spanning forest of the links it found, so a large
group of near copies never becomes a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.components import component_roots, forest
from gradeloom.llm.shared import null_safe, stored, text_hash, unused
from gradeloom.llm.words import encoded, space_words

SHINGLE, DISTANCE, CHUNKS = 4, 4, 3
BITS, CODE_BITS, RADIUS, SEED = 64, 15, 1, 42
HOT_SHARE, HOT_LEAST = 10_000, 20_000
BLOCK = 1 << 21


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles of the lower-cased text."""
    words = space_words(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    k = min(shingle, len(words))
    spans = zip((end - length)[:len(words) - k + 1].tolist(), end[k - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; a null or empty text has fingerprint zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", shingle) for t in encoded(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(found, pa.int64())],
                ["doc_id", "text_hash", "fp"])
    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text").mapInArrow(
        run, "doc_id long, text_hash long, fp long")


def widths(chunks: int) -> list[int]:
    return [BITS // chunks + (i < BITS % chunks) for i in range(chunks)]


def _syndrome(low: np.ndarray) -> np.ndarray:
    """For the code bits: the position (from 1) of the bit to flip to reach a code word, or 0."""
    out = np.zeros(len(low), np.int64)
    for i in range(CODE_BITS):
        out ^= np.where((low >> i) & 1, i + 1, 0)
    return out


def _patterns(width: int, weight: int) -> list[np.ndarray]:
    """For each syndrome the bit patterns of at most ``weight`` that lead to an anchor."""
    masks = np.array([sum(1 << i for i in bits) for n in range(weight + 1)
                      for bits in combinations(range(width), n)], np.int64)
    at = _syndrome(masks & ((1 << CODE_BITS) - 1))
    return [masks[at == s] for s in range(CODE_BITS + 1)]


def placements(fps: np.ndarray, distance: int, chunks: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, fingerprint, home?) arrays; anchors carry the number of their part in front."""
    shift = 0
    patterns = {width: _patterns(width, RADIUS + distance // chunks) for width in set(widths(chunks))}
    for part, width in enumerate(widths(chunks)):
        value = (fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        shift += width
        syndrome = _syndrome(value & ((1 << CODE_BITS) - 1))
        tag = part << (width + 1)
        home = np.where(syndrome > 0, value ^ (1 << np.maximum(syndrome - 1, 0)), value)
        yield tag + home, fps, True
        for s, masks in enumerate(patterns[width]):
            at = np.flatnonzero(syndrome == s)
            yield tag + (value[at, None] ^ masks).ravel(), np.repeat(fps[at], len(masks)), False


def _links(home: np.ndarray, size: np.ndarray, start: np.ndarray, fps: np.ndarray, distance: int):
    """Linked pairs of each home with the ``size`` rows from ``start`` on, in blocks of pairs."""
    done = np.concatenate([[0], np.cumsum(size)])
    for low in range(0, int(done[-1]), BLOCK):
        pair = np.arange(low, min(low + BLOCK, int(done[-1])))
        own = np.searchsorted(done, pair, side="right") - 1
        a, b = home[own], fps[start[own] + pair - done[own]]
        near = (np.bitwise_count(a ^ b) <= distance) & (a != b)
        yield a[near], b[near]


def _compare(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Spanning forest of the links within the anchors of one partition, sorted by anchor."""
    u = v = np.empty(0, np.int64)
    limit = BLOCK
    key, homes = None, np.empty(0, np.int64)
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        part = batch.column("salt").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy()
        is_home = batch.column("home").to_numpy(zero_copy_only=False)
        edge = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(part) != 0)) + 1
        begin = np.concatenate([[0], edge]).astype(np.int64)
        if not len(anchor):
            continue
        end = np.concatenate([edge, [len(anchor)]]).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(is_home)])
        # Homes come first in their anchor, so a group that goes on over batches keeps its homes only.
        carried = homes if key == (anchor[0], part[0]) else np.empty(0, np.int64)
        group = np.repeat(np.arange(len(begin)), before[end] - before[begin])
        own = np.concatenate([carried, fps[is_home]])
        group = np.concatenate([np.zeros(len(carried), np.int64), group])
        first = begin + (before[end] - before[begin])
        for a, b in _links(own, (end - first)[group], first[group], fps, distance):
            u, v = np.concatenate([u, a]), np.concatenate([v, b])
            if len(u) > limit:
                u, v = forest(u, v)
                u, v = u[u != v], v[u != v]
                limit = max(BLOCK, 2 * len(u))
        key, homes = (anchor[-1], part[-1]), own[group == len(begin) - 1]
    u, v = forest(u, v)
    for i in range(0, len(u), BLOCK):
        yield pa.RecordBatch.from_arrays([pa.array(u[i:i + BLOCK]), pa.array(v[i:i + BLOCK])], ["u", "v"])


def links(distinct: DataFrame, distance: int = DISTANCE, chunks: int = CHUNKS) -> DataFrame:
    """(u, v) edges whose components are those of all links between different ``fp``."""
    if distance // chunks + RADIUS > CODE_BITS:
        raise ValueError("distance is too large for this number of chunks")

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, _, home in placements(batch.column("fp").to_numpy(), distance, chunks):
                if home:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor)], ["anchor"])

    counts = distinct.select("fp").mapInArrow(homes, "anchor long").groupBy("anchor").count()
    total = distinct.count() * chunks
    limit = max(HOT_LEAST, total // HOT_SHARE)
    # At most HOT_SHARE anchors can have more than that share of the homes.
    hot = {r.anchor: -(-r["count"] // limit) for r in counts.where(F.col("count") > limit).collect()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("fp").to_numpy()
            for i in range(0, len(rows), 1 << 16):
                for anchor, fps, home in placements(rows[i:i + (1 << 16)], distance, chunks):
                    salt = np.zeros(len(anchor), np.int32)
                    for name, parts in hot.items():
                        at = np.flatnonzero(anchor == name)
                        if home:
                            salt[at] = fps[at].view(np.uint64) % np.uint64(parts)
                            continue
                        for s in range(1, parts):
                            anchor, fps = np.append(anchor, anchor[at]), np.append(fps, fps[at])
                            salt = np.append(salt, np.full(len(at), s, np.int32))
                    for j in range(0, len(anchor), 1 << 16):
                        cut = slice(j, j + (1 << 16))
                        n = len(anchor[cut])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(anchor[cut]), pa.array(salt[cut]), pa.array(np.full(n, home)),
                             pa.array(fps[cut])], ["anchor", "salt", "home", "fp"])

    placed = distinct.select("fp").mapInArrow(place, "anchor long, salt int, home boolean, fp long")
    dealt = placed.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.desc("home"))
    return dealt.mapInArrow(lambda batches: _compare(batches, distance), "u long, v long")


def _groups(marked: DataFrame, distance: int, chunks: int) -> DataFrame:
    """(fp, root, component_id) of each different fingerprint."""
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = component_roots(links(distinct, distance, chunks))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(smallest, "root").select("fp", "root", "component_id")


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, chunks: int = CHUNKS
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text, any others).

    ``component_id`` is the smallest doc_id that links lead to. Rows with a null doc_id take
    part; a group of only such rows has a null component_id. A null or empty text has
    fingerprint zero and links like any other; repeated rows give repeated results; an empty
    table gives none. ``distance`` may be 0.
    """
    marked = stored(fingerprints(docs, shingle))
    return marked.join(_groups(marked, distance, chunks), "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, chunks: int = CHUNKS
) -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates.

    The row with the smallest doc_id stays; of several with that doc_id the one with the
    smallest text hash, and of equal rows any one. A group without a doc_id keeps one row, too.
    """
    marked = stored(fingerprints(docs, shingle))
    grouped = marked.join(_groups(marked, distance, chunks), "fp")
    order = F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_hash", "n")
    chosen = grouped.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).groupBy(
        "root").agg(F.min(order).alias("c")).select("c.doc_id", "c.text_hash", "c.n")
    name, size = unused(docs, "_text_hash"), unused(docs, "_n")
    keys = ["doc_id", name]
    chosen = stored(chosen.groupBy("doc_id", F.col("text_hash").alias(name)).agg(F.max("n").alias(size)))
    hashed = docs.withColumn(name, text_hash())
    kept = null_safe(hashed, chosen.where(F.col(size) == 1).drop(size), keys, "left_semi")
    repeated = chosen.where(F.col(size) > 1).drop(size)
    if not repeated.isEmpty():
        kept = kept.unionAll(null_safe(hashed, repeated, keys, "left_semi").dropDuplicates(keys))
    return kept.drop(name)

"""Packing request lines into size-capped parts, exactly as one sequential pass would.

Next-fit packing is sequential: a part closes when the next line would exceed the cap. All
that one stretch of rows needs to know about the rows before it is the number of bytes in
the open part, so a stretch is a function from *bytes carried in* to *(bytes carried out,
parts closed)*. That function is piecewise: either a constant or, where nothing closes, the
carried bytes plus the stretch's own. Functions of neighbouring stretches compose.

So: blocks of consecutive rows are summarised in parallel, summaries are composed
``fan_in`` at a time up to one, the carried bytes are handed back down, and every block then
lists the rows at which its parts start. Only (row_idx, bytes) travels, and no task holds more
than one block or ``fan_in`` summaries. Inside a block, where a part started at any row leads is
found for all rows at once by doubling the step: no Python runs per row.

The starts, one short list per block, are an index of intervals: a row finds its part by its
block, so rows of any width are never moved to be told their part.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.constants import REQUEST_FILE_CAP
from gradeloom.session import written

# The functions below travel to the executors whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 65_536
FAN_IN = 16

PIECES = "block long, low long, out long, grows boolean, closed long"
STATE = "block long, carry long, part long"
INDEX = "block long, part long, starts array<long>"
# Two numbers per block and one per part stay below 100 MB.
BROADCAST_ENTRIES = 4_000_000


def _after(sizes: np.ndarray, cap: int) -> np.ndarray:
    """For a part starting at each row: the row at which the next part starts."""
    total = np.cumsum(sizes)
    return np.maximum(np.searchsorted(total, total - sizes + cap, side="right"), np.arange(len(sizes)) + 1)


def _chain(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """For a part starting at each row: bytes left open at the end, parts closed."""
    after, rows = _after(sizes, cap), np.arange(len(sizes))
    last, closed = np.where(after < len(sizes), after, rows), (after < len(sizes)).astype(np.int64)
    # Each round doubles the number of parts a step passes over, until all steps end.
    while (further := last[last]).tolist() != last.tolist():
        closed = closed + closed[last]
        last = further
    total = np.cumsum(sizes)
    return np.minimum(total[-1] - (total - sizes)[last], cap), closed


def _starts(sizes: np.ndarray, first: int, cap: int) -> np.ndarray:
    """All rows at which parts start, when one starts at row ``first``."""
    n = len(sizes)
    jump = np.append(_after(sizes, cap), n)
    starts = np.array([first])
    while jump[first] < n:
        # ``starts`` holds the first parts, ``jump`` skips as many.
        found = jump[starts]
        starts, jump = np.append(starts, found[found < n]), jump[jump]
    return starts[starts < n]


def _compact(low, out, grows, closed):
    """Join neighbouring pieces that say the same."""
    new = np.ones(len(low), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (grows[1:] != grows[:-1]) | (closed[1:] != closed[:-1])
    return low[new], out[new], grows[new], closed[new]


def summarise(sizes: np.ndarray, cap: int):
    """Pieces (low, out, grows, closed) of one block over carried bytes 0..cap.

    Carried bytes above the cap behave like the cap. 0 means that no part is open, so the
    first row starts one without closing any.
    """
    total = np.cumsum(sizes)
    left, closed = _chain(sizes, cap)
    # The row at which the carried part closes; later rows belong to smaller carries.
    at = np.arange(min(int(np.searchsorted(total, cap)), len(sizes) - 1), -1, -1)
    low = np.maximum(cap - total[at] + 1, 1)
    pieces = [(np.array([0]), left[:1], np.array([False]), closed[:1])]
    if total[-1] < cap:
        pieces.append((np.array([1]), total[-1:], np.array([True]), np.array([0])))
    pieces.append((low, left[at], np.zeros(len(at), dtype=bool), closed[at] + 1))
    low, out, grows, closed = (np.concatenate(p) for p in zip(*pieces))
    # Rows that cannot close a part leave empty pieces behind: the last one at a bound holds.
    last = np.append(low[1:] != low[:-1], True)
    return _compact(low[last], out[last], grows[last], closed[last])


def follow(pieces, carry: np.ndarray, cap: int):
    """Bytes carried out and parts closed for each number of bytes carried in."""
    low, out, grows, closed = pieces
    at = np.searchsorted(low, carry, side="right") - 1
    return np.minimum(out[at] + np.where(grows[at], carry, 0), cap), closed[at]


def compose(first, second, cap: int):
    """Pieces of one stretch followed by another."""
    low, out, grows, closed = first
    ends = np.append(low[1:] - 1, cap)
    parts = []
    for i in range(len(low)):
        if not grows[i]:
            continue
        # Carried bytes pass through: cut this piece where the second function changes.
        shift = out[i]
        cuts = second[0] - shift
        cuts = np.append(low[i], cuts[(cuts > low[i]) & (cuts <= ends[i])])
        at = np.searchsorted(second[0], np.minimum(cuts + shift, cap), side="right") - 1
        through = second[2][at]
        parts.append((cuts, second[1][at] + np.where(through, shift, 0), through,
                      second[3][at] + closed[i]))
    fixed = ~grows
    value, more = follow(second, out[fixed], cap)
    parts.append((low[fixed], value, np.zeros(int(fixed.sum()), dtype=bool), closed[fixed] + more))
    joined = [np.concatenate(p) for p in zip(*parts)]
    order = np.argsort(joined[0], kind="stable")
    return _compact(*(p[order] for p in joined))


def starts(sizes: np.ndarray, carry: int, cap: int) -> np.ndarray:
    """The rows of a block at which parts start."""
    first = int(np.searchsorted(np.cumsum(sizes), cap - carry, side="right")) if carry else 0
    return _starts(sizes, first, cap)


def _rows(block: int, pieces) -> pd.DataFrame:
    low, out, grows, closed = pieces
    return pd.DataFrame({"block": np.int64(block), "low": low, "out": out,
                         "grows": grows, "closed": closed})


def _pieces(pdf: pd.DataFrame):
    pdf = pdf.sort_values("low")
    return tuple(pdf[c].to_numpy() for c in ("low", "out", "grows", "closed"))


def request_sizes(lines: DataFrame) -> DataFrame:
    """(row_idx, bytes) of (row_idx, line), written: two numbers per row. A line counts its newline."""
    return written(lines.select(F.col("row_idx").cast("long").alias("row_idx"),
                                (F.octet_length("line") + 1).cast("long").alias("bytes")))


def _block(block_rows: int) -> Column:
    return F.floor(F.col("row_idx") / block_rows).cast("long")


def part_index(
    sizes: DataFrame,
    cap: int = REQUEST_FILE_CAP,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(block, part, starts) for (row_idx, bytes): next-fit parts in row order, written.

    ``starts`` lists the rows of the block that start a part; ``part`` is the number of the part
    before the first of them. A row above the cap gets a part of its own.
    """
    sizes = sizes.withColumn("block", _block(block_rows))

    def leaf(key, pdf):
        return _rows(key[0], summarise(pdf.sort_values("row_idx")["bytes"].to_numpy(), cap))

    def merge(key, pdf):
        merged = None
        for _, child in pdf.groupby("block", sort=True):
            pieces = _pieces(child)
            merged = pieces if merged is None else compose(merged, pieces, cap)
        return _rows(key[0], merged)

    def hand_down(_, children, states):
        carry, part, rows = np.array([states["carry"][0]]), states["part"][0], []
        for block, child in children.groupby("block", sort=True):
            rows.append((block, carry[0], part))
            carry, closed = follow(_pieces(child), carry, cap)
            part += closed[0]
        return pd.DataFrame(rows, columns=["block", "carry", "part"])

    def list_starts(key, pdf, states):
        if pdf.empty or states.empty:
            return pd.DataFrame()
        pdf = pdf.sort_values("row_idx")
        carry, part = int(states["carry"][0]), int(states["part"][0])
        at = starts(pdf["bytes"].to_numpy(), carry, cap)
        # Where nothing is carried in, the first row itself starts the numbered part.
        return pd.DataFrame({"block": [key[0]], "part": [part if carry else part - 1],
                             "starts": [pdf["row_idx"].to_numpy()[at]]})

    # One row decides how many levels of composition there are.
    last = sizes.agg(F.max("block")).first()[0] or 0
    parent = F.floor(F.col("block") / fan_in).cast("long")
    levels, width = [], last + 1
    while width > 1:
        below = levels[-1].groupBy(parent.alias("parent")).applyInPandas(merge, PIECES) \
            if levels else sizes.groupBy("block").applyInPandas(leaf, PIECES)
        levels.append(below)
        width = -(-width // fan_in)

    state = sizes.sparkSession.range(1).selectExpr(
        "id AS block", "cast(0 AS long) AS carry", "cast(0 AS long) AS part")
    for level in reversed(levels):
        state = level.groupBy(parent.alias("parent")).cogroup(
            state.groupBy("block")).applyInPandas(hand_down, STATE)
    return written(sizes.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(list_starts, INDEX))


def with_part(rows: DataFrame, index: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``part`` to rows with ``row_idx``, from a ``part_index``.

    The index is broadcast when it is short enough; beyond that it is joined by block.
    """
    entries = index.agg(F.sum(F.size("starts") + 2)).first()[0] or 0
    if entries <= BROADCAST_ENTRIES:
        index = F.broadcast(index)
    started = F.size(F.filter("_starts", lambda s: s <= F.col("row_idx")))
    return rows.withColumn("_block", _block(block_rows)).join(
        index.select(F.col("block").alias("_block"), F.col("part").alias("_part"), F.col("starts").alias("_starts")),
        "_block").withColumn("part", F.col("_part") + started).drop("_block", "_part", "_starts")


def plan_request_chunks(
    lines: DataFrame,
    cap: int = REQUEST_FILE_CAP,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """(row_idx, bytes, part) for (row_idx, line): next-fit parts in row order."""
    sizes = request_sizes(lines)
    return with_part(sizes, part_index(sizes, cap, block_rows, fan_in), block_rows)


def chunk_sizes(plan: DataFrame) -> DataFrame:
    """Requests and megabytes per part."""
    return plan.groupBy("part").agg(
        F.count(F.lit(1)).alias("n_requests"),
        (F.sum("bytes") / (1024 * 1024)).alias("size_mb"))

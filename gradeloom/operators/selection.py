"""Values at given ranks of a column, found digit by digit instead of by sorting."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions for the executors travel whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGIT_BITS, WORD_BITS = 16, 64


@dataclass(frozen=True)
class Ranked:
    """A value, and how many rows of the column are smaller than it."""

    value: int
    smaller: int


def values_at(df: DataFrame, column: str, ranks: Sequence[int]) -> list[Ranked]:
    """The values of a column of longs without NULLs at 0-based ``ranks`` in ascending order.

    Each of the four passes counts the rows by their next 16 bits, among those that agree with a
    wanted value so far, and follows the digit in which the rank falls. A pass moves at most
    2**16 counters per task and wanted prefix, whatever the number of rows and of equal values.
    """
    found = {rank: (0, 0) for rank in ranks}
    for shift in range(WORD_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
        rows = df
        if shift < WORD_BITS - DIGIT_BITS:
            rows = df.where(F.shiftright(column, shift + DIGIT_BITS).isin(sorted({p for p, _ in found.values()})))
        counted = rows.groupBy(F.shiftright(column, shift).alias("prefix")).agg(
            F.count(F.lit(1)).alias("n")).orderBy("prefix").collect()
        prefix, n = (np.array([r[i] for r in counted], np.int64) for i in (0, 1))
        upto = np.cumsum(n)
        for rank, (above, smaller) in found.items():
            # Rows with a smaller prefix so far are counted already; other wanted prefixes are not this one's.
            first = int(np.searchsorted(prefix >> DIGIT_BITS, above)) if rows is not df else 0
            before = int(upto[first - 1]) if first else 0
            at = int(np.searchsorted(upto, before + rank - smaller, side="right"))
            if at >= len(prefix):
                raise ValueError(f"rank {rank} is beyond the last row")
            found[rank] = int(prefix[at]), smaller + (int(upto[at]) - int(n[at]) - before)
    return [Ranked(*found[rank]) for rank in ranks]


def _ordered(values: pa.Array) -> pa.Array:
    bits = (np.asarray(values.to_numpy(zero_copy_only=False), np.float64) + 0.0).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits), mask=values.is_null().to_numpy(zero_copy_only=False))


def ordered_bits(value: Column) -> Column:
    """A long for each double, in the same order; both zeros are one."""
    return F.arrow_udf(_ordered, T.LongType())(value)


def from_ordered_bits(bits: int) -> float:
    return float(np.array([bits if bits >= 0 else bits ^ (2**63 - 1)], np.int64).view(np.float64)[0])


def median_value(df: DataFrame, value: str) -> float | None:
    """The exact median of a column of doubles, NULLs left out; None if nothing is left."""
    keyed = df.where(F.col(value).isNotNull()).select(ordered_bits(F.col(value)).alias("bits"))
    n = df.agg(F.count(value)).first()[0]
    if not n:
        return None
    low, high = (from_ordered_bits(r.value) for r in values_at(keyed, "bits", ((n - 1) // 2, n // 2)))
    return (low + high) / 2

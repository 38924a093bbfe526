"""Training labels over token id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.constants import IGNORED_LABEL
from gradeloom.functions.arrays import let


def response_start(ids: Column, header: list[int]) -> Column:
    """First position after the first occurrence of ``header``; 0 when it is absent."""
    n = len(header)
    if n == 0:
        return F.lit(0)
    wanted = F.array(*[F.lit(h) for h in header])
    found = F.filter(
        F.transform(ids, lambda x, i: F.when(
            (x == header[0]) & (F.slice(ids, i + 1, F.lit(n)) == wanted), i)),
        lambda i: i.isNotNull(),
    )
    return F.coalesce(F.get(found, F.lit(0)) + n, F.lit(0))


def pad_ids(ids: Column, width: Column, pad_id: int) -> Column:
    """``ids`` padded on the right to ``width``."""
    missing = F.greatest(width - F.size(ids), F.lit(0)).cast("int")
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def prompt_masked_labels(ids: Column, header: list[int], pad_id: int) -> Column:
    """Labels with padding and everything before the response ignored."""
    return let(response_start(ids, header), lambda start: F.transform(
        ids, lambda x, i: F.when((i < start) | (x == pad_id), IGNORED_LABEL).otherwise(x)))

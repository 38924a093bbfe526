"""Small building blocks over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times inside ``body``.

    A plain reuse of the expression inside a lambda would be evaluated per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, shorter: Column, n: int) -> Column:
    """The n-grams of ``tokens``, given its (n-1)-grams; empty when there are fewer tokens."""
    keep = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    return F.transform(
        F.slice(shorter, F.lit(1), keep),
        lambda gram, i: F.concat(gram, F.lit(" "), F.get(tokens, i + (n - 1))),
    )


# The marks sort before every character a token can hold, so the occurrences of one value
# stay adjacent after sorting, those of the left side first.
_LEFT, _RIGHT = "\t0", "\t1"


def _marked(left: Column, right: Column) -> Column:
    return F.sort_array(F.concat(
        F.transform(left, lambda v: F.concat(v, F.lit(_LEFT))),
        F.transform(right, lambda v: F.concat(v, F.lit(_RIGHT))),
    ))


def _sorted_shared_count(left: Column, right: Column) -> Column:
    # One pass over the sorted occurrences. ``prefix`` is the current value with its tab, so
    # an occurrence belongs to it when it starts with it.
    def state(prefix, n_left, n_right, shared):
        return F.struct(prefix.alias("prefix"), n_left.alias("n_left"),
                        n_right.alias("n_right"), shared.alias("shared"))

    def step(acc, item):
        prefix, n_left, n_right, shared = (
            acc[c] for c in ("prefix", "n_left", "n_right", "shared"))
        same = F.startswith(item, prefix)
        covered = (n_right < n_left) & same
        return (
            F.when(F.endswith(item, F.lit(_RIGHT)),
                   F.when(covered, state(prefix, n_left, n_right + 1, shared + 1)).otherwise(acc))
            .when(same, state(prefix, n_left + 1, n_right, shared))
            .otherwise(state(F.substr(item, F.lit(1), F.length(item) - 1), F.lit(1), F.lit(0),
                             shared))
        )

    start = state(F.lit("\t"), F.lit(0), F.lit(0), F.lit(0))
    return F.aggregate(_marked(left, right), start, step)["shared"]


def shared_count(left: Column, right: Column, mostly_distinct: bool = False) -> Column:
    """Size of the multiset intersection of two arrays of strings without tabs.

    Stays inside the row: at most one sort and one pass, no shuffle. With
    ``mostly_distinct`` the hash-based array functions are tried first: when one side has no
    repeats, the set intersection already is the answer.
    """
    if not mostly_distinct:
        return _sorted_shared_count(left, right)

    def no_repeats(values):
        return F.size(F.array_distinct(values)) == F.size(values)

    return let(F.size(F.array_intersect(left, right)), lambda common: (
        F.when((common == 0) | no_repeats(left) | no_repeats(right), common)
        .otherwise(_sorted_shared_count(left, right))))


def paired_bag(left: Column, right: Column) -> Column:
    """``array<struct<term, on_right, n, n_left>>``: every distinct string of each side.

    ``n`` is its count on that side. An entry of the right side also carries ``n_left``, the
    count on the left side, so that products need no join; it is 0 elsewhere.
    """
    def entries(items):
        # The first position of every (value, side) run.
        firsts = F.filter(
            F.transform(items, lambda v, i: F.when(v == F.get(items, i - 1), None).otherwise(i)),
            lambda i: i.isNotNull(),
        )

        def entry(pos):
            def build(at, j):
                item, before = F.get(items, at), F.get(pos, j - 1)
                on_right = F.endswith(item, F.lit(_RIGHT))
                value = F.substr(item, F.lit(1), F.length(item) - 2)
                pair = F.concat(value, F.lit(_LEFT)) == F.get(items, before)
                return F.struct(
                    value.alias("term"), on_right.alias("on_right"),
                    (F.coalesce(F.get(pos, j + 1), F.size(items)) - at).alias("n"),
                    F.when(on_right & pair, at - before).otherwise(0).alias("n_left"),
                )
            return F.transform(pos, build)

        return let(firsts, entry)

    return let(_marked(left, right), entries)

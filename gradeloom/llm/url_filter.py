"""Exact URL filters from a cascade of Bloom filters.

The first level encodes the listed keys. Tested against the whole universe of keys it lets some
others pass; the second level encodes those, the third the listed keys that the second lets
pass, and so on until none is left. A key of the universe is judged by the first level that does
not have it: nothing but the filters is needed, no list and no join.

A level is an array of longs. Lists too long for filters of ``PIECE_BITS`` bits are cut by a hash
of the key into pieces, each with a cascade of its own and a pass over its part of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored

BITS_PER_KEY, HASHES, PIECE_BITS = 8, 4, 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    # Without the low bits, so that the sums stay within a long.
    first, step = (F.shiftrightunsigned(F.xxhash64(F.lit(2 * level + i), key), 8) for i in (0, 1))
    return [F.pmod(first + F.lit(i) * step, F.lit(bits)) for i in range(HASHES)]


class Level:
    """One filter: its words in a small table, read as one value by every query that tests it."""

    def __init__(self, keys: DataFrame, count: int, number: int):
        self.number, self.bits = number, max(1, -(-count * BITS_PER_KEY // 64)) * 64
        at = keys.select(F.explode(F.array(*_places(F.col("key"), number, self.bits))).alias("at")).select(
            F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits"))
        # Every word once, also those without a bit.
        blank = keys.sparkSession.range(self.bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        words = at.unionAll(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        self.table = stored(words.agg(F.transform(
            F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words")))

    def has(self, key: Column) -> Column:
        words = self.table.scalar()
        found = F.lit(True)
        for at in _places(key, self.number, self.bits):
            word = F.get(words, F.shiftright(at, 6).cast("int"))
            found = found & (F.getbit(word, at.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return found


def cascade(keys: DataFrame) -> list[Level]:
    """Levels for ``keys`` (key, listed), which hold every key of the universe once."""
    inside, outside = (keys.where(c).select("key") for c in (F.col("listed"), ~F.col("listed")))
    levels: list[Level] = []
    while count := inside.count():
        levels.append(Level(inside, count, len(levels)))
        inside, outside = stored(outside.where(levels[-1].has(F.col("key")))), inside
    return levels


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(~level.has(key), F.lit(level.number % 2 == 1)).otherwise(answer)
    return answer


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. ``rules`` are a few literals."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def judged(pages: DataFrame, listed: DataFrame, rules: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url, any others).

    ``listed`` (host) are the hosts to block; repeated, null and unknown ones change nothing. The
    longest fitting rule (host, path prefix, verdict) overrides the list. A url that is null or has
    no ``://`` has an empty host and path, which no rule with a host fits. Repeated rows are judged
    alike; an empty table gives no rows, an empty list blocks nothing.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    names = listed.where("host IS NOT NULL").select(F.col("host").alias("key"), F.lit(True).alias("listed"))
    keys = stored(rows.select(F.col("host").alias("key"), F.lit(False).alias("listed")).unionAll(names).groupBy("key").agg(
        F.max("listed").alias("listed")))
    pieces = max(1, -(-keys.where("listed").count() * BITS_PER_KEY // PIECE_BITS))
    piece = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(pieces))
    rules, judged_pieces = list(rules), []
    for i in range(pieces):
        levels = cascade(keys.where(piece(F.col("key")) == i))
        own = rows.where(piece(F.col("host")) == i) if pieces > 1 else rows
        blocked = F.when(member(levels, F.col("host")), "block").otherwise("allow")
        judged_pieces.append(own.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select(
            "page_id", "host", "path", F.col("_r.rule").alias("rule"),
            F.coalesce(F.col("_r.verdict"), blocked).alias("verdict")))
    out = judged_pieces[0]
    for more in judged_pieces[1:]:
        out = out.unionAll(more)
    return out

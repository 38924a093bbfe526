"""Fill-in-the-middle: cut a text into prefix, middle and suffix at unit borders, and reorder them.

The characters of many texts, one after another, are mapped to classes, and a wavelet matrix is
built over the classes. The number of units that end before a position is the sum of the ranks
of the classes that end a unit, so the matrix answers for every text how many units it has and,
by bisection on those ranks, where a unit ends. Both cuts of all texts are located together; no
list of units is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEWLINE, SPACE, STOP, MARK, DIGIT, UPPER, LOWER, OTHER = range(8)
CLASS_BITS = 3
# A unit ends after each character of these classes, and at the end of the text.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, SPACE), "sentence": (NEWLINE, STOP), "char": tuple(range(8))}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_CHARS = 1 << 22


def _class_of(c: str) -> int:
    if c == "\n":
        return NEWLINE
    if c.isspace():
        return SPACE
    if c in ".!?":
        return STOP
    if c.isdigit():
        return DIGIT
    if c.isalpha():
        return UPPER if c.isupper() else LOWER if c.islower() else OTHER
    return MARK if ord(c) < 0x80 else OTHER


# White space ends with U+3000; characters beyond the table are of the class OTHER.
_CLASSES = np.array([_class_of(chr(i)) for i in range(0x3001)] + [OTHER], np.uint8)


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASSES[np.minimum(points, len(_CLASSES) - 1)]


class _Bits:
    """Bits with a directory of the ones before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones among the first ``at`` bits."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of symbols of ``bits`` bits."""

    def __init__(self, symbols: np.ndarray, bits: int = CLASS_BITS):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            one = (symbols >> k & 1).astype(bool)
            self.levels.append(_Bits(one))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` symbols."""
        begin, end = np.zeros(1, np.int64), at
        for k, level in enumerate(self.levels):
            a, b = level.ones(begin), level.ones(end)
            if symbol >> (len(self.levels) - 1 - k) & 1:
                begin, end = level.zeros + a, level.zeros + b
            else:
                begin, end = begin - a, end - b
        return end - begin

    def borders(self, ends: Sequence[int], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are one of ``ends``."""
        return sum((self.rank(e, at) for e in ends), np.zeros(len(at), np.int64))

    def locate(self, ends: Sequence[int], low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The smallest position from ``low`` to ``high`` with ``wanted`` borders before it; ``high`` if there is none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.borders(ends, middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def unit_cuts(texts: Sequence[str], draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the places of its two cuts in code points.

    Of the two ``draws`` per text, each modulo the number of units plus one, the smaller number
    of units is the prefix, and the larger one ends the middle.
    """
    ends = UNITS[unit]
    matrix = WaveletMatrix(classes("".join(texts)))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stop = np.cumsum(sizes)
    start = stop - sizes
    before, whole = matrix.borders(ends, start), matrix.borders(ends, stop)
    open_end = (sizes > 0) & (matrix.borders(ends, np.maximum(stop - 1, start)) == whole)
    n = whole - before + open_end
    units = np.sort(draws % (n + 1)[:, None].astype(np.uint64), axis=1).astype(np.int64)
    cuts = [matrix.locate(ends, start, stop, before + units[:, k]) - start for k in (0, 1)]
    return n, np.stack(cuts, axis=1)


def _draws(seed: int, doc: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def _rows(docs: list[int | None], texts: list[str], unit: str, seed: int, rate: int, spm: int) -> Iterator[tuple]:
    draws = np.array([_draws(seed, d) for d in docs], np.uint64)
    n, cuts = unit_cuts(texts, draws[:, :2], unit)
    for i, text in enumerate(texts):
        if not text or draws[i, 2] % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
            yield docs[i], int(n[i]), "plain", None, None, text
            continue
        a, b = cuts[i].tolist()
        if draws[i, 3] % 100 < spm:
            form, output = "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
        else:
            form, output = "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
        yield docs[i], int(n[i]), form, a, b - a, output


def transformed(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    ``docs`` has doc_id and text, perhaps more. ``rate`` per cent of the rows are reordered, of
    those ``spm`` per cent with the suffix first; the draws depend on ``seed`` and doc_id only,
    so rows with one doc_id draw alike, and a null doc_id draws as an empty number. A null text
    counts as an empty one. Empty texts, and texts that hold a marker, stay plain: their two
    lengths are null. An empty table gives no rows. Rows stay where they are read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [c.split()[0] for c in RESULT.split(", ")]

        def done(ids: list, texts: list[str]) -> pa.RecordBatch:
            columns = zip(*_rows(ids, texts, unit, seed, rate, spm), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            ids: list = []
            texts: list[str] = []
            size = 0
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
                text = (value.as_py() or b"").decode("utf-8", "replace")
                if texts and size + len(text) > _CHARS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(text)
                size += len(text)
            if texts:
                yield done(ids, texts)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text, from an output and its form; each marker stands in an output once."""
    out = F.col(output)
    between = lambda a, b: F.substring_index(F.substring_index(out, b, 1), a, -1)
    middle = F.substring_index(out, MIDDLE, -1)
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
            .otherwise(out))

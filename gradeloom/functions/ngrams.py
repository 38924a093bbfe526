"""Sentence BLEU over batches of texts, with n-grams as packed numbers.

The words of a batch are numbered, and what a word is cut into is found once per distinct word.
A row and two tokens are packed into one long, and two such pairs, numbered again, into another
for the longer n-grams. Both sides of a row share the numbers, so sorted runs give both counts of
every n-gram. No n-gram is ever written out as a string.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# The functions below travel to the executors whole, which need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_ORDER = 4
# The published 13a tokenisation, in order. Its first rule also lists the
# blank, which is left out: the blanks it adds around a blank vanish when splitting.
TOKEN_ENTITIES = (("<skipped>", ""), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
TOKEN_RULES = (
    (r"([\{-\~\[-\`!-\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
# The term of "<empty>", which stands for an empty text.
EMPTY_TERM = "empty"
# Rows are taken together up to so many bytes; a longer text is taken alone.
_BYTES = 1 << 23


# Tokens whose n-grams are sorted together: their keys stay in the processor's cache.
_SORTED = 1 << 17


class Coded:
    """The words of both texts of each row as numbers into ``values``, those of ``pred`` first."""

    def __init__(self, n: int, codes: np.ndarray, row: np.ndarray, n_pred: int, values: pa.Array):
        self.n, self.codes, self.row, self.n_pred, self.values = n, codes, row, n_pred, values

    @classmethod
    def split(cls, pred: pa.Array, ref: pa.Array) -> Coded:
        """Blanks separate words."""
        split = pc.split_pattern(pa.concat_arrays([pred, ref]), " ")
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        side = np.repeat(np.arange(2 * len(pred)), pc.list_value_length(split).to_numpy())
        empty = pc.index(words.dictionary, "").as_py()
        if empty >= 0:
            kept = codes != empty
            codes, side = codes[kept], side[kept]
        n_pred = int(np.searchsorted(side, len(pred)))
        side[n_pred:] -= len(pred)
        return cls(len(pred), codes, side, n_pred, words.dictionary)

    def replaced(self, function: Callable[[pa.Array], pa.Array], shortest: int = 1) -> Coded:
        """Each word replaced by the pieces, parted by blanks, that ``function`` makes of it."""
        split = pc.split_pattern(function(self.values), " ")
        flat, word = split.flatten(), pc.list_parent_indices(split)
        kept = pc.greater_equal(pc.utf8_length(flat), shortest)
        flat, word = flat.filter(kept).dictionary_encode(), word.filter(kept).to_numpy()
        size, number = np.bincount(word, minlength=len(self.values)), flat.indices.to_numpy().astype(np.int64)
        times, first = size[self.codes], (np.cumsum(size) - size)[self.codes]
        # The n-th piece of a word lies n places after its first.
        ends = np.cumsum(times)
        places = np.repeat(first - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
        n_pred = int(ends[self.n_pred - 1]) if self.n_pred else 0
        return Coded(self.n, number[places], np.repeat(self.row, times), n_pred, flat.dictionary)

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.bincount(self.row[:self.n_pred], minlength=self.n), np.bincount(self.row[self.n_pred:], minlength=self.n))

    def parts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of whole rows: the first row, and row from there, number and side of each word."""
        n_values = max(1, len(self.values))
        most = max(1, 2 ** 62 // n_values ** 2)
        total = np.cumsum(np.add(*self.lengths()))
        start = 0
        while start < self.n:
            before = total[start - 1] if start else 0
            stop = min(start + most, max(start + 1, int(np.searchsorted(total, before + _SORTED, side="right"))))
            cuts = [slice(*(offset + np.searchsorted(rows, (start, stop)))) for offset, rows in
                    ((0, self.row[:self.n_pred]), (self.n_pred, self.row[self.n_pred:]))]
            row, codes = (np.concatenate([x[c] for c in cuts]) for x in (self.row, self.codes))
            on_ref = np.arange(len(row)) >= cuts[0].stop - cuts[0].start
            yield start, row - start, codes, on_ref
            start = stop

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, number, and times on either side of every distinct word of each row, by row and number."""
        found = [(first + keys // max(1, len(self.values)), keys % max(1, len(self.values)), left, right)
                 for first, row, codes, on_ref in self.parts()
                 for keys, left, right in [_counted(row * len(self.values) + codes, on_ref)]]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 4


def _counted(keys: np.ndarray, on_ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct keys, and how often each is on the left and on the right."""
    both = np.sort(keys * 2 + on_ref)
    ordered = both >> 1
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(both)), bool), ordered[1:] != ordered[:-1]]))
    n = np.diff(np.append(starts, len(both)))
    right = np.add.reduceat(both & 1, starts) if len(starts) else starts
    return ordered[starts], n - right, right


def _shared(coded: Coded) -> np.ndarray:
    """Per order and row the n-grams both sides share, with repeats."""
    shared, n_values = np.zeros((MAX_ORDER, coded.n), np.int64), max(1, len(coded.values))
    for first, row, token, on_ref in coded.parts():
        n = int(row.max()) + 1 if len(row) else 0

        def add(order: int, rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            both = np.minimum(left, right)
            shared[order, first:first + n] = np.bincount(rows, weights=both, minlength=n)
            return both

        keys = row * n_values + token
        grams, left, right = _counted(keys, on_ref)
        both = add(0, grams // n_values, left, right)
        # What stands on one side only is in no longer shared gram.
        useful = _among(keys, grams[both > 0])
        at = np.flatnonzero(useful[1:] & useful[:-1] & (row[1:] == row[:-1]) & (on_ref[1:] == on_ref[:-1]))
        # A row, its two tokens: the number of a pair stands for all three.
        coded_pairs = pa.array(keys[at] * n_values + token[at + 1]).dictionary_encode()
        pair, pairs = coded_pairs.indices.to_numpy().astype(np.int64), coded_pairs.dictionary.to_numpy()
        n_pairs = max(1, len(pairs))
        left, right = (np.bincount(pair[on_ref[at] == side], minlength=len(pairs)) for side in (False, True))
        pair_row = pairs // n_values // n_values
        both = add(1, pair_row, left, right)
        kept = both[pair] > 0
        number = np.full(len(row) + MAX_ORDER, -1, np.int64)
        number[at[kept]] = pair[kept]
        # Pairs that overlap or touch are in one text: a pair never crosses its end.
        for order in (2, 3):
            here = np.flatnonzero(number[:len(row)] >= 0)
            here = here[(number[here + 1] >= 0) & (number[here + order - 1] >= 0)]
            grams, left, right = _counted(number[here] * n_pairs + number[here + order - 1], on_ref[here])
            add(order, pair_row[grams // n_pairs], left, right)
    return shared


def _among(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each key is one of the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def matches(pred: pa.Array, ref: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of both sides, and per row and order the n-grams they share with repeats."""
    coded = Coded.split(pred, ref)
    return *coded.lengths(), _shared(coded)


def sentence_bleu(pred: pa.Array, ref: pa.Array) -> np.ndarray:
    """BLEU in 0-1 of each row: orders 1-4, effective order, exponential smoothing."""
    return _bleu(*matches(pred, ref))


def _bleu(n_pred: np.ndarray, n_ref: np.ndarray, shared: np.ndarray) -> np.ndarray:
    total = np.maximum(n_pred - np.arange(MAX_ORDER)[:, None], 0)
    counts = total > 0
    # Every order without a match halves what it counts for once more.
    misses = np.cumsum(counts & (shared == 0), axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        precision = np.where(shared > 0, shared / total, 1.0 / (2.0 ** misses * total))
        logs = np.where(counts, np.log(precision), 0.0).sum(axis=0) / np.minimum(n_pred, MAX_ORDER)
        brevity = np.where(n_pred < n_ref, np.exp(1.0 - n_ref / n_pred), 1.0)
        return np.where(shared.sum(axis=0) > 0, brevity * np.exp(logs), 0.0)


def _filled(*texts: pa.Array) -> list[pa.Array]:
    return [pc.fill_null(x, "").cast(pa.large_string()) for x in texts]


def _slices(pred: pa.Array, ref: pa.Array) -> Iterator[slice]:
    sizes = pc.add(pc.binary_length(pred), pc.binary_length(ref)).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // _BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(edges, edges[1:]) if b > a)


def bleu_of_batch(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """BLEU of tokenised texts; a NULL text has no tokens."""
    pred, ref = _filled(pred, ref)
    parts = [sentence_bleu(pred[s], ref[s]) for s in _slices(pred, ref)]
    return pa.array(np.concatenate(parts) if parts else np.empty(0))


def _changed(words: pa.Array, where: str, change: Callable[[pa.Array], pa.Array]) -> pa.Array:
    there = pc.match_substring_regex(words, where)
    return pc.replace_with_mask(words, there, change(words.filter(there)))


def _tokens_of(words: pa.Array) -> pa.Array:
    """The tokens of each word. No rule looks across a blank further than to the blank itself."""
    def cut(text: pa.Array) -> pa.Array:
        for entity, char in TOKEN_ENTITIES:
            text = pc.replace_substring(text, entity, char)
        text = pc.replace_substring_regex(text, r"^(.*)$", r" \1 ")
        for rule, by in TOKEN_RULES:
            text = pc.replace_substring_regex(text, rule, by.replace("$", "\\"))
        return text
    return _changed(words, r"[!-/:-@\[-`{-~]", cut)


def _terms_of(words: pa.Array) -> pa.Array:
    """The runs of letters, digits and underscores of each word."""
    other = r"[^\p{L}\p{N}_]+"
    return _changed(words, other, lambda text: pc.replace_substring_regex(text, other, " "))


def bleu_of_texts(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """BLEU of normalised texts, cut into tokens of the 13a scheme word by word."""
    pred, ref = _filled(pred, ref)
    parts = [np.empty(0)]
    for s in _slices(pred, ref):
        coded = Coded.split(pred[s], ref[s]).replaced(_tokens_of)
        parts.append(_bleu(*coded.lengths(), _shared(coded)))
    return pa.array(np.concatenate(parts))


def _term_lists(words: Coded, pred: pa.Array, ref: pa.Array) -> pa.Array:
    terms = words.replaced(_terms_of, shortest=2)
    row, number, left, right = terms.counts()
    names = terms.values
    # The empty text has a stand-in, which stands in the other texts as itself.
    empty = [pc.equal(x, "").to_numpy(zero_copy_only=False).astype(np.int64) for x in (pred, ref)]
    blank = np.flatnonzero(empty[0] | empty[1])
    if len(blank):
        names = pa.concat_arrays([names, pa.array([EMPTY_TERM], names.type)])
        row, number, left, right = (np.concatenate(x) for x in (
            (row, blank), (number, np.full(len(blank), len(names) - 1)), (left, empty[0][blank]), (right, empty[1][blank])))
        place = pc.index(terms.values, EMPTY_TERM).as_py()
        if place >= 0:
            number = np.where(number == len(names) - 1, place, number)
        keys, back = np.unique(row * len(names) + number, return_inverse=True)
        row, number = keys // len(names), keys % len(names)
        left, right = (np.bincount(back, weights=x).astype(np.int64) for x in (left, right))
    ends = np.searchsorted(row, np.arange(words.n + 1))
    entries = pa.StructArray.from_arrays(
        [names.take(pa.array(number)).cast(pa.string()), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
        ["term", "n_left", "n_right"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries)


def measures_of_texts(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """BLEU, the counts of distinct words and the terms of both sides of normalised texts."""
    pred, ref = _filled(pred, ref)
    parts = [_measured(pred[s], ref[s]) for s in _slices(pred, ref)]
    return pa.concat_arrays(parts) if parts else _measured(pred, ref)


def _measured(pred: pa.Array, ref: pa.Array) -> pa.Array:
    words = Coded.split(pred, ref)
    tokens = words.replaced(_tokens_of)
    row, _, left, right = words.counts()
    counts = [np.bincount(row[there], minlength=words.n).astype(np.int32) for there in ((left > 0) & (right > 0), left > 0, right > 0)]
    return pa.StructArray.from_arrays(
        [pa.array(_bleu(*tokens.lengths(), _shared(tokens))), *map(pa.array, counts), _term_lists(words, pred, ref)],
        ["bleu", "shared", "n_pred", "n_ref", "terms"])


def terms_of_texts(pred: pa.Array, ref: pa.Array) -> pa.Array:
    """The distinct terms of both sides of normalised texts, and how often each side has them."""
    pred, ref = _filled(pred, ref)
    parts = [_term_lists(Coded.split(pred[s], ref[s]), pred[s], ref[s]) for s in _slices(pred, ref)]
    return pa.concat_arrays(parts) if parts else _term_lists(Coded.split(pred, ref), pred, ref)


def term_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) per batch of term lists: in how many texts, two a row, each term is."""
    for batch in batches:
        entries = batch.column(0).flatten()
        terms = pc.struct_field(entries, "term").dictionary_encode()
        sides = sum((pc.struct_field(entries, c).to_numpy(zero_copy_only=False) > 0).astype(np.int64) for c in ("n_left", "n_right"))
        uses = np.bincount(terms.indices.to_numpy(), weights=sides, minlength=len(terms.dictionary)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([terms.dictionary, pa.array(uses)], ["term", "n"])

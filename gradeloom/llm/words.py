"""Words of whole texts as bytes, and vectorised hashes of words and word sequences.

Everything here works on one document or a bounded group of them, so a task holds its texts and arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_SLICE = 1 << 18
_PLACE = 24
_WORD_BYTES = bytes(
    ord(chr(i).lower()) if 0x41 <= i <= 0x5A
    else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20
    for i in range(256))

_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))

_powers = {base: np.ones(1, np.uint64) for base in (_BASE, _INVERSE)}

# Words of up to CHUNKS eights of bytes are hashed by eights, longer ones by xxHash.
_CHUNKS = 4
_LENGTH = np.uint64(0x9FB21C651E98DF25)
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def alnum_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters and digits and of all characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words between blanks and the control characters tab to carriage return, unchanged."""
    return text.split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word: a polynomial of its bytes taken from prefix sums, then mixed."""
    if not words:
        return np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    out = np.empty(len(words), np.uint64)
    first = 0
    while first < len(words):
        base = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, base + _SLICE, side="right")))
        data = np.frombuffer(b"".join(words[first:last]), np.uint8).astype(np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * _power(_BASE, len(data)), out=total[1:])
        end = ends[first:last] - base
        start = end - lengths[first:last]
        value = (total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]
        out[first:last] = mix(value + lengths[first:last].astype(np.uint64))
        first = last
    return out


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash per run of ``k`` consecutive words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = out * _GRAM + hashes[j:j + n]
    return mix(out + np.uint64(k))


def rightmost_minima(values: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` values the position of its smallest, the rightmost of equal ones.

    Values count by their top 40 bits. The low bits hold the position, counted from the end, so
    that minima of numbers, taken by doubling, carry their position along.
    """
    n = len(values) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    if len(values) >= 1 << _PLACE:
        half = len(values) // 2
        return np.concatenate([rightmost_minima(values[:half + window - 1], window),
                               rightmost_minima(values[half:], window) + half])
    least = (values >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(values), 0, -1, dtype=np.uint64)
    size = 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        least = np.minimum(least[:n], least[window - size:window - size + n])
    return len(values) - (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)


def distinct_places(places: np.ndarray) -> np.ndarray:
    """Positions from ``rightmost_minima``, which never fall, once each."""
    fresh = np.ones(len(places), bool)
    fresh[1:] = places[1:] != places[:-1]
    return places[fresh]


def hashes_of(text: bytes, strong: bool = False) -> np.ndarray:
    """The hashes of all ``space_words``, found in the bytes without cutting them out.

    They equal ``word_hashes``; ``strong`` ones are those of ``joined_hashes``.
    """
    if strong:
        return joined_hashes([text])[0]
    found = []
    begin = 0
    while begin < len(text):
        end = begin + _SLICE
        if end < len(text):
            # Slices end with a word.
            data = np.frombuffer(text, np.uint8, len(text) - end, end)
            for low in range(0, len(data), _SLICE):
                blank = np.flatnonzero(_BLANK[data[low:low + _SLICE]])
                if len(blank):
                    end += low + int(blank[0])
                    break
            else:
                end = len(text)
        data = np.frombuffer(text, np.uint8, min(end, len(text)) - begin, begin)
        inside = np.zeros(len(data) + 2, bool)
        np.logical_not(_BLANK[data], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, stop = edge[::2], edge[1::2]
        total = np.zeros(len(data) + 1, np.uint64)
        data = data.astype(np.uint64) + np.uint64(1)
        np.cumsum(data * _power(_BASE, len(data)), out=total[1:])
        value = (total[stop] - total[start]) * _power(_INVERSE, len(data) + 1)[start]
        found.append(mix(value + (stop - start).astype(np.uint64)))
        begin = end
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def word_edges(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, where their ``space_words`` start and stop in that, and the first word of each text.

    The first words have one entry more, the number of words. Eight bytes may be read at each byte
    of a word.
    """
    joined = b" " + b" ".join(texts) + b" " * 8
    data = np.frombuffer(joined, np.uint8)
    blank = (data == 32) | (data - np.uint8(9) < 5)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return joined, start, stop, np.concatenate([[0], np.searchsorted(start, ends)])


def joined_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all ``space_words`` of the texts, and the first word of each text, as ``word_edges``.

    A word is taken by eights of its bytes, each joined to the hash of those before and mixed, so
    that words of up to 32 bytes do not collide by the way they are built; longer ones go through
    xxHash. Every step is done for the words of all texts at once.
    """
    joined, start, stop, first = word_edges(texts)
    length = stop - start
    # Unaligned numbers of eight bytes, one at each byte.
    eights = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))
    out = mix((eights[start] & _LOW_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * _LENGTH)
    rest = np.flatnonzero(length > 8)
    for at in range(8, 8 * _CHUNKS, 8):
        rest = rest[length[rest] > at]
        if not len(rest):
            return out, first
        part = eights[start[rest] + at] & _LOW_BYTES[np.minimum(length[rest] - at, 8)]
        out[rest] = mix(out[rest] * _GRAM + part)
    for i in rest[length[rest] > 8 * _CHUNKS].tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[start[i]:stop[i]])
    return out, first


def encoded(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, one at a time; a null stays None."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()

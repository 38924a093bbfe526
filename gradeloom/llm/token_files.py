"""Token ids in Huffman-coded blocks.

The file is a Parquet table of blocks in document order. A block holds whole documents (at least
one, up to about ``BLOCK_TOKENS`` tokens) and is decoded alone: it carries its documents' ids and
lengths, the coded bits, and the bit offset of every ``STEP``-th token. Next to the blocks stand
the code lengths of all ids, from which the canonical code follows, and the number of tokens
before each partition. Lengths are limited to ``MAX_BITS`` by package-merge, so one table of
2**MAX_BITS entries decodes a code in one look.
"""

from __future__ import annotations

import gc
import json
import os
import re
import string
import sys
import types
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradeloom.llm.shared import stored, work_dir

END_ID = 2
MAX_BITS, STEP, BLOCK_TOKENS = 16, 256, 1 << 18
COLUMN_BYTES = 1 << 22
WORDS, PIECES = 100_000, 50_000
# The pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = np.array([i < 128 and chr(i).isspace() for i in range(256)], np.uint8)
# Bytes that white space beyond ASCII starts with, all of it in the basic plane.
_SPACE_LEADS = np.isin(np.arange(256), [chr(i).encode()[0] for i in range(128, 0xd800) if chr(i).isspace()])
# Marks a word that follows a line's end; texts with this character are left to the tokenizer.
LINE = "\x01"
_LETTERS = string.ascii_letters + "".join(c for c in map(chr, range(0xa1, 0x250)) if c.isalpha())
# Without the character 0, which parts pieces.
_PLAIN = re.compile(r"[\x01-\x7f\u00a1-\u024f]*")

# The last block of a partition has the partition's distinct ids, followed by how often each stands there.
RAW = "part int, block int, first long, doc_ids binary, lengths binary, n_tokens long, ids binary, counts binary"
BLOCKS = "part int, block int, first long, doc_ids binary, lengths binary, n_tokens long, bits binary, marks binary"


class _Tables:
    """Ids of at most ``2 * WORDS`` words, as Arrow columns, and of pieces.

    Words that were not met since the last time the table was full make room, so rare ones do not
    push out frequent ones. A word that stands once in its column of texts is not kept.
    """

    def __init__(self):
        self.words = pa.array([], pa.large_string())
        self.ids = _lists([])
        self.met = np.zeros(0, bool)
        self.pieces: dict[str, bytes] = {}

    def places(self, words: pa.LargeStringArray, times: np.ndarray) -> np.ndarray:
        """Where the table has each word, -1 if nowhere; those that come again count as met."""
        at = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy().copy()
        self.met[at[(at >= 0) & (times > 1)]] = True
        return at

    def keep(self, words: pa.LargeStringArray, ids: pa.ListArray) -> None:
        """Add words that the table does not have."""
        if len(self.words) + len(words) > 2 * WORDS:
            left = pa.array(np.flatnonzero(self.met)[-WORDS:])
            self.words, self.ids = self.words.take(left), self.ids.take(left)
            self.met = np.zeros(len(left), bool)
            words, ids = words[:WORDS], ids[:WORDS]
        self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        self.met = np.append(self.met, np.ones(len(words), bool))


def _joined(words: pa.LargeStringArray) -> str:
    """All words, each followed by the character 0."""
    if not len(words):
        return ""
    row = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(row, pa.scalar("\0", pa.large_string()))[0].as_py() + "\0"


def _lists(ids: list[bytes]) -> pa.ListArray:
    """Lists of the ids that stand in each value."""
    bounds = np.zeros(len(ids) + 1, np.int32)
    np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)) >> 2, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(ids), np.uint32)))


class Encoder:
    """Token ids of texts, with the ids of words seen before kept in a bounded table.

    Byte-level BPE splits a text by a fixed pattern and encodes the pieces alone. The pattern
    always splits before a blank between two other characters that are not white space, and around
    a single line's end between such characters, so the words between them are encoded alone as
    well, and new ones piece by piece: once per column of texts, whose distinct words Arrow finds.
    Texts with other white space around blanks, where pieces do not split at every blank, with a
    special token or the mark of a line's end, words with characters on whose kind libraries may
    differ, and other kinds of tokenizers are left to the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        about = json.loads(self.tokenizer.to_str())
        model, before = about["model"], about["pre_tokenizer"] or {}
        self.by_piece = (
            model["type"] == "BPE" and not model.get("dropout") and before.get("type") == "ByteLevel"
            and before.get("use_regex") and not before.get("add_prefix_space") and about["normalizer"] is None)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.letters = np.zeros(256, "<u2")
        self.letters[plain], self.letters[rest] = plain, 256 + np.arange(len(rest))
        self.letters[0] = ord(" ")
        self.tables, self.merge = _Tables(), self.tokenizer.model.tokenize
        self.pattern = regex.compile(PATTERN)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def merged(self, pieces: str) -> pa.ListArray:
        """Ids of pieces, written in the model's letters. Each ends with the character 0, which no piece has."""
        letters = self.letters[np.frombuffer(pieces.encode(), np.uint8)].tobytes().decode("utf-16-le")
        flat, sizes = array("I"), array("i", [0])
        for piece in letters.split(" ")[:-1]:
            flat.extend([t.id for t in self.merge(piece)])
            sizes.append(len(flat))
        return pa.ListArray.from_arrays(
            pa.array(np.frombuffer(sizes, np.int32)), pa.array(np.frombuffer(flat, np.uint32)))

    def new_words(self, words: pa.LargeStringArray) -> pa.ListArray:
        """Ids of a blank, or a line's end, and each word. Words of letters and marks after them are two pieces each."""
        core = pc.ascii_rtrim(words, characters=string.punctuation)
        rest = pc.utf8_ltrim(words, characters=LINE + _LETTERS)
        two = pc.and_(pc.equal(pc.ascii_ltrim(rest, characters=string.punctuation), ""),
                      pc.greater(pc.binary_length(pc.ascii_ltrim(core, characters=LINE)), 0))
        others = words.filter(pc.invert(two)).to_pylist()
        core = core.filter(two).dictionary_encode()
        marks = rest.filter(two).dictionary_encode()
        names = core.dictionary
        begins = pc.invert(pc.starts_with(names, LINE)).to_numpy(zero_copy_only=False).astype(np.int64)
        # A blank before each name, except where a mark stands.
        blanks = ("\0" + _joined(names)).replace("\0", "\0 ").replace(" " + LINE, "")[1:-1]
        entries = pa.concat_arrays([
            self.merged("\n\0"), _lists([b""]), self.merged(blanks), self.merged(_joined(marks.dictionary))])
        at = core.indices.to_numpy()
        parts = np.stack([begins[at], 2 + at, 2 + len(names) + marks.indices.to_numpy()], axis=1)
        both = entries.take(pa.array(parts.ravel()))
        both = pa.ListArray.from_arrays(pa.array(both.offsets.to_numpy()[::3]), both.values)
        two = two.to_numpy(zero_copy_only=False)
        order = np.where(two, np.cumsum(two) - 1, len(at) + np.cumsum(~two) - 1)
        return pa.concat_arrays([both, _lists(self.other_words(others))]).take(pa.array(order))

    def other_words(self, words: list[str]) -> list[bytes]:
        """Ids of a blank, or a line's end, and each word, whatever its characters."""
        words = ["\n" + w[1:] if w[:1] == LINE else " " + w for w in words]
        split = [self.pattern.findall(w) if _PLAIN.fullmatch(w) else None for w in words]
        known = self.tables.pieces
        found = {p: known.get(p) for pieces in split if pieces for p in pieces}
        new = [p for p, ids in found.items() if ids is None]
        merged = self.merged("".join(p + "\0" for p in new)).to_pylist()
        found.update((p, np.array(ids, np.uint32).tobytes()) for p, ids in zip(new, merged, strict=True))
        # Pieces without a blank are few and come again; those with one are words.
        known.update((p, found[p]) for p in new if p[0] != " ")
        if len(known) > PIECES:
            known.clear()
        return [self.whole(w).tobytes() if pieces is None else b"".join(map(found.__getitem__, pieces))
                for w, pieces in zip(words, split, strict=True)]

    def __call__(self, text: str) -> np.ndarray:
        return self.column(pa.array([text]))[0]

    def column(self, texts: pa.StringArray) -> list[np.ndarray]:
        """Ids of each text. Every distinct word is looked up once for all of them."""
        texts = pc.fill_null(texts, "")
        if not self.by_piece:
            return [self.whole(t) for t in texts.to_pylist()]
        # A column makes many small objects and no cycles, so looking for cycles only costs time.
        gc.disable()
        try:
            return self._by_words(texts)
        finally:
            gc.enable()

    def _by_words(self, texts: pa.StringArray) -> list[np.ndarray]:
        # A line's end between two plain characters is a piece; the word behind it is marked.
        split = pc.split_pattern(pc.replace_substring_regex(texts, "([!-~])\n([!-~])", rf"\1 {LINE}\2"), " ")
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at = coded.indices.to_numpy().copy()
        starts, lasts = ends[:-1], ends[1:] - 1
        first = coded.dictionary.take(pa.array(at[starts])).to_pylist()
        words = coded.dictionary.cast(pa.large_string())
        left = self._loose(words, at, starts, lasts)
        for special in [*self.special, LINE]:
            left |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        # A text's first word has no blank before it, so its ids are an entry of their own. In texts
        # left to the tokenizer that entry holds all ids, and the other words none.
        none = len(words)
        at[np.repeat(left, np.diff(ends))] = none
        at[starts] = none + 1 + np.arange(len(texts), dtype=np.int32)
        times = np.bincount(at, minlength=none)[:none]
        known = self.tables.ids
        place = self.tables.places(words, times)
        # Ids of each word that stands somewhere; new ones that come again are kept.
        new = np.flatnonzero((place < 0) & (times > 0))
        names = words.take(pa.array(new))
        ids = self.new_words(names)
        place[new] = len(known) + np.arange(len(new))
        again = pa.array(np.flatnonzero(times[new] > 1))
        self.tables.keep(names.take(again), ids.take(again))
        whole = [b""] + [
            self.whole(texts[i].as_py() if loose else first[i]).tobytes() for i, loose in enumerate(left.tolist())]
        entries = pa.concat_arrays([known, ids, _lists(whole)])
        place = np.append(place, np.arange(len(entries) - len(whole), len(entries), dtype=np.int32))
        taken = entries.take(pa.array(place[at]))
        values, cuts = taken.flatten().to_numpy(), taken.offsets.to_numpy()[ends]
        return np.split(values, cuts[1:-1])

    @staticmethod
    def _loose(words: pa.LargeStringArray, at: np.ndarray, starts: np.ndarray, lasts: np.ndarray) -> np.ndarray:
        """Which texts have a blank next to other white space, by their words' ends."""
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        flags = np.full(len(words), 4, np.uint8)
        some = np.flatnonzero(ends[1:] > ends[:-1])
        low, high = data[ends[some]], data[ends[some + 1] - 1]
        flags[some] = _SPACE[low] | _SPACE[high] << 1
        # Characters that may be white space beyond ASCII, of two or three bytes, are looked at one by one.
        last = ends[some + 1]
        wide = some[_SPACE_LEADS[low] | (high > 127) & (
            _SPACE_LEADS[data[np.maximum(last - 2, 0)]] | _SPACE_LEADS[data[np.maximum(last - 3, 0)]])]
        for i, w in zip(wide.tolist(), words.take(pa.array(wide)).to_pylist(), strict=True):
            flags[i] = w[0].isspace() | w[-1].isspace() << 1
        if not flags.any():
            return np.zeros(len(starts), bool)
        found = flags[at]
        found[starts] &= 2
        found[lasts] &= 1
        return np.bitwise_or.reduceat(found, starts) > 0


def kept_encoder(path: str) -> Encoder:
    """An encoder that stays in the worker process, with its tables, for the next tasks.

    Reading the tokenizer takes as long as encoding 2 MB. Tasks that encode nothing any more let it go.
    """
    holder = sys.modules.setdefault("_token_encoders", types.ModuleType("_token_encoders"))
    if path not in holder.__dict__:
        holder.__dict__[path] = Encoder(path)
    return holder.__dict__[path]


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ascending doc_id order over the partitions.

    Rows with one doc_id are ordered by a hash of the text and may be in several partitions.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("salt"))
    return keyed.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt").select("doc_id", "text")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``COLUMN_BYTES`` of text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
    start = done = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + COLUMN_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start, done = stop, int(ends[stop - 1])


def raw_blocks(
    docs: DataFrame, encoder: Callable[[], Callable[[pa.StringArray], list[np.ndarray]]], end_id: int
) -> DataFrame:
    """Blocks with plain ids. A null doc_id, which sorts first, is written as the smallest long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, encode = TaskContext.get().partitionId(), encoder()
        squeeze = zstandard.ZstdCompressor(level=1)
        block, first, ids, docs_in = 0, 0, [], []
        counts = np.zeros(0, np.int64)

        def close(last: bool = False) -> pa.RecordBatch:
            nonlocal counts
            tokens = np.concatenate(ids)
            found = np.bincount(tokens)
            if len(found) > len(counts):
                counts = np.append(counts, np.zeros(len(found) - len(counts), np.int64))
            counts[:len(found)] += found
            seen = np.flatnonzero(counts) if last else None
            row = [part, block, first, np.array(docs_in, "<i8").tobytes(),
                   np.array([len(x) for x in ids], "<i8").tobytes(), len(tokens), _packed(tokens, squeeze),
                   np.stack([seen, counts[seen]]).astype("<i8").tobytes() if last else None]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)],
                ["part", "block", "first", "doc_ids", "lengths", "n_tokens", "ids", "counts"])

        size = 0
        for rows in (rows for batch in batches for rows in _slices(batch)):
            for doc, found in zip(rows.column("doc_id").to_pylist(), encode(rows.column("text")), strict=True):
                got = np.append(found, np.uint32(end_id))
                if ids and size + len(got) > BLOCK_TOKENS:
                    yield close()
                    block, first, ids, docs_in, size = block + 1, first + size, [], [], 0
                ids.append(got)
                docs_in.append(-2**63 if doc is None else doc)
                size += len(got)
        if ids:
            yield close(last=True)
    return _ordered(docs).mapInArrow(run, RAW)


def _packed(tokens: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """The width of a number, then all first bytes, all second bytes and so on, compressed."""
    width = 2 if int(tokens.max()) < 1 << 16 else 4
    planes = tokens.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + squeeze.compress(planes.tobytes())


def _plain(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel()


def id_counts(raw: DataFrame) -> DataFrame:
    """(id, n) over all blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts"):
                at, n = np.frombuffer(counts.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["id", "n"])
    last = raw.where("counts is not null").select("counts")
    return last.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of the optimal prefix code with codes of at most ``limit`` bits (package-merge).

    Each level pairs the cheapest items of the level below; a package knows how many of the
    sorted symbols it covers, since at every level those are a prefix of them.
    """
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    if len(used) < 2:
        out[used] = 1
        return out
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    levels = []
    items = weight
    for _ in range(limit):
        levels.append(items)
        pairs = items[:len(items) // 2 * 2].reshape(-1, 2).sum(axis=1)
        items = np.sort(np.concatenate([weight, pairs]), kind="stable")
    # From the top: of the chosen prefix, count symbols; the rest are packages of the level below.
    chosen = 2 * len(order) - 2
    lengths = np.zeros(len(order), np.int64)
    for depth in range(limit - 1, -1, -1):
        below = levels[depth - 1] if depth else np.empty(0, np.int64)
        pairs = below[:len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        source = np.concatenate([np.zeros(len(order), bool), np.ones(len(pairs), bool)])
        rank = np.argsort(np.concatenate([weight, pairs]), kind="stable")[:chosen]
        packages = int(source[rank].sum())
        lengths[:chosen - packages] += 1
        chosen = 2 * packages
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: counted up in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for size in range(1, int(lengths.max(initial=0)) + 1):
        at = np.flatnonzero(lengths == size)
        code <<= size - last
        codes[at] = code + np.arange(len(at))
        code, last = code + len(at), size
    return codes


def decoding_table(lengths: np.ndarray) -> np.ndarray:
    """For every MAX_BITS-bit string: the id it starts with, above five bits with that id's code length."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    share = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids = np.zeros(1 << MAX_BITS, np.int64)
    ids[:share.sum()] = np.repeat(order, share)
    return ids << 5 | lengths[ids]


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The coded bits, most significant first, and the bit offset of every STEP-th token."""
    # Four codes are joined, by twos, to one of at most 64 bits; the last may be joined to empty ones.
    at = np.full(len(ids) + -len(ids) % 4, len(lengths), np.intp)
    at[:len(ids)] = ids
    coded = np.append(codes.astype(np.uint32) << 5 | lengths.astype(np.uint32), np.uint32(0))[at]
    size, code = coded & 31, coded >> 5
    code, size = code[::2] << size[1::2] | code[1::2], size[::2] + size[1::2]
    code = code[::2].astype(np.uint64) << size[1::2].astype(np.uint64) | code[1::2]
    size = (size[::2] + size[1::2]).astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    n_bits = int(end[-1]) if len(end) else 0
    # Bits go to words of 64. A joined code that crosses a word's end, the last to start there, goes on in the next.
    out = np.zeros(n_bits // 64 + 2, np.uint64)
    if len(end):
        code <<= (64 - size).astype(np.uint64)
        word, within = start >> 6, (start & 63).astype(np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        # Codes do not share bits, so unions take them together.
        out[word[first]] = np.bitwise_or.reduceat(code >> within, first)
        over = np.flatnonzero((start & 63) + size > 64)
        out[word[over] + 1] |= code[over] << (np.uint64(64) - within[over])
    return out.astype(">u8").tobytes()[:(n_bits + 7) // 8], start[::STEP // 4]


def decode_bits(bits: bytes, marks: np.ndarray, n: int, table: np.ndarray) -> np.ndarray:
    """All ids of a block. The stretches between marks are decoded side by side."""
    data = np.append(np.frombuffer(bits, np.uint8), np.zeros(3, np.uint8)).astype(np.int64)
    look = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    out = np.zeros((STEP, len(marks)), np.int64)
    at = marks.copy()
    peek, shift = np.empty_like(at), np.empty_like(at)
    for k in range(STEP):
        # The last stretch may end early; what is looked up behind it is cut off below.
        np.right_shift(at, 3, out=peek)
        look.take(peek, out=shift, mode="clip")
        np.bitwise_and(at, 7, out=peek)
        np.subtract(24 - MAX_BITS, peek, out=peek)
        np.right_shift(shift, peek, out=peek)
        np.bitwise_and(peek, (1 << MAX_BITS) - 1, out=peek)
        table.take(peek, out=out[k], mode="clip")
        np.bitwise_and(out[k], 31, out=shift)
        at += shift
    return (out.T.ravel()[:n] >> 5).astype(np.uint32)


@dataclass
class TokenFile:
    """Where the parts of a written file are."""

    blocks: str
    lengths: str
    parts: str


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID) -> TokenFile:
    """Encode ``docs`` (doc_id, text, any others) and write them in ascending doc_id order.

    Each text, a null as an empty one, becomes its ids and ``end_id``. Repeated doc_ids keep
    all rows, ordered by a hash of their texts; a null doc_id sorts first; an empty table
    gives an empty file.
    """
    spark = docs.sparkSession
    raw = stored(raw_blocks(docs, lambda: kept_encoder(tokenizer_path).column, end_id))
    return _write(spark, raw, path)


def _write(spark: SparkSession, raw: DataFrame, path: str) -> TokenFile:
    file = TokenFile(f"{path}/blocks", f"{path}/lengths", f"{path}/parts")
    found = id_counts(raw).collect()  # one row per id of the vocabulary
    counts = np.zeros(max([r.id for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)],
                          "id long, bits int").coalesce(1).write.parquet(file.lengths)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so this window is small.
    raw.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.parquet(file.parts)
    shared = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, codes = shared.value
        sys.modules.pop("_token_encoders", None)
        for batch in batches:
            for i in range(len(batch)):
                bits, marks = encode_bits(_plain(batch.column("ids")[i].as_py()), size, codes)
                row = batch.slice(i, 1).drop_columns(["ids"])
                yield row.append_column("bits", pa.array([bits], pa.binary())).append_column(
                    "marks", pa.array([marks.astype("<i8").tobytes()], pa.binary()))
    raw.drop("counts").mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(file.blocks)
    return file


def read_tokens(spark: SparkSession, file: TokenFile) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from a file; ids are little-endian 32-bit numbers."""
    return _read(spark, file, "ids binary", pa.binary(), lambda tokens: tokens.astype("<u4").tobytes())


def read_digests(spark: SparkSession, file: TokenFile) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from a file."""
    return _read(spark, file, "ids_crc32 long", pa.int64(),
                 lambda tokens: zlib.crc32(tokens.astype("<u4").tobytes()))


def _read(spark: SparkSession, file: TokenFile, column: str, kind: pa.DataType, of: Callable) -> DataFrame:
    sizes = spark.read.schema("id long, bits int").parquet(file.lengths).collect()
    lengths = np.zeros(max([r.id for r in sizes], default=-1) + 1, np.uint8)
    for r in sizes:
        lengths[r.id] = r.bits
    shared = spark.sparkContext.broadcast(decoding_table(lengths) if len(sizes) else None)
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.modules.pop("_token_encoders", None)
        for batch in batches:
            for i in range(len(batch)):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                ids = decode_bits(row["bits"], np.frombuffer(row["marks"], "<i8"), row["n_tokens"], shared.value)
                sizes = np.frombuffer(row["lengths"], "<i8")
                end = np.cumsum(sizes)
                docs = np.frombuffer(row["doc_ids"], "<i8")
                found = [of(ids[a:b]) for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, mask=docs == -2**63), pa.array(np.full(n, row["part"], np.int32)),
                     pa.array(row["first"] + end - sizes), pa.array(sizes), pa.array(found, kind)],
                    ["doc_id", "part", "at", "n_tokens", name])
    decoded = spark.read.schema(BLOCKS).parquet(file.blocks).mapInArrow(
        run, f"doc_id long, part int, at long, n_tokens long, {column}")
    parts = spark.read.schema("part int, before long").parquet(file.parts)
    return decoded.join(parts, "part").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", name)


def new_path(spark: SparkSession) -> str:
    """A new folder for a file in the shared folder."""
    return f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"

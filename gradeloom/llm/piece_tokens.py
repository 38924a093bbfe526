"""Encoding with a merge-type sentencepiece model through prefix tables, and decoding.

Merging always joins the neighbours whose union scores best, so a run of tokens is what merging
gives if, and only if, each two neighbours are what merging gives for their common text. Hence
every prefix of a text has exactly one possible last token: among the pieces that end there
(one automaton finds them all), the one that is compatible with the last token of the prefix
before it. The table of these tokens is filled from left to right in one pass; the ids are then
read off backwards. No text is merged step by step, however long it is.

Characters that stand in no piece are tokens by themselves, written as their bytes. A text is
cut where no piece can reach across, namely before blanks and around line ends, and the answers
for short parts seen before are kept in a table of bounded size.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
NORMAL, BYTE, USER_DEFINED, UNUSED = 1, 6, 4, 5
# Bounds of what a worker process keeps: parts, the length of a part, and judged pairs.
PARTS, PART_CHARS, PAIRS = 150_000, 48, 1_000_000
_CUT = re.compile(r"\n| *[^ \n]+| +")
_BATCH_BYTES = 8 << 20


class PieceModel:
    """The pieces of a model file, and the tables that encode and decode with them."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        rules = model.normalizer_spec
        if (model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or rules.precompiled_charsmap
                or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces
                or model.trainer_spec.treat_whitespace_as_suffix or kinds & {USER_DEFINED, UNUSED}):
            raise ValueError("only merge-type models with byte fallback and plain white space are supported")
        self.pieces = [p.piece for p in model.pieces]
        self.end_id = model.trainer_spec.eos_id
        self.silent = {i for i, p in enumerate(model.pieces) if p.type not in (NORMAL, BYTE)}
        self.byte_of = {i: int(p.piece[1:-1], 16) for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = [0] * 256
        for i, b in self.byte_of.items():
            self.byte_ids[b] = i
        normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.score = {p.piece: p.score for _, p in normal}
        self.number = {p.piece: i for i, p in normal}
        seen: dict[float, str] = {}
        for piece, score in self.score.items():
            if len(piece) > 1 and seen.setdefault(score, piece) != piece and len(set(seen[score] + piece)) > 1:
                raise ValueError("pieces of one score must be runs of one character")
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.score)
        # Characters that only occur inside pieces are tokens of their own, and have no id.
        atoms = {c for p in self.score for c in p} - set(self.score)
        self.tokens = [*self.pieces, *sorted(atoms)]
        self.sizes = list(map(len, self.tokens))
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.tokens):
            if piece in atoms or i < len(self.pieces) and self.number.get(piece) == i and self.merged(piece) == [piece]:
                self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        self.judged: dict[int, bool] = {}
        # Parts seen lately and a generation before: parts in use move on, rare ones fall away.
        self.known: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text, step by step: the best union first, then the leftmost."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves two tokens next to each other as they are."""
        key = left << 32 | right
        known = self.judged.get(key)
        if known is None:
            if len(self.judged) >= PAIRS:
                self.judged.clear()
            a, b = self.tokens[left], self.tokens[right]
            known = self.judged[key] = self.merged(a + b) == [a, b]
        return known

    def prefix_table(self, text: str) -> list[int | None]:
        """The last token of each prefix, by the prefix's length; None for a character in no piece."""
        last: list[int | None] = [None] * (len(text) + 1)
        sizes, judged = self.sizes, self.judged
        for at, token in self.automaton.iter(text):
            if last[at + 1] is None:
                before = last[at + 1 - sizes[token]]
                # None is the start of the text or a character that merges with nothing.
                if before is None:
                    last[at + 1] = token
                else:
                    known = judged.get(before << 32 | token)
                    if known or known is None and self.compatible(before, token):
                        last[at + 1] = token
        return last

    def part_ids(self, text: str) -> list[int]:
        """Ids of a text in which blanks are already written as ``BLANK``."""
        last, ids, at = self.prefix_table(text), [], len(text)
        while at:
            token = last[at]
            if token is None or token >= len(self.pieces):
                at -= 1
                ids += [self.byte_ids[b] for b in reversed(text[at].encode())]
            else:
                ids.append(token)
                at -= self.sizes[token]
        ids.reverse()
        return ids

    def parts(self, text: str) -> list[str]:
        """The text, with the blank that begins every text, cut where no piece reaches across."""
        if not text:
            return []
        text = " " + text.replace(BLANK, " ")
        return _CUT.findall(text) if self.cuts else [text]

    def encode(self, text: str) -> list[int]:
        """All ids, the end id included."""
        ids = [i for part in self.parts(text) for i in self.part_ids(part.replace(" ", BLANK))]
        return [*ids, self.end_id]

    def surface(self, ids: list[int]) -> str:
        """The text of ids, blanks as such: runs of byte ids are read as UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(BLANK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of all ids of a document, without the blank put before it."""
        return self.surface(ids).removeprefix(" ")

    def _of_part(self, part: str) -> tuple[str, int, str]:
        answer = self.older.get(part)
        if answer is None:
            ids = self.part_ids(part.replace(" ", BLANK))
            answer = "".join([f"{i} " for i in ids]), len(ids), self.surface(ids)
        if len(part) <= PART_CHARS:
            if len(self.known) >= PARTS:
                self.older, self.known = self.known, {}
            self.known[part] = answer
        return answer

    def written(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by a blank, their number, and what they decode to.

        Each part starts and ends with whole characters, so parts are also decoded alone.
        """
        known = self.known
        found = [known.get(p) or self._of_part(p) for p in self.parts(text)]
        return ("".join([f[0] for f in found]) + str(self.end_id), sum([f[1] for f in found]) + 1,
                "".join([f[2] for f in found]).removeprefix(" "))


def model_of(path: str) -> PieceModel:
    """The model, built once in each worker process."""
    holder = sys.modules.setdefault("_piece_models", types.ModuleType("_piece_models")).__dict__
    if path not in holder:
        holder[path] = PieceModel(path)
    return holder[path]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_ids, texts) of a few MB at a time; a null text is an empty one."""
    for batch in batches:
        column, begin, size = batch.column("text").cast(pa.large_binary()), 0, 0
        texts: list[str] = []
        for i, value in enumerate(column):
            data = value.as_py() or b""
            if texts and size + len(data) > _BATCH_BYTES:
                yield batch.column("doc_id").slice(begin, len(texts)), texts
                begin, size, texts = i, 0, []
            texts.append(data.decode("utf-8", "replace"))
            size += len(data)
        if texts:
            yield batch.column("doc_id").slice(begin, len(texts)), texts


def _mapped(docs: DataFrame, schema: str, kinds: list[pa.DataType], of: Callable[[str], tuple]) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _texts(batches):
            columns = zip(*map(of, texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encoded(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids) of every row; ``docs`` has doc_id and text, perhaps more.

    Rows with null or repeated doc_ids stay, a null or empty text has the end id only, and an
    empty table gives no rows. Texts are encoded where they are read: nothing is shuffled.
    """
    return _mapped(docs, "doc_id long, ids array<int>", [pa.list_(pa.int32())],
                   lambda text: (model_of(model_path).encode(text),))


def decoded(encodings: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for batch in batches:
            texts = [model.decode(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
    return encodings.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, as ``encoded`` and ``decoded`` give them."""
    def of(text: str) -> tuple:
        ids, n, back = model_of(model_path).written(text)
        return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
    return _mapped(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   [pa.int64(), pa.string(), pa.string()], of)

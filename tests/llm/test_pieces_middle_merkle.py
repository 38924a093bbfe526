"""Sentence pieces, fill-in-the-middle and the Merkle manifest against their libraries and plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gradeloom.llm import fill_middle, merkle, piece_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(library):
    model, rng = piece_tokens.PieceModel(MODEL), random.Random(1)
    alphabet = [" ", " ", "  ", " " * 11, "▁", "\n", "\t", "\r", "\x00", "a", "e", "th", "ing", "The", "é", "ß", "İ", "ﬁ", "�",
                "𐍈", "0", "12", "<0x0A>", "</s>", "中文", "执", "=====", " "]
    texts = ["", " ", "▁", "\n", *("".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000))]
    for text in [*texts, "é" * 30_000 + " " * 30_000 + "abc" * 10_000]:
        ids = library.encode(text, add_eos=True)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids)
        assert model.written(text) == (" ".join(map(str, ids)), len(ids), library.decode(ids))


def test_last_tokens_of_prefixes_are_what_merging_gives():
    """Each entry of the table is the last token of the prefix encoded alone."""
    model, rng = piece_tokens.PieceModel(MODEL), random.Random(2)
    for _ in range(200):
        text = "".join(rng.choices("▁▁abcdeinrst\té", k=rng.randint(1, 24)))
        table = model.prefix_table(text)
        for n in range(1, len(text) + 1):
            last = model.merged(text[:n])[-1]
            assert (table[n] is None and last not in model.number) or model.tokens[table[n]] == last


def test_bounded_tables_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_tokens, "PARTS", 3)
    monkeypatch.setattr(piece_tokens, "PAIRS", 5)
    monkeypatch.setattr(piece_tokens, "PART_CHARS", 4)
    model = piece_tokens.PieceModel(MODEL)
    text = "several words, and several more of the several words"
    assert model.written(text)[0] == " ".join(map(str, library.encode(text, add_eos=True)))
    model.cuts = False
    assert model.encode(text + "\n  x") == library.encode(text + "\n  x", add_eos=True)


def test_pieces_of_a_table(spark, sf_dir, odd, library, monkeypatch):
    monkeypatch.setattr(piece_tokens, "_BATCH_BYTES", 20_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    expected = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_eos=True)
        expected.append((r.doc_id or -1, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    got = [(r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piece_tokens.digests(docs, MODEL).collect()]
    assert sorted(got) == sorted(expected)
    ids = piece_tokens.encoded(odd, MODEL)
    back = sorted((r.doc_id or -1, r.text) for r in piece_tokens.decoded(ids, MODEL).collect())
    assert back == sorted((r.doc_id or -1, r.text or "") for r in odd.collect())
    assert piece_tokens.digests(odd.limit(0), MODEL).count() == 0
    assert "Exchange" not in piece_tokens.digests(odd, MODEL)._jdf.queryExecution().executedPlan().toString()


def test_ranks_and_places_of_a_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 500):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = fill_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [0, *np.cumsum(symbols == s).tolist()]
        ends = (0, 3)
        places = [i + 1 for i, s in enumerate(symbols) if s in ends]
        wanted = np.arange(len(places) + 2)
        found = matrix.locate(ends, np.zeros_like(wanted), np.full_like(wanted, n), wanted)
        assert found.tolist() == [0, *places, n]


_UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"\S*\s|\S+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "char": r"(?s:.)"}


@pytest.mark.parametrize("unit", list(_UNIT))
def test_middles_against_a_list_of_units(spark, sf_dir, odd, documents, monkeypatch, unit):
    monkeypatch.setattr(fill_middle, "_CHARS", 30_000)
    more = documents([(20, "\n"), (21, "\n\n"), (22, "a\n\nb"), (23, "<"), (24, "a <S> b"), (25, "x<\nS>\n<M\n>"), (26, "é\n𐍈\nz. y! ")])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionAll(
        odd.unionAll(more).select("doc_id", "text"))
    expected = []
    for doc, text in docs.collect():
        text = text or ""
        units = re.findall(_UNIT[unit], text)
        h = [int(sha(f"7:{'' if doc is None else doc}")[i:i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        row = (len(units), "plain", None, None, text)
        if text and not any(x in text for x in ("<P>", "<S>", "<M>")):
            row = ((len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50
                   else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))
        expected.append((doc, *row, text))
    out = fill_middle.transformed(docs, unit).withColumn("restored", fill_middle.restored())
    key = lambda r: (r[0] is not None, r[0], r[5])
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(expected, key=key)


def test_middles_of_a_share(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none, some = fill_middle.transformed(docs, rate=0), fill_middle.transformed(docs, rate=50, spm=100)
    assert none.where("form <> 'plain'").count() == 0
    assert 0.3 < some.where("form = 'spm'").count() / docs.count() < 0.7 and some.where("form = 'psm'").count() == 0
    assert fill_middle.transformed(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fill_middle.transformed(odd, "page")


def plain_levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_siblings(levels, index):
    for level in levels[:-1]:
        first = index // 3 * 3
        yield level[first:index], level[index + 1:first + 3]
        index //= 3


def plain_leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def test_places_in_postorder():
    for n in [*range(1, 40), 81, 82, 200]:
        levels = plain_levels([sha(str(i)) for i in range(n)])
        order = []

        def visit(level, index):
            if level:
                for j in range(3 * index, min(3 * index + 3, len(levels[level - 1]))):
                    visit(level - 1, j)
            order.append((level, index))
        visit(len(levels) - 1, 0)
        height = merkle.height_of(n)
        assert height == len(levels) - 1
        assert [merkle.position(level, j, n, height) for level, j in order] == list(range(len(order)))
        log = merkle.postorder(levels[0], height)
        assert log == [levels[level][j] for level, j in order]
        for i, path in enumerate(merkle.paths(log, n, height, "")):
            assert path == "".join("".join(a) + "|" + "".join(b) + ";" for a, b in plain_siblings(levels, i))
            assert merkle.fold(levels[0][i], path) == levels[-1][0]


def test_full_subtrees_keep_their_places():
    for n in (9, 27, 50):
        for level, index in ((0, 3), (1, 2), (2, 0)):
            assert merkle.position(level, index, n, merkle.height_of(n)) == merkle.position(level, index, 1000, merkle.height_of(1000))


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_a_plain_tree(spark, sf_dir, odd, documents, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** height)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(odd.select(docs.columns)).unionByName(docs.where("doc_id < 3").withColumn("source", F.lit("é only")))
    docs = docs.withColumns({c: F.lit("clash") for c in ("key", "index", "digest", "path", "n", "block")})
    rows, groups = docs.collect(), {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id, plain_leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([g[2] for g in sorted(groups[s], key=lambda g: g[:3])]) for s in names}
    top = plain_levels([trees[s][-1][0] for s in names])
    expected = []
    for k, s in enumerate(names):
        for i, (_, doc, leaf, r) in enumerate(sorted(groups[s], key=lambda g: g[:3])):
            sides = [*plain_siblings(trees[s], i), *plain_siblings(top, k)]
            tampered = doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0
            folded = plain_leaf(r, r.text.replace("\n", "") if tampered and r.text is not None else r.text)
            for a, b in sides:
                folded = sha("".join([*a, folded, *b]))
            proof = sha("".join("".join(a) + "".join(b) for a, b in sides))
            expected.append((doc or -1, leaf, trees[s][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    out = merkle.audited(docs, F.replace("text", F.lit("\n"), F.lit("")), F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    assert sorted((r[0] or -1, *r[1:]) for r in out.collect()) == sorted(expected)
    made = merkle.manifest(merkle.stored(merkle.leaves(docs)))
    nodes = merkle.log_nodes(made.groups).collect()
    for s in names:
        key = "-" if s is None else "=" + s
        mine = sorted((r.position, r.level, r["index"], r.digest) for r in nodes if r.key == key)
        assert [r[0] for r in mine] == list(range(sum(map(len, trees[s]))))
        assert all(trees[s][level][index] == digest for _, level, index, digest in mine)


def test_manifest_of_one_row_and_of_none(spark, odd):
    unchanged = lambda df: merkle.audited(df, F.col("text"), F.lit(True)).collect()
    assert unchanged(odd.limit(0)) == []
    row, = unchanged(odd.where("doc_id = 2"))
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == sha("")

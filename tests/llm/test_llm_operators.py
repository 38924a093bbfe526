"""Operators against plain loops, and on awkward rows."""

import hashlib
import json
import re
import shutil
import sys
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm import (
    components, decontaminate, fm_dedup, fm_index, licenses, mixing, order_minhash, quality, simhash, token_files,
    tool_chat, url_filter, words,
)

SPACE_WORD = re.compile("[^\x20\x09-\x0d]+")


def some_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def test_word_hashes_agree_in_every_form():
    rng = np.random.default_rng(3)
    for _ in range(100):
        text = bytes(rng.choice(np.frombuffer(b"ab \n\tc\x0b\xc3\xa9", np.uint8), rng.integers(0, 300)))
        assert (words.hashes_of(text) == words.word_hashes(text.split())).all()


def test_strong_hashes_tell_words_apart():
    """Words that collide modulo every power of two, and the same word at any place."""
    one, two = b"a", b"b"
    for _ in range(11):
        one, two = one + two, two + one
    assert words.word_hashes([one])[0] == words.word_hashes([two])[0]
    assert len({*words.hashes_of(one + b" " + two, strong=True).tolist()}) == 2
    text = b" ".join([b"x%d" % (i % 50) for i in range(100_000)] + [one, b"z" * 600_000, one])
    found = words.hashes_of(text, strong=True)
    assert len(np.unique(found)) == 52 and found[-1] == found[-3]
    for i in range(50):
        assert (found[i:100_000:50] == words.hashes_of(b"x%d" % i, strong=True)[0]).all()


def test_windows_with_colliding_words_are_kept(documents):
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    rest = " ".join(f"w{i}" for i in range(12))
    out = {r.doc_id: r for r in fm_dedup.without_copies(documents([(1, f"{rest} {one}"), (2, f"{rest} {two}"), (3, f"{rest} {one}")])).collect()}
    assert (out[2].n_removed, out[3].n_removed) == (0, 13) and bytes(out[2].kept).decode() == f"{rest} {two}"


def test_words_are_encoded_by_columns(monkeypatch):
    """Ids equal the tokenizer's; only words of unusual characters are split one by one."""
    rng = np.random.default_rng(6)
    monkeypatch.setitem(sys.modules, "_token_tables", types.ModuleType("_token_tables"))
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    parts = [*"abZst.,!019\n\t\0\x01\x1c\x85\xa0éß中", *[" "] * 9, "'s", "the", "don't", "a\nb\nc", "é\nx", "1\n2.", "\n\n", "line.\nLine"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(1500)] + ["", " ", "<|endoftext|> a b", "a b "]
    for size in (100_000, 40, 40):
        monkeypatch.setattr(token_files, "WORDS", size)
        for i in range(0, len(texts), 300):
            got = encoder.column(pa.array([*texts[i:i + 300], None]))
            expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in [*texts[i:i + 300], ""]]
            assert [x.tolist() for x in got] == expected
            assert len(encoder.tables.words) == len(encoder.tables.ids) == len(encoder.tables.met) <= 2 * size or size > 40
    singly = []
    monkeypatch.setattr(token_files.Encoder, "other_words", lambda self, x: singly.extend(x) or [b""] * len(x))
    fresh = ["newword, Überwort.\nZweite zeile\nendet&& so", "c3 newword"]
    monkeypatch.setitem(sys.modules, "_token_tables", types.ModuleType("_token_tables"))
    token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json")).column(pa.array(fresh))
    assert singly == []


def test_texts_are_cut_in_groups_as_one_by_one(monkeypatch):
    """Segments and kept words of a group equal those of its texts alone; words are hashed once a group."""
    rng = np.random.default_rng(8)
    blanks = np.array([" ", " ", " ", "\n", "  ", "\t \r\n"])
    texts = ["", " ", "a", " " + "b " * 12, "b " * 13]
    for n in (3, 12, 13, 14, 40, 200):
        words_of = [w[:rng.integers(1, 50)] for w in rng.choice(["é\0x" * 12, "word" * 12, "0123456789" * 5, "\0" * 9], n)]
        texts.append("".join(b + w for b, w in zip(rng.choice(blanks, n), words_of, strict=True)))
    raw = [t.encode() for t in texts]
    calls = []
    monkeypatch.setattr(fm_dedup, "joined_hashes", lambda x: calls.append(x) or words.joined_hashes(x))
    found = fm_dedup._cut(raw)
    assert len(calls) == 1
    ids = fm_dedup.segment_ids(found.hashes, found.begin, found.size + 12).tolist()
    got = list(zip(found.owner.tolist(), found.key.tolist(), found.at.tolist(), found.size.tolist(), ids, strict=True))
    alone = [(i, fm_dedup._cut([t])) for i, t in enumerate(raw)]
    assert got == [
        (i, k, a, n, s) for i, x in alone if x for k, a, n, s in zip(
            x.key.tolist(), x.at.tolist(), x.size.tolist(),
            fm_dedup.segment_ids(x.hashes, x.begin, x.size + 12).tolist(), strict=True)]
    hashes, first = words.joined_hashes(raw)
    names: dict[bytes, int] = {}
    for i, t in enumerate(raw):
        split = t.split()
        assert len(split) == first[i + 1] - first[i]
        assert all(names.setdefault(w, h) == h for w, h in zip(split, hashes[first[i]:].tolist(), strict=False))
    assert len(set(names.values())) == len(names) > 60
    spans = pa.array([[{"at": 3, "lost": 0b101}] if len(t.split()) > 30 else None for t in raw],
                     pa.list_(pa.struct([("at", pa.int32()), ("lost", pa.int32())])))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(raw))), pa.array(texts), spans], ["doc_id", "text", "spans"])
    for size in (1, 1 << 19):
        monkeypatch.setattr(fm_dedup, "GROUP_BYTES", size)
        kept = [r for b in fm_dedup._kept_words(batch) for r in b.to_pylist()]
        expected = [[w for j, w in enumerate(t.split()) if len(t.split()) <= 30 or not 3 <= j < 18] for t in raw]
        assert [r["kept"] for r in kept] == [b" ".join(x) for x in expected]
        assert [(r["n_words"], r["n_removed"]) for r in kept] == [
            (len(t.split()), len(t.split()) - len(x)) for t, x in zip(raw, expected, strict=True)]


def test_minima_are_the_rightmost():
    values = np.random.default_rng(4).integers(0, 2**64, 300, dtype=np.uint64)
    values[::3] = values[0]
    expected = [i + 9 - int(np.argmin((values[i:i + 10] >> np.uint64(24))[::-1])) for i in range(291)]
    assert words.rightmost_minima(values, 10).tolist() == expected


def test_quality_is_learnt_and_held_out(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
    scores = quality.quality_scores(docs, labels.where("doc_id % 3 > 0"))
    held = scores.join(labels.where("doc_id % 3 = 0"), "doc_id").agg(
        F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert held > 0.93
    assert quality.quality_scores(odd, labels).count() == odd.count()
    none = quality.quality_scores(odd, labels.limit(0))
    assert none.where("score = 1 AND keep").count() == odd.count()
    assert quality.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_every_confident_row_teaches(spark, sf_dir):
    """Against a plain loop over all rows, where the surest ones are copies by the thousand."""
    folder = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("doc_id % 3 > 0")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    copies = docs.where("doc_id < 5").crossJoin(spark.range(1, 500)).withColumn("doc_id", F.col("id") * 10_000 + F.col("doc_id")).drop("id")
    table = quality.stored(quality.measured(docs.unionByName(copies)))
    got = quality.fit_views(table, labels)
    known = {r.doc_id: r.y for r in labels.where("quality IN (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("y")).collect()}
    rows = sorted(table.collect(), key=lambda r: (r.key, r.doc_id))
    t, m = (np.array([r[c] for r in rows], float) for c in "tm")
    y = np.array([known.get(r.doc_id, -1) for r in rows], float)
    at = np.flatnonzero(y >= 0)
    aside, learn, free = at[3::4], np.delete(at, np.s_[3::4]), np.flatnonzero(y < 0)
    sets = {"t": (t[learn], y[learn], None), "m": (m[learn], y[learn], None)}
    for turn in range(quality.ROUNDS + 1):
        text, meta = (quality.fit_logistic(x, z, weight=w) for x, z, w in sets.values())
        views = quality.Views(text, meta, quality.fit_logistic(text.logit(t[aside])[:, None], y[aside]),
                              quality.fit_logistic(meta.logit(m[aside])[:, None], y[aside]))
        if turn == quality.ROUNDS:
            break
        pt, pm = (1 / (1 + np.exp(-x)) for x in views.scores(t[free], m[free]))
        for learner, all_x, own, other in (("t", t, pt, pm), ("m", m, pm, pt)):
            use = [(i, p > 0.5) for i, o, p in zip(free, own, other, strict=True)
                   if max(p, 1 - p) >= 0.95 and not (max(o, 1 - o) >= 0.95 and (o > 0.5) != (p > 0.5))]
            new = [i for i, _ in use]
            share = min(1.0, len(learn) / max(1, len(new)))
            sets[learner] = (all_x[[*learn, *new]], np.array([*y[learn], *(z for _, z in use)], float),
                             np.array([1.0] * len(learn) + [share] * len(new)))
    assert len(new) > 2000
    for a, b in ((got.text, views.text), (got.meta, views.meta)):
        assert np.allclose(a.mean, b.mean, atol=1e-6) and np.allclose(a.weights, b.weights, atol=1e-4)


def test_url_cascade_is_exact(spark, monkeypatch):
    hosts = [f"h{i}.example.org" for i in range(3000)]
    rows = [(i, f"http://{h.upper()}/a?b") for i, h in enumerate(hosts)] + [(-1, None), (-2, "no url"), (-3, "x://a.com#/q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    listed = spark.createDataFrame([(h,) for h in hosts[::7]] + [(None,), ("unknown",), (hosts[0],)], "host string")
    for bits in (1 << 24, 1 << 11):
        monkeypatch.setattr(url_filter, "PIECE_BITS", bits)
        out = {r.page_id: r for r in url_filter.judged(pages, listed, [("com", "", "allow"), ("a.com", "", "block")]).collect()}
        assert [i for i in range(3000) if out[i].verdict == "block"] == list(range(0, 3000, 7))
        assert (out[-1].host, out[-1].path, out[-2].host, out[-1].verdict) == ("", "", "", "allow")
        assert (out[-3].rule, out[-3].verdict) == ("a.com", "block")
    assert url_filter.judged(pages.limit(0), listed).count() == 0


def test_tool_calls_are_ordered_and_checked(spark):
    schema = {"f": {"required": ["n"], "properties": {"n": {"type": "integer", "maximum": 5}, "é": {"type": "string"}}}}
    chain = [(1, i, f"c{i}", "f", '{"n": 1}', f"c{i - 1}") for i in range(40)]
    loop = [(2, 0, "x", "f", '{"n": 9, "é": "\\u00e9"}', "y"), (2, 1, "y", "f", "{", "x"), (2, 2, "z", "g", None, "x")]
    calls = spark.createDataFrame(chain + chain[:3] + loop + [(3, 0, None, "f", "{}", None), (3, 1, "w", "f", '{"n": true}', None)],
                                  "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 9, "c1", "b"), (1, 9, "c1", "a"), (5, 1, "lost", None)],
                                    "conv_id long, turn long, call_id string, content string")
    out = {r.call_id: r for r in tool_chat.linked_calls(calls, results, schema).collect()}
    assert [out[f"c{i}"].depth for i in range(40)] == list(range(40)) and len(out) == 45
    assert {k: out[k].status for k in ("c0", "c1", "x", "z", "lost", "w")} == {
        "c0": "pending", "c1": "linked", "x": "cycle", "z": "cycle", "lost": "orphan", "w": "invalid"}
    assert out["c1"].json == ('{"after":"c0","arguments":{"n":1},"call":"c1","conversation":1,"depth":1,"errors":[],'
                              '"name":"f","result":"a"}')
    assert json.loads(out["x"].json)["errors"] == ["n: too large"] and '"é":"é"' in out["x"].json
    assert out["y"].errors == ["arguments are no JSON"] and out["z"].errors == ["arguments are no JSON"]
    assert tool_chat.linked_calls(calls.limit(0), results.limit(0), schema).count() == 0


def test_legal_but_unwritable_arguments_are_errors(spark):
    rows = [(1, i, f"c{i}", "f", a, None) for i, a in enumerate((
        '{"n": 1e400}', '{"n": "\\ud800"}', '{"\\udfff": 1}', '{"n": NaN}', "[" * 100_000, '{"n": "\\ud83d\\ude00"}'))]
    calls = spark.createDataFrame(rows, "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    out = {r.turn: r for r in tool_chat.linked_calls(calls, results, {"f": {"properties": {"n": {"type": "string"}}}}).collect()}
    assert [out[i].errors for i in range(6)] == [
        ["a number is out of range"], ["a string is no Unicode text"], ["a string is no Unicode text"],
        ["arguments are no JSON"], ["arguments are no JSON"], []]
    assert '"n":"😀"' in out[5].json and all(json.loads(r.json)["arguments"] is None for i, r in out.items() if i < 5)


def test_license_rules_keep_their_bounds():
    starts: dict = {}
    for rule in licenses.RULES:
        assert re.search("|".join(licenses.GATES), rule.pattern.replace("[sc]", "s")), rule
        assert len(re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", rule.pattern).split()) <= licenses.MOST_WORDS
        for w in rule.first:
            assert re.fullmatch("[a-z0-9]+", w)
            starts[w] = starts.get(w, 0) + 1
    assert len(licenses.RULES) > 300 and max(starts.values()) <= licenses.MOST_RULES


def _expansions(pattern):
    """Every string a rule's pattern stands for, with a digit for \\d."""
    if (m := re.search(r"\(\?:([^()]*)\)(\??)", pattern)) or (m := re.search(r"\[([a-z])([a-z])\]", pattern)):
        parts = m[1].split("|") + [""] * (m[2] == "?") if m[0][0] == "(" else [m[1], m[2]]
        return {x for part in parts for x in _expansions(pattern[:m.start()] + part + pattern[m.end():])}
    return {pattern.replace(r"\d", "4")}


def test_every_license_phrase_has_a_gate_word(documents):
    for rule in licenses.RULES:
        for phrase in _expansions(rule.pattern):
            assert re.fullmatch(rule.pattern, phrase) and set(phrase.split()) & set(licenses.GATES), phrase
    texts = ["CC0", "(cc0-1.0)", "Released under CC0.", "distributed under the terms of the CC0", "acc0rd cc01"]
    out = {r.doc_id: r for r in licenses.summarised(licenses.scanned(documents(list(enumerate(texts))))).collect()}
    assert [out[i].labels for i in range(5)] == ["cc0"] * 4 + [""]
    assert [out[i].score for i in range(5)] == [0.8, 0.8, 1.0, 1.0, 0.0]


@pytest.mark.parametrize("text, labels", [
    ("GNU General Public License v3", "gpl,gpl-3.0"), ("the GNU General Public License, version 2 or later", "gpl,gpl-2.0"),
    ("Apache License v2", "apache,apache-2.0"), ("Apache 2.0 License", "apache-2.0"), ("GPLv3", "gpl-3.0"), ("under LGPLv2.1", "lgpl-2.1"),
    ("licensed under the LGPLv2.1", "lgpl-2.1"), ("Mozilla Public License v2.0", "mpl-2.0"), ("3-Clause BSD License", "bsd-3-clause"),
    ("New BSD licence", "bsd-3-clause"), ("GPL v2 license", "gpl-2.0"), ("AGPL3 only", "agpl-3.0"), ("GPL version 3.0 license", "gpl-3.0"),
    ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("Apache License Version 1.1", "apache,apache-1.1"), ("gplv4 apache2", ""),
])
def test_license_forms(documents, text, labels):
    assert licenses.summarised(licenses.scanned(documents([(1, f"See: {text}.")]))).first().labels == labels


def test_license_suppression(documents, odd):
    text = "Licensed under the Apache License, Version 2.0 or MIT license MIT License"
    row = licenses.scanned(documents([(1, text)])).first()
    assert [(d.start, d.end, d.label) for d in row.detections] == [(0, 8, "apache-2.0"), (9, 11, "mit"), (11, 13, "mit")]
    assert licenses.summarised(licenses.scanned(odd)).count() == odd.count()


def test_extra_columns_survive_every_stage(spark, sf_dir):
    """Columns named as the stages name theirs, and metadata of other types."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    names = ["_text_hash", "_marks", "_u", "_e", "_p", "_copies", "_copy", "_n", "_lang", "_r_doc_id", "_R_text"]
    docs = docs.withColumn("source", F.hash("source") % 5).withColumn("n_chars", F.col("n_chars").cast("string")).withColumns(
        {n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    labelled = docs.select("doc_id", F.col("lang").alias("domain"))
    for out in (quality.keep_good(docs, labels), simhash.keep_one(docs), decontaminate.drop_contaminated(docs, items),
                mixing.mixed(docs, labelled)):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_sketches_of_any_bound(monkeypatch):
    """Against all hashes of all sketches, also where the first bound lets too few through."""
    rng = np.random.default_rng(6)
    texts = ["ab", "a" * 5, "abcdefgh", *("".join(rng.choice(list("abcd "), rng.integers(9, 400))) for _ in range(150))]
    found = [order_minhash.sketches(t) for t in texts]
    below = order_minhash._below
    calls = []
    monkeypatch.setattr(order_minhash, "_below", lambda h, bound: calls.append(bound) or below(h, np.uint64(2**64 - 1)))
    for text, sketch in zip(texts, found, strict=True):
        assert (order_minhash.sketches(text) == sketch).all()


def test_white_space_beyond_ascii_beside_blanks():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    texts = [t for c in [*spaces, "é", "£", "“", "中", "あ", "\U0001f600"]
             for t in (f"a {c}b c", f"ab{c} c", f"b {c} {c}a", f"{c} a", f"a {c}", f"é{c} 中{c} b")]
    got = encoder.column(pa.array([*texts, "", None]))
    assert [x.tolist() for x in got] == [encoder.whole(t).tolist() for t in [*texts, "", ""]]


def test_tasks_of_a_worker_share_an_encoder(monkeypatch, tmp_path):
    """The tokenizer is read once; another file has its own encoder and tables."""
    from tokenizers import Tokenizer

    path, read = public_tokenizers.path("byte_bpe_50k.json"), []
    copy = shutil.copy(path, tmp_path / "copy.json")
    monkeypatch.setitem(sys.modules, "_token_encoders", types.ModuleType("_token_encoders"))
    monkeypatch.setattr("tokenizers.Tokenizer", types.SimpleNamespace(
        from_file=lambda p: read.append(p) or Tokenizer.from_file(p)))
    texts = pa.array(["some words some words", "more words", None])
    found = [[x.tolist() for x in token_files.kept_encoder(p).column(texts)] for p in (path, path, str(copy), path)]
    assert read == [path, str(copy)] and found == found[:1] * 4
    assert token_files.kept_encoder(path).tables is not token_files.kept_encoder(str(copy)).tables


def test_ids_are_counted_where_they_are_encoded(spark, documents, monkeypatch):
    """Counts come with the blocks of a partition, whose ids are not read again."""
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 4)
    lists = {"a": [7, 7, 1], "b": [70_000, 1], "c": [7, 3, 3, 3, 3, 3], "": []}
    column = lambda texts: [np.array(lists[t], np.uint32) for t in pc.fill_null(texts, "").to_pylist()]
    docs = documents([(i, t) for i, t in enumerate(["a", "b", "c", "", None, "b", "a", "a"])])
    raw = token_files.stored(token_files.raw_blocks(docs, lambda: column, 2))
    counts = token_files.id_counts(raw)
    assert raw.count() > raw.select("part").distinct().count() == raw.where("counts is not null").count()
    assert {r.id: r.n for r in counts.collect()} == {1: 5, 2: 8, 3: 5, 7: 7, 70_000: 2}
    assert "ids:binary" not in counts._jdf.queryExecution().toString()
    nothing = token_files.stored(token_files.raw_blocks(docs.limit(0), lambda: column, 2))
    assert token_files.id_counts(nothing).count() == 0


def test_bits_of_codes_of_all_lengths():
    """As written one by one; codes of 1 to 16 bits, cut at any number of tokens."""
    rng = np.random.default_rng(8)
    for counts in (1 << np.arange(40), np.ones(1 << 16, np.int64), np.array([0, 0, 5]), rng.integers(0, 9, 3000)):
        lengths = token_files.code_lengths(counts.astype(np.int64))
        codes, table = token_files.canonical(lengths), token_files.decoding_table(lengths)
        for n in (0, 1, 2, 3, 4, 5, 63, 255, 256, 257, 1030, 5000):
            ids = rng.choice(np.flatnonzero(lengths), n).astype(np.uint16)
            bits, marks = token_files.encode_bits(ids, lengths, codes)
            plain = "".join(f"{codes[i]:0{lengths[i]}b}" for i in ids.tolist())
            assert bits == bytes(int(plain[k:k + 8].ljust(8, "0"), 2) for k in range(0, len(plain), 8))
            ends = np.append(0, np.cumsum(lengths[ids], dtype=np.int64))
            assert marks.tolist() == ends[:n:token_files.STEP].tolist()
            assert n == 0 or (token_files.decode_bits(bits, marks, n, table) == ids).all()


def _huffman_cost(counts):
    heap, cost = sorted(c for c in counts.tolist() if c), 0
    while len(heap) > 1:
        merged = heap[0] + heap[1]
        cost += merged
        heap = sorted([merged, *heap[2:]])
    return cost


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 0, 34, 55], np.int64)
    for limit in (16, 5):
        lengths = token_files.code_lengths(counts, limit).astype(int)
        used = lengths > 0
        assert (used == (counts > 0)).all() and lengths.max() <= limit and (2.0 ** -lengths[used]).sum() == 1
    best = token_files.code_lengths(counts, 16).astype(int)
    assert (best * counts).sum() == _huffman_cost(counts)
    assert token_files.code_lengths(np.array([0, 7]), 16).tolist() == [0, 1]


def test_token_file_round_trip(spark, sf_dir, odd, monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    extra = [(90, "x  y \n z<|endoftext|> "), (91, " lead"), (92, "it's 12,5 € ﬁn\u00a0x ٣"), (93, "a\u0085b \x1cc")]
    docs = some_docs(spark, sf_dir).unionByName(odd.select("doc_id", "text")).unionAll(
        spark.createDataFrame(extra, "doc_id long, text string"))
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 5000)
    file = token_files.write_tokens(docs, token_files.new_path(spark), path)
    got = sorted(token_files.read_digests(spark, file).collect(), key=lambda r: r.start)
    expected = {}
    for r in docs.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        expected.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    found, start = {}, 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        found.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert len(token_files.read_tokens(spark, file).where("doc_id = 2").first().ids) == 4 * expected[2][0][0]
    empty = token_files.write_tokens(docs.limit(0), token_files.new_path(spark), path)
    assert token_files.read_digests(spark, empty).count() == 0


def test_order_minhash_follows_edits(spark, sf_dir, odd):
    rows = sorted(((r.doc_id, r.text or "") for r in some_docs(spark, sf_dir).collect()), reverse=True)
    out = {r.doc_id: r for r in order_minhash.edit_fingerprints(some_docs(spark, sf_dir)).collect()}
    for i, (doc, text) in enumerate(rows):
        half, following = len(text) // 2, rows[(i + 1) % len(rows)][1]
        new = text[:len(text) - half] + following[:half]
        assert out[doc].edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and out[doc].n_chars == len(text)
    assert np.mean([r.near_edited for r in out.values()]) > 0.05 > np.mean([r.near_next for r in out.values()])
    base = rows[0][1] * 3
    one = order_minhash.likeness(order_minhash.sketches(base), order_minhash.sketches(base[:100] + "X" + base[100:]))
    swapped = order_minhash.likeness(order_minhash.sketches(base), order_minhash.sketches(base[len(base) // 2:] + base[:len(base) // 2]))
    assert one > 0.6 and one > swapped
    result = order_minhash.edit_fingerprints(odd).collect()
    assert len(result) == odd.count() and {r.fingerprint for r in result if r.doc_id == 1} == {"0" * 256}
    assert order_minhash.edit_fingerprints(odd.where("doc_id = 2")).first().near_next == 1.0
    assert order_minhash.edit_fingerprints(odd.limit(0)).count() == 0


def test_mixing_meets_targets(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.where("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    mixture, table = mixing.fit_mixture(mixing.stored(mixing.measured(docs)), labelled, {"en": 0.4, "de": 0.3, "fr": 0.3})
    data = table.collect()
    a = np.array([[r.tokens * r[f"p{d}"] for d in range(3)] for r in data])
    rate = np.array([r[0] for r in table.select(mixture.rates.of([F.col(f"p{d}") for d in range(3)])).collect()])
    assert (rate >= 0).all()
    assert np.abs(a.T @ rate - mixture.target).max() < 0.01 * max(mixture.target)
    # Plain projected gradient over the same table reaches no smaller gap.
    w, step = np.ones(len(a)), 1 / np.linalg.norm(a.T @ a, 2)
    for _ in range(3000):
        w = np.maximum(0, w - step * (a @ (a.T @ w - mixture.target)))
    assert np.linalg.norm(a.T @ rate - mixture.target) <= np.linalg.norm(a.T @ w - mixture.target) + 0.02 * sum(mixture.target)
    assert mixing.mixing_rates(odd, labelled).count() == odd.count()
    assert mixing.mixed(odd, labelled.limit(0)).count() == odd.count()
    assert mixing.mixed(docs, labelled).columns == docs.columns


def test_decontamination_against_windows(spark, sf_dir, odd):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").unionAll(spark.createDataFrame(
        [(900, "the and"), (901, "Is"), (902, ""), (903, None), (None, "same words here"), (904, "same words here")],
        "item_id long, text string"))
    docs = some_docs(spark, sf_dir).unionByName(odd.select("doc_id", "text"))
    cut = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    windows = {}
    for item, text in items.collect():
        w = cut(text)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j:j + 13]), set()).add(item)
    expected = []
    for doc, text in docs.collect():
        w, hit, found = cut(text), set(), set()
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if items_here := windows.get(tuple(w[j:j + m])):
                    hit |= set(range(j, j + m))
                    found |= items_here - {None}
        expected.append((doc or -1, len(w), len(hit), len(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    got = [(r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judged(docs, items).collect()]
    assert sorted(got) == sorted(expected)
    clean = decontaminate.drop_contaminated(odd, items)
    assert clean.columns == odd.columns and clean.where("doc_id IN (2, 3)").count() == 0
    assert decontaminate.judged(odd, items.limit(0)).where("contaminated").count() == 0


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    lengths = rng.integers(13, 30, 60)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int(lengths.sum()) + 60, np.int64)
    for s, n in zip(starts, lengths, strict=True):
        text[s:s + n] = np.tile(rng.integers(1, 4, 3), 10)[:n] if rng.random() < 0.7 else rng.integers(1, 9, n)
    values = rng.permutation(60)
    found = fm_index.FMIndex(text, starts, values).smallest_values(text, starts, lengths)
    first = {}
    for s, n, v in zip(starts, lengths, values, strict=True):
        for j in range(n - 12):
            key = tuple(text[s + j:s + j + 13])
            first[key] = min(v, first.get(key, 99))
    for i, (s, n) in enumerate(zip(starts, lengths, strict=True)):
        assert found[i, :n - 12].tolist() == [first[tuple(text[s + j:s + j + 13])] for j in range(n - 12)]


@pytest.mark.parametrize("hot", [False, True])
def test_substring_dedup_against_windows(spark, sf_dir, odd, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(fm_dedup, "HOT_LEAST", 3)
        monkeypatch.setattr(fm_dedup, "HOT_SHARE", 10**9)
        monkeypatch.setattr(fm_dedup, "PIECE_WORDS", 500)
    docs = some_docs(spark, sf_dir).unionByName(odd.select("doc_id", "text"))
    rows = [(i, SPACE_WORD.findall(t or "")) for i, t in docs.collect()]
    first = {}
    for i, w in rows:
        for j in range(len(w) - 12 if i is not None else 0):
            key = tuple(w[j:j + 13])
            first[key] = min(i, first.get(key, i))
    expected = []
    for i, w in rows:
        gone = {k for j in range(len(w) - 12 if i is not None else 0) if first[tuple(w[j:j + 13])] < i for k in range(j, j + 13)}
        expected.append((i or -1, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone).encode()))
    got = [(r.doc_id or -1, r.n_words, r.n_removed, bytes(r.kept)) for r in fm_dedup.without_copies(docs).collect()]
    assert sorted(got) == sorted(expected)
    assert fm_dedup.without_copies(odd.limit(0)).count() == 0


def test_forest_joins_components():
    nodes, roots = components.forest(np.array([5, 3, 9, 7]), np.array([3, 1, 9, 8]))
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {1: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 9}


@pytest.mark.parametrize("chunks, hot", [(3, False), (4, True)])
def test_simhash_groups_against_all_pairs(spark, sf_dir, odd, monkeypatch, chunks, hot):
    if hot:
        monkeypatch.setattr(simhash, "HOT_LEAST", 2)
        monkeypatch.setattr(simhash, "HOT_SHARE", 10**9)
    docs = some_docs(spark, sf_dir).unionByName(odd.select("doc_id", "text"))
    rows = []
    for doc, text in docs.collect():
        w = SPACE_WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[j:j + 4]).encode(), 42) for j in range(max(1, len(w) - 3) if w else 0)]
        rows.append((doc, sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))))
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for doc, f in rows:
        if doc is not None:
            least[root(f)] = min(doc, least.get(root(f), doc))
    expected = sorted((doc or -1, f, least.get(root(f), -1)) for doc, f in rows)
    got = simhash.near_groups(docs, chunks=chunks).collect()
    assert sorted((r.doc_id or -1, r.fp & (2**64 - 1), -1 if r.component_id is None else r.component_id) for r in got) == expected
    kept = simhash.keep_one(odd, chunks=chunks)
    assert kept.columns == odd.columns and kept.count() == len({root(f) for _, f in rows[-odd.count():]})

"""Registered queries against SQL, the pipeline against plain loops, and every stage on empty tables."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, differences

from gradeloom.llm import mixing, quality
from gradeloom.llm import queries as Q

STAGE_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    got, want, different = differences(Q.queries()[name](spark, sf_dir), connect(sf_dir), Q.oracle_sql()[name])
    assert not different, different
    assert got == want > 0


def test_every_operator_has_a_query():
    names = Q.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))


def test_pipeline_stages_keep_their_columns(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    empty = spark.createDataFrame([], STAGE_COLUMNS)
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, empty, sf_dir).count() == 0
        columns = docs.columns
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        sizes.append(docs.count())
        assert i == 4 or docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5] > 0


def _lower(text):
    return re.sub("[A-Z]", lambda c: c[0].lower(), text or "")


def _one_of_each(rows):
    """The smallest doc_id of each group of fingerprints linked at four bits or fewer."""
    prints = {}
    for doc, text in rows.items():
        w = re.findall("[^\x20\x09-\x0d]+", _lower(text))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[j:j + 4]).encode(), 42) for j in range(max(1, len(w) - 3) if w else 0)]
        prints[doc] = sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))
    left, kept = set(prints), []
    while left:
        first = min(left)
        kept.append(first)
        group = {first}
        left -= group
        while group:
            group = {d for d in left for g in group if (prints[d] ^ prints[g]).bit_count() <= 4}
            left -= group
    return {d: rows[d] for d in kept}


def _clean(rows, items):
    cut = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    windows = {tuple(w[j:j + 13]) for w in map(cut, items) for j in range(max(1, len(w) - 12) if w else 0)}
    sizes, kept = {len(w) for w in windows}, {}
    for doc, text in rows.items():
        w = cut(text)
        hit = {k for m in sizes for j in range(len(w) - m + 1) if tuple(w[j:j + m]) in windows for k in range(j, j + m)}
        if not hit or 20 * len(hit) < len(w):
            kept[doc] = text
    return kept


def test_pipeline_against_plain_stages(spark, sf_dir):
    """Model decisions are taken from the fitted models, all else is done again in loops."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("keep").collect()}
    rows = _one_of_each({d: t for d, t in texts.items() if d in good})
    rows = _clean(rows, [r.text for r in items.collect()])
    left = docs.where(docs.doc_id.isin(list(rows)))
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(left, Q.known_languages(left, labels)).collect()}
    tokenizer, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for doc, text in rows.items():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += copies[doc]
    got = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == +expected
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]

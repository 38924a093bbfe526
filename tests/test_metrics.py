"""BLEU and TF-IDF against short loops written from the published formulas."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from gradeloom.functions import ngrams
from gradeloom.functions.similarity import counted_terms, metric_tokens, vocabulary_terms
from gradeloom.operators import scoring as S

TEXTS = [
    ("a", "a"), ("a b", "a b"), ("a b c", "a b c"), ("a b c d e", "a b c d e"),
    ("a b c", "a b c d e f"), ("x y z", "a b c"), ("a b c d e", "a b x d e"), ("", "a"), ("a", ""),
    ("", ""), ("x &amp; y 3.5 b-c 4-5, end.", "x & y 3.5 b-c 4 - 5 , end ."), ("a a a a", "a a"),
    ("the cat the cat the", "the cat sat on the mat the cat"), ("A->B: hi\nB->A", "a -> b : hi b -> a"),
    ("@startuml\nclass A\n@enduml", "class  A"), ("a < b &lt; c", "a &lt; b < c"),
]


def normalise(text):
    text = re.sub(r"@enduml[^\n]*", "", re.sub(r"@startuml[^\n]*\n?", "", text, flags=re.I), flags=re.I)
    return " ".join(text.lower().split())


def tokenise(text):
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", f" {text} ")
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    return re.sub(r"([0-9])(-)", r"\1 \2 ", text).split()


def bleu(pred, ref):
    p, r = tokenise(normalise(pred)), tokenise(normalise(ref))
    logs, misses, matches = [], 0, 0
    for n in range(1, 5):
        grams = [Counter(zip(*[t[k:] for k in range(n)])) for t in (p, r)]
        total, match = grams[0].total(), (grams[0] & grams[1]).total()
        if not total:
            break
        misses += match == 0
        matches += match
        logs.append(math.log(match / total if match else 1 / (2 ** misses * total)))
    if not matches:
        return 0.0
    return min(1.0, math.exp(1 - len(r) / len(p))) * math.exp(sum(logs) / len(logs))


def tfidf(pairs):
    def terms(text):
        return Counter(re.findall(r"\b\w\w+\b", normalise(text) or "<empty>"))
    bags = [(terms(p), terms(r)) for p, r in pairs]
    df = Counter(t for pair in bags for bag in pair for t in bag)
    weight = {t: math.log((1 + 2 * len(pairs)) / (1 + n)) + 1 for t, n in df.items()}

    def dot(a, b):
        return sum(n * b[t] * weight[t] ** 2 for t, n in a.items())
    return [dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) if a and b else 0.0 for a, b in bags]


def frame(spark, pairs):
    return spark.createDataFrame(
        [(i, p, r) for i, (p, r) in enumerate(pairs)],
        "row_idx long, uml_pred string, uml_code_gt string")


def column(df, name):
    return [r[name] for r in df.orderBy("row_idx").collect()]


def test_bleu_matches_the_formula(spark):
    got = column(S.sentence_bleu(frame(spark, TEXTS)), "bleu")
    assert got == pytest.approx([bleu(p, r) for p, r in TEXTS])


def test_packed_grams_are_counted_with_repeats(monkeypatch):
    """Against counters, rows of every length in one batch and in slices of single rows."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("ab c dd é  ", k=rng.randint(0, 30))) for _ in range(300)]
    pred, ref = pa.array([*texts, None, ""]), pa.array([*texts[::-1], "a", "b b"])
    n_pred, n_ref, shared = ngrams.matches(pred.fill_null(""), ref)
    for i, (p, r) in enumerate(zip(pred.to_pylist(), ref.to_pylist())):
        p, r = (p or "").split(), r.split()
        assert (n_pred[i], n_ref[i]) == (len(p), len(r))
        for n in range(4):
            a, b = (Counter(zip(*[t[k:] for k in range(n + 1)])) for t in (p, r))
            assert shared[n][i] == (a & b).total()
    whole = ngrams.bleu_of_batch(pred, ref).to_pylist()
    monkeypatch.setattr(ngrams, "_BYTES", 1)
    assert ngrams.bleu_of_batch(pred, ref).to_pylist() == whole
    assert ngrams.bleu_of_batch(pred[:0], ref[:0]).to_pylist() == []


def test_words_are_cut_as_whole_texts_are(evaluate):
    """Tokens and terms made word by word, against the rules run over the whole text."""
    rng = random.Random(7)
    pieces = ["a", "bc", "3", "0", ".", ",", "-", "&amp;", "&lt;", "&quot;", "<skipped>", "<", ";", "é", "ß_", "²", "日本", "'", " ", " "]
    texts = [" ".join("".join(rng.choices(pieces, k=rng.randint(0, 25))).split()) for _ in range(400)] + ["", "<empty>", "a"]
    rows = list(zip(texts, texts[::-1]))
    tokens = evaluate("p string, r string", rows, F.struct(metric_tokens(F.col("p")), vocabulary_terms(F.col("p"))))
    coded = ngrams.Coded.split(pa.array(texts, pa.large_string()), pa.array([""] * len(texts), pa.large_string()))
    made = coded.replaced(ngrams._tokens_of)
    got = [[] for _ in texts]
    for i, code in zip(made.row, made.codes):
        got[i].append(made.values[code].as_py())
    assert got == [list(t[0]) for t in tokens]
    terms = {x: Counter(t[1]) for x, t in zip(texts, tokens)}
    bags = evaluate("p string, r string", rows, counted_terms(F.col("p"), F.col("r")))
    for (p, r), bag in zip(rows, bags):
        assert {e.term: (e.n_left, e.n_right) for e in bag} == {t: (terms[p][t], terms[r][t]) for t in terms[p] | terms[r]}
        assert len(bag) == len({e.term for e in bag})


def test_texts_are_scored_in_one_pass(spark, monkeypatch):
    """The texts are normalised once per model, not once for the scores and once for TF-IDF."""
    calls = []
    monkeypatch.setattr(S, "normalised", lambda df, real=S.normalised: calls.append(1) or real(df))
    S.score_pairs(frame(spark, TEXTS), "base")
    assert len(calls) == 1


@pytest.mark.parametrize("broadcast_terms", [1_000_000, 3])
def test_tfidf_matches_the_formula(spark, broadcast_terms):
    got = column(S.tfidf_cosine(frame(spark, TEXTS), broadcast_terms=broadcast_terms), "emb_sim")
    assert got == pytest.approx(tfidf(TEXTS))


def test_tfidf_with_a_term_in_every_row(spark):
    pairs = [(f"hot hot word{i}", f"hot word{i % 7} {'long' * 40}") for i in range(60)]
    got = column(S.tfidf_cosine(frame(spark, pairs), broadcast_terms=5), "emb_sim")
    assert got == pytest.approx(tfidf(pairs))


WORD = st.sampled_from(["a", "b", "cc", "dd.", "e-f", "3.5", "x,", "(y)", "A", "@enduml"])
TEXT = st.lists(WORD, max_size=12).map(" ".join)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=20, max_size=40))
def test_scores_in_range_and_equal_to_the_formulas(spark, pairs):
    flags = "true AS uml_valid", "'' AS uml_error", "false AS llm_failed"
    rows = S.score_pairs(frame(spark, pairs).selectExpr("*", *flags), "base").orderBy("row_idx").collect()
    assert len(rows) == len(pairs)
    assert [r.bleu for r in rows] == pytest.approx([bleu(p, r) for p, r in pairs])
    assert [r.emb_sim for r in rows] == pytest.approx(tfidf(pairs))
    for row, (p, r) in zip(rows, pairs):
        scores = [row[m] for m in ("exact_match", "bleu", "codebleu", "emb_sim", "token_prec",
                                   "token_recall", "token_f1")]
        assert all(-1e-9 <= s <= 1 + 1e-9 for s in scores)
        if normalise(p) == normalise(r):
            assert row.exact_match == 1.0 and row.emb_sim in (0.0, pytest.approx(1.0))
            if normalise(p):
                assert row.token_f1 == 1.0 and row.bleu == pytest.approx(1.0)


def test_null_texts_score_as_empty(spark):
    df = frame(spark, [(None, None), (None, "word here")]).selectExpr(
        "*", "false AS uml_valid", "'' AS uml_error", "true AS llm_failed")
    first, second = S.score_pairs(df, "base").orderBy("row_idx").collect()
    assert (first.uml_pred, first.exact_match, first.token_f1, first.bleu) == ("", 1.0, 0.0, 0.0)
    assert first.emb_sim == pytest.approx(1.0)
    assert (second.exact_match, second.emb_sim) == (0.0, 0.0)


def test_supplied_vectors(spark):
    df = frame(spark, [("a", "a")]).selectExpr("*", "array(1f, 0f) AS v", "array(1f, 1f) AS w")
    assert S.score_pairs(df, "base", vectors=("v", "w")).first().emb_sim == pytest.approx(0.5 ** 0.5)

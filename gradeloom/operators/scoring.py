"""Similarity scores of predictions against references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.ngrams import term_uses
from gradeloom.functions.similarity import (
    counted_prf, counted_terms, exact_match, term_key, text_measures, token_prf, vector_cosine,
)
from gradeloom.functions.similarity import sentence_bleu as bleu
from gradeloom.functions.text import normalise_code
from gradeloom.session import written

KEY = "row_idx"
PRED, TRUTH = "uml_pred", "uml_code_gt"
DETAIL = (KEY, TRUTH, PRED, "uml_valid", "uml_error", "llm_failed")
# A term key has at most 64 characters or 256 bytes, so this many rows stay below 100 MB.
BROADCAST_TERMS = 300_000


def normalised(df: DataFrame) -> DataFrame:
    """Add ``_pred`` and ``_ref``, the normal forms every measure works on."""
    return df.withColumns({"_pred": normalise_code(F.col(PRED)), "_ref": normalise_code(F.col(TRUTH))})


def sentence_bleu(df: DataFrame, out: str = "bleu") -> DataFrame:
    """Add sentence BLEU of the normalised texts, in 0-1."""
    return normalised(df).withColumn(out, bleu(F.col("_pred"), F.col("_ref"))).drop("_pred", "_ref")


def code_bleu(df: DataFrame, out: str = "codebleu") -> DataFrame:
    """Add CodeBLEU in its fallback form, which is sentence BLEU."""
    return sentence_bleu(df, out)


def tfidf_cosine(
    df: DataFrame,
    key: str = KEY,
    out: str = "emb_sim",
    broadcast_terms: int = BROADCAST_TERMS,
) -> DataFrame:
    """(key, cosine) of TF-IDF vectors fitted on all predictions and references of ``df``.

    A vocabulary grows with the data and its head is in every row, so neither a broadcast
    of all of it nor a plain join on the term would hold. The weights are joined in two
    ways. Frequent terms are broadcast: the threshold is the number of (text, term) uses
    over ``broadcast_terms``, so at most that many terms can reach it. All other terms are
    joined by shuffle, where none of them holds more than one ``broadcast_terms``-th of the
    uses. A vocabulary that fits is broadcast whole, and the second way is not planned at all.

    The texts are read once: the terms of each row are written to the shared folder, as is the
    vocabulary, whose exact size decides the way. A row without any term in common with the
    other side has 0.
    """
    texts = normalised(df).select(key, counted_terms(F.col("_pred"), F.col("_ref")).alias("_terms"))
    return _term_cosine(written(texts), key, out, broadcast_terms)


def _term_cosine(texts: DataFrame, key: str = KEY, out: str = "emb_sim", broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``tfidf_cosine`` of a written table (key, _terms)."""
    entries = texts.select(key, F.explode("_terms").alias("e")).select(
        key, term_key(F.col("e.term")).alias("term"), "e.n_left", "e.n_right")
    # A text counts once per term, and each pair of rows has two texts.
    uses = texts.select("_terms").mapInArrow(term_uses, "term string, n long")
    vocabulary = written(uses.groupBy(term_key(F.col("term")).alias("term")).agg(F.sum("n").alias("df")))
    n_terms, n_uses = vocabulary.agg(F.count(F.lit(1)), F.sum("df")).first()
    n_texts = 2 * texts.count()
    weighted = vocabulary.select(
        "term", "df", (F.ln((1.0 + n_texts) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    threshold = 0.0 if n_terms <= broadcast_terms else n_uses / broadcast_terms
    frequent = F.broadcast(weighted.where(F.col("df") >= threshold).drop("df"))

    square = F.col("idf") * F.col("idf")
    products = [(F.col(a) * F.col(b) * square).alias(c) for c, a, b in (
        ("lr", "n_left", "n_right"), ("ll", "n_left", "n_left"), ("rr", "n_right", "n_right"))]
    # The entries of one row are still together, so the sums shrink to one record per row
    # before the shuffle.
    parts = entries.join(frequent, "term").select(key, *products)
    if n_terms > broadcast_terms:
        rare = weighted.where(F.col("df") < threshold).drop("df")
        parts = parts.unionAll(entries.join(frequent, "term", "left_anti").join(rare, "term").select(key, *products))
    sums = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("lr", "ll", "rr")])
    norm = F.sqrt(F.col("ll") * F.col("rr"))
    return texts.select(key).join(sums, key, "left").select(
        key, F.coalesce(F.when(norm != 0, F.col("lr") / norm), F.lit(0.0)).alias(out))


def score_pairs(
    df: DataFrame,
    label: str,
    vectors: tuple[str, str] | None = None,
    detail: Sequence[str] = DETAIL,
) -> DataFrame:
    """All metrics of one model's predictions.

    Exact match, token and BLEU scores never leave their row. The similarity is the TF-IDF
    cosine, joined by ``row_idx``, or the cosine of two supplied embedding columns. For the former
    the scores and the terms of each row are written once, so the texts are read once.
    """
    kept = [c for c in detail if c in df.columns]
    filled = [F.coalesce(c, F.lit("")).alias(c) if c in (PRED, TRUTH) else F.col(c) for c in kept]
    texts, by_vector = normalised(df), vectors is not None
    if by_vector:
        texts = texts.withColumns({"bleu": bleu(F.col("_pred"), F.col("_ref")), "_prf": token_prf(F.col("_pred"), F.col("_ref"))})
        extra = [vector_cosine(*map(F.col, vectors)).alias("emb_sim")]
    else:
        texts = texts.withColumn("_all", text_measures(F.col("_pred"), F.col("_ref"))).withColumns({
            "bleu": F.col("_all.bleu"), "_prf": counted_prf(F.col("_all"))})
        extra = [F.col("_all.terms").alias("_terms"), F.col(KEY).alias("_key")]
    scored = texts.select(
        *filled, F.lit(label).alias("model"), exact_match(F.col("_pred"), F.col("_ref")).alias("exact_match"),
        "bleu", F.col("bleu").alias("codebleu"), F.col("_prf.p").alias("token_prec"),
        F.col("_prf.r").alias("token_recall"), F.col("_prf.f1").alias("token_f1"), *extra)
    if not by_vector:
        scored = written(scored)
        # One narrow record per row on the hashed side, so the texts need not be sorted.
        scored = scored.join(_term_cosine(scored.select("_key", "_terms"), "_key").hint("shuffle_hash"), "_key")
    return scored.select(*kept, "model", "exact_match", "bleu", "codebleu", "emb_sim",
                         "token_prec", "token_recall", "token_f1")

"""Pairwise similarity of two texts in one row, as plain column expressions.

The inputs named ``*_norm`` are already in the form of ``normalise_code``, so a caller that
needs several measures normalises each text once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions.arrays import let, paired_bag
from gradeloom.functions.ngrams import TOKEN_ENTITIES, TOKEN_RULES, bleu_of_texts, measures_of_texts, terms_of_texts
from gradeloom.functions.text import words

# Fixed value: a vocabulary term has two or more letters, digits or underscores.
TERM = r"[\p{L}\p{N}_]{2,}"
EMPTY_TEXT = "<empty>"


def exact_match(pred_norm: Column, ref_norm: Column) -> Column:
    return (pred_norm == ref_norm).cast("double")


def token_prf(pred_norm: Column, ref_norm: Column) -> Column:
    """``struct<p, r, f1>``: precision, recall and F1 over distinct tokens; all 0 when a side
    has none."""
    pred, ref = F.array_distinct(words(pred_norm)), F.array_distinct(words(ref_norm))
    shared = F.size(F.array_intersect(pred, ref))
    return counted_prf(F.struct(
        shared.alias("shared"), F.size(pred).alias("n_pred"), F.size(ref).alias("n_ref")))


def counted_prf(counted: Column) -> Column:
    """``token_prf`` from the numbers of distinct tokens ``struct<shared, n_pred, n_ref>``."""
    def scores(counts):
        usable = (counts["n_pred"] > 0) & (counts["n_ref"] > 0)
        shared = counts["shared"].cast("double")
        precision, recall = shared / counts["n_pred"], shared / counts["n_ref"]
        f1 = F.coalesce(
            F.try_divide(2.0 * precision * recall, precision + recall), F.lit(0.0))
        zero = F.lit(0.0)
        return F.when(usable, F.struct(precision.alias("p"), recall.alias("r"), f1.alias("f1"))) \
            .otherwise(F.struct(zero.alias("p"), zero.alias("r"), zero.alias("f1")))

    return let(counted, scores)


def spaced_tokens(text_norm: Column) -> Column:
    """The text with blanks between the tokens of the 13a scheme of machine-translation scoring."""
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), TOKEN_ENTITIES, text_norm)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    return reduce(lambda t, r: F.regexp_replace(t, *r), TOKEN_RULES, text)


def metric_tokens(text_norm: Column) -> Column:
    """Tokens of the 13a scheme."""
    return words(spaced_tokens(text_norm))


def sentence_bleu(pred_norm: Column, ref_norm: Column) -> Column:
    """Sentence BLEU in 0-1: orders 1-4, effective order, exponential smoothing.

    Nothing leaves the row: no explode, no shuffle, and one row is the largest unit of work.
    The distinct words of an Arrow batch of rows are cut into tokens once, and its n-grams are
    counted together.
    """
    return F.arrow_udf(bleu_of_texts, T.DoubleType())(pred_norm, ref_norm)


_TERMS = "array<struct<term string, n_left int, n_right int>>"


def counted_terms(pred_norm: Column, ref_norm: Column) -> Column:
    """``array<struct<term, n_left, n_right>>``: every distinct term of either text with its counts."""
    return F.arrow_udf(terms_of_texts, _TERMS)(pred_norm, ref_norm)


def text_measures(pred_norm: Column, ref_norm: Column) -> Column:
    """``struct<bleu, shared, n_pred, n_ref, terms>``: sentence BLEU, the numbers for
    ``counted_prf`` and the ``counted_terms``, from one reading of the texts."""
    return F.arrow_udf(measures_of_texts, f"struct<bleu double, shared int, n_pred int, n_ref int, terms {_TERMS}>")(
        pred_norm, ref_norm)


def vocabulary_terms(text_norm: Column) -> Column:
    """Terms of a text in the vocabulary's sense; the empty text has a stand-in."""
    filled = F.when(text_norm == "", EMPTY_TEXT).otherwise(text_norm)
    return F.regexp_extract_all(filled, F.lit(TERM), F.lit(0))


def term_key(term: Column) -> Column:
    """The term, or its digest where that is shorter: bounds the size of a vocabulary row."""
    return F.when(F.length(term) > 64, F.sha2(term, 256)).otherwise(term)


def term_bag(pred_norm: Column, ref_norm: Column) -> Column:
    """Distinct terms of both texts with their counts, see ``paired_bag``."""
    return paired_bag(vocabulary_terms(pred_norm), vocabulary_terms(ref_norm))


def vector_cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors; 0 when either has no length."""
    def dot(a, b):
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(norms == 0, 0.0).otherwise(dot(left, right) / norms)
